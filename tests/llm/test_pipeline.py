import corpus_pipeline
import pytest
from test_exact_dedup import brute
from test_near_copies import slow

from verifolio.llm import toxicity
from verifolio.llm.common import stage


@pytest.fixture(scope="module")
def outputs(spark, sf):
    """What every stage returns, over all documents."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        docs = stage(step(spark, docs, sf), f"test-{k}")
        out.append(docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stage_list():
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_toxic_documents_go(outputs, documents, spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(documents, labels)
    kept = texts(outputs[0])
    assert kept == {d: t for d, t in texts(documents).items() if model.score(t) < toxicity.THRESHOLD}
    clean = {r.doc_id for r in labels.where("toxic = 0").collect()}
    assert len(clean & kept.keys()) >= 0.99 * len(clean & texts(documents).keys())


def test_exact_copies_go(outputs):
    rows = list(texts(outputs[0]).items())
    keep = {k for _, k, _, _ in brute(rows)}
    assert texts(outputs[1]) == {d: t for d, t in rows if d in keep}


def test_near_copies_go(outputs):
    rows = list(texts(outputs[1]).items())
    keep = set(slow(rows).values())
    assert len(keep) < len(rows) and texts(outputs[2]) == {d: t for d, t in rows if d in keep}


def test_mix_and_encoding(outputs):
    before = texts(outputs[2])
    mixed = outputs[3].collect()
    assert {r.doc_id: r.text for r in mixed}.items() <= before.items()
    size = sum(len(t.split()) for t in before.values())
    assert abs(sum(len(r.text.split()) for r in mixed) - size) < 0.1 * size
    encoded = outputs[4].collect()
    assert sorted(r.doc_id for r in encoded) == sorted(r.doc_id for r in mixed) and all(r.exact for r in encoded)


def test_columns_stay(outputs, documents):
    assert all(o.columns == documents.columns for o in outputs[:4])


def test_odd_rows_and_empty_tables(spark, odd, none, sf):
    for docs in (odd, none):
        out = docs
        for k, (_, step) in enumerate(corpus_pipeline.STAGES):
            last = out
            out = stage(step(spark, out, sf), f"odd-{k}")
            assert k == 4 or out.columns == last.columns
        assert (out.count() > 0) == (docs is odd)


def test_run(spark, sf, outputs):
    assert corpus_pipeline.run(spark, sf).count() == outputs[-1].count()
