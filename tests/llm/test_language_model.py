import math
import zlib
from collections import Counter

import pytest

from verifolio.llm import language_model as lm


def base_scores(rows, modulus=7, held=2):
    counts = Counter()
    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    out = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % modulus == held
    for d, t in rows:
        if not out(d):
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    return [
        (d, out(d), len(tk := tokens(t)), sum(counts[w] > 0 for w in tk), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tk), 6)) for d, t in rows
    ]


def got(df):
    return [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df.collect()]


def test_base_scores(documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert sorted(got(lm.lm_scores(documents))) == sorted(base_scores(rows))


def slow_model(train, order=lm.ORDER, priors=lm.PRIORS):
    """Probability of the last word of a gram after those before it, by dictionaries."""
    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    c = Counter()
    for t in train:
        words = [None] + tokens(t)
        for k in range(1, order + 1):
            c.update(tuple(words[i - k + 1 : i + 1]) for i in range(k - 1, len(words)))
    words = {g[0]: m for g, m in c.items() if len(g) == 1 and g[0] is not None}
    by = Counter(words.values())
    d = min(max(by[1] / (by[1] + 2 * by[2]), 0.1), 0.9) if by[1] and by[2] else 0.5
    n = sum(words.values())

    def p(gram):
        if len(gram) == 1:
            return 1.0 if not n else (words[gram[0]] - d) / n if gram[0] in words else d * len(words) / n
        prior, whole = priors[len(gram) - 2], c[gram[:-1]]
        return (c[gram] + prior * p(gram[1:])) / (whole + prior)

    def score(t):
        row = [None] + tokens(t)
        return sum(math.log10(p(tuple(row[max(0, i - order + 1) : i + 1]))) for i in range(1, len(row)))

    return p, words, score


@pytest.mark.parametrize("order", [1, 2, 3])
def test_every_context_is_a_distribution(order):
    """Of the model in dictionaries, which the next test holds the scores against."""
    p, words, _ = slow_model(["the cat sat on the mat", "the cat ran", "a dog sat on the cat"] * 3 + ["lonely words here"], order)
    for context in [(None,), (b"the",), (b"unseen",), (None, b"the"), (b"on", b"the"), (b"the", b"unseen")]:
        context = context[-order + 1 :] if order > 1 else ()
        assert abs(sum(p((*context, w)) for w in (*words, b"unseen")) - 1) < 1e-9


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_of_automaton_and_dictionaries(documents, spark, monkeypatch, order):
    """All rows, with blocks and buckets small enough that there are many, and texts of several pieces."""
    monkeypatch.setattr(lm, "BUCKET", 1 << 12)
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    rows += [(90000, None), (90001, "words never seen before"), (90002, "the of the"), (90002, "the of the"), (90003, "a B\x0bc\td " * 400), (90004, "\xa0 x\u2028y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    score = slow_model([t for d, t in rows if d % 3], order)[2]
    expected = sorted((d, score(t)) for d, t in rows)
    got = sorted((r.id, r.score) for r in lm.score(docs, docs.doc_id % 3 > 0, order=order).collect())
    assert [d for d, _ in got] == [d for d, _ in expected]
    assert all(abs(a - b) < 1e-6 * max(1, abs(b)) for (_, a), (_, b) in zip(got, expected))


def test_blocks_and_pieces(monkeypatch):
    """Pieces of a text give its words; an n-gram does not cross texts."""
    texts = [b"One two\nthree", b"", b"two THREE four " * 50]
    whole = lm._grams(texts, 3)
    monkeypatch.setattr(lm, "_PIECE", 7)
    parts = lm._grams(texts, 3)
    assert (whole.keys == parts.keys).all() and all((a == b).all() for a, b in zip(whole.places, parts.places))
    # marks and words; pairs and triples, of which those of the second text are a mark and the end
    assert whole.starts.tolist() == [0, 5, 7, 159] and [int((p >= 0).sum()) for p in whole.places] == [159, 156, 153]


def test_packed_counts():
    import numpy as np

    counts = np.array([0, 1, 254, 255, 256, 1 << 40, 3])
    assert lm._unpack(lm._pack(counts), 7).tolist() == counts.tolist()
    keys = np.array([0, 5, 6, 1 << 20, (1 << 64) - 1], np.uint64)
    for some in (keys, keys[3:], keys[:1]):
        assert lm._unpack_keys(lm._pack_keys(some)).tolist() == some.tolist()


def test_distinct_by_ranges(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    flat = np.concatenate([rng.integers(0, 1 << 64, 5000, np.uint64, endpoint=False), np.full(900, 77, np.uint64)] * 2)
    distinct, inverse = np.unique(flat, return_inverse=True)
    for size in (100, 3000, 1 << 20):
        monkeypatch.setattr(lm, "_SORTED", size)
        for some, k in ((flat, len(flat)), (flat[:0], 0), (np.full(500, 7, np.uint64), 500)):
            found, place = lm._distinct(some)
            assert (found[place] == some).all() and (np.diff(found) > 0).all() and len(place) == k
    assert (lm._distinct(flat)[1] == inverse).all()


def test_stretches_change_no_score(documents, monkeypatch):
    key = lambda df: sorted((r.id, r.n_tokens, r.n_known, r.base_score, r.score) for r in df.collect())
    whole = key(lm.score(documents, documents.doc_id % 3 > 0))
    monkeypatch.setattr(lm, "_STRETCH", 50)
    assert key(lm.score(documents, documents.doc_id % 3 > 0)) == whole


def test_memory_of_a_block():
    """What a worker holds at most for a block, in bytes a token."""
    import random
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(1)
    texts = [" ".join(f"w{int(rng.paretovariate(0.4)) % 200000}" for _ in range(500)) for _ in range(1600)]
    rows = pa.table([pa.array(range(1600)), pa.array([True] * 1600), pa.array(texts)], ["id", "training", "text"])
    block = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([lm._pack_texts(rows)], pa.binary())], ["block", "texts"])
    lm._grams([t.encode() for t in texts], 3)  # the words' hashes are held
    del rows
    tracemalloc.start()
    asked = list(lm._asker(4, 3, 53)([block]))[0]
    _, ask = tracemalloc.get_traced_memory()
    answers = lm._answer(pa.Table.from_batches([asked])).slice(0, asked.num_rows)
    tracemalloc.reset_peak()
    held = tracemalloc.get_traced_memory()[0]
    lm._scorer(lm.Totals(10**6, 10**5, 0.5), 3, 53, lm.PRIORS)(pa.Table.from_batches([block]), answers)
    peak = tracemalloc.get_traced_memory()[1] - held
    tracemalloc.stop()
    tokens = 1600 * 502
    assert ask < 110 * tokens and peak < 110 * tokens


def test_weights_by_hand(spark):
    docs = spark.createDataFrame([(i, "x y") for i in range(4)] + [(9, "x z")], "doc_id long, text string")
    found = {r.id: r.score for r in lm.score(docs, docs.doc_id >= 0, order=2, priors=(2.0,)).collect()}
    root = lambda c: (c - 0.5) / 15  # noqa: E731  no word occurs twice, so the discount is a half
    p = lambda c, whole, lower: (c + 2 * lower) / (whole + 2)
    expected = p(5, 5, root(5)) * p(4, 5, root(4)) * p(4, 4, root(5))
    assert abs(found[0] - math.log10(expected)) < 1e-9


def test_bad_order(odd):
    with pytest.raises(ValueError):
        lm.score(odd, odd.doc_id > 0, order=4)


def test_model_beats_base_on_held_out_rows(documents):
    found = [r for r in lm.lm_scores(documents).collect() if r.held_out]
    assert sum(r.score for r in found) > sum(r.base_score for r in found)


def test_odd_rows(odd, odd_rows, none):
    rows = [r[:2] for r in odd_rows]
    key = lambda x: repr(x)
    assert sorted(got(lm.lm_scores(odd)), key=key) == sorted(base_scores(rows), key=key)
    assert lm.lm_scores(none).count() == 0


def test_no_training_rows(odd):
    from pyspark.sql import functions as F

    found = lm.score(odd, F.lit(False)).collect()
    assert {(r.base_score, r.score, r.train_tokens) for r in found} == {(0.0, 0.0, 0)}
