import numpy as np
import pytest

from verifolio.llm import mixing
from verifolio.llm.common import UID


@pytest.fixture(scope="module")
def tables(spark):
    """Two sources, one of them hot; good prose against noise, labelled for a third."""
    rng = np.random.default_rng(2)
    words = ["lamp", "river", "stone", "cloud", "garden", "winter", "letter", "copper"]
    rows, labels = [], []
    for i in range(600):
        good = i % 3 > 0
        text = " ".join(rng.choice(words, 30)) if good else " ".join(f"{w}###" for w in rng.choice(words, 30))
        rows.append((i, text, "hot" if i % 4 else "cold"))
        if i % 5 < 2:
            labels.append((i, int(good), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def slow_rates(tokens, member, target, steps=400):
    """The same least squares, all in one numpy array."""
    rate = np.ones(len(tokens))
    whole = tokens @ member
    for _ in range(steps):
        rate = np.maximum(0, rate - member @ (((rate * tokens) @ member - target) / whole))
    return rate


def test_totals_match_targets(tables):
    docs, labels = tables
    found = mixing.fit_rates(docs, labels, {"hot": 0.5, "cold": 0.5}, {1: 0.9, 0: 0.1}).collect()
    assert len(found) == docs.count() and min(r.rate for r in found) >= 0
    whole = sum(r.n_tokens for r in found)
    for source in ("hot", "cold"):
        for c, weight in ((0, 0.1), (1, 0.9)):
            total = sum(r.n_tokens * r.rate * r.posteriors[c] for r in found if r.source == source)
            assert abs(total - whole * 0.5 * weight) < 0.01 * whole
    # whole copies follow the rates
    assert abs(sum(r.copies * r.n_tokens for r in found) - whole) < 0.1 * whole
    assert all(r.copies in (int(r.rate), int(r.rate) + 1) for r in found)


def test_rates_against_one_array(tables):
    docs, labels = tables
    found = mixing.fit_rates(docs, labels, {"hot": 0.5, "cold": 0.5}, {1: 0.9, 0: 0.1}, steps=60, tolerance=0.0001).collect()
    tokens = np.array([r.n_tokens for r in found], float)
    member = np.array([[p * (r.source == s) for s in ("cold", "hot") for p in r.posteriors] for r in found])
    target = tokens.sum() * np.array([0.05, 0.45, 0.05, 0.45])
    assert np.abs(slow_rates(tokens, member, target) - np.array([r.rate for r in found])).max() < 0.05


def nonnegative(tokens, member, target):
    """Least squares over nonnegative rates by coordinate descent; returns the least value."""
    a = member.T * tokens
    whole = a.sum(1)
    a, b = a[whole > 0] / np.sqrt(whole[whole > 0])[:, None], target[whole > 0] / np.sqrt(whole[whole > 0])
    r, gap = np.zeros(len(tokens)), -b
    square = (a * a).sum(0)
    for _ in range(300):
        for d in np.nonzero(square)[0]:
            new = max(0.0, r[d] - a[:, d] @ gap / square[d])
            gap = gap + a[:, d] * (new - r[d])
            r[d] = new
    return gap @ gap


def test_rates_reach_the_least_value(tables):
    """Against an independent solver, for targets that the documents can and cannot meet."""
    docs, labels = tables
    for by_class in ({1: 0.9, 0: 0.1}, {1: 1.0, 0: 0.0}):
        found = mixing.fit_rates(docs, labels, {"hot": 0.5, "cold": 0.5}, by_class, steps=200, tolerance=0.0).collect()
        tokens = np.array([r.n_tokens for r in found], float)
        member = np.array([[p * (r.source == s) for s in ("cold", "hot") for p in r.posteriors] for r in found])
        share = [by_class[0] / 2, by_class[1] / 2]
        target = tokens.sum() * np.array(share + share)
        rates = np.array([r.rate for r in found])
        whole = member.T @ tokens
        own = ((member.T @ (tokens * rates) - target) ** 2 / np.where(whole > 0, whole, 1)).sum()
        assert rates.min() >= 0 and own <= nonnegative(tokens, member, target) + 1e-4 * tokens.sum()


def test_repeated_ids_keep_the_sample_bounded(spark):
    docs = spark.createDataFrame([(1, f"text {i}", "s") for i in range(50)] + [(2, "other", "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    _, shares = mixing.fit_classifier(docs, labels)
    assert shares == {0: 0.5, 1: 0.5}


def test_classifier_on_held_out_rows(tables):
    docs, labels = tables
    known = {r.doc_id for r in labels.collect()}
    rows = mixing.mixing(docs, labels).collect()
    right = [(r.posterior > 0.5) == (r.doc_id % 3 > 0) for r in rows if r.doc_id not in known]
    assert np.mean(right) > 0.97


def test_default_targets_keep_the_size(documents, spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = mixing.mixing(documents, labels).collect()
    assert len(found) == documents.count()
    assert abs(sum(r.rate * r.n_tokens for r in found) / sum(r.n_tokens for r in found) - 1) < 0.02


def test_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 3)
    rows = [(i, "some words here", f"s{i % 8}" if i % 8 else None) for i in range(80)]
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    found = mixing.mixing(spark.createDataFrame(rows, "doc_id long, text string, source string"), labels).collect()
    assert len(found) == 80 and all(r.posterior == 1.0 for r in found)


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(6, 1, 0), (9, 0, 0), (None, 1, 1), (7, None, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    found = mixing.fit_rates(odd, labels).collect()
    assert len(found) == odd.count() and len({r[UID] for r in found}) == len(found)
    assert {r.n_tokens for r in found if r.id in (1, 2, 3)} == {0}
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for y in (labels, no_labels):
        out = mixing.mixed(odd, y)
        assert out.columns == odd.columns
        assert out.count() == sum(r.copies for r in mixing.fit_rates(odd, y).collect())
        assert mixing.mixed(none, y).count() == 0


def test_every_source_has_its_own_target(spark, monkeypatch):
    """With more sources than the driver holds: weights reach all, and rates are the same."""
    rows = [(i, "some words here " * (1 + i % 3), f"s{i % 40}" if i % 40 else None) for i in range(400)]
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = {f"s{i}" if i else None: i % 4 for i in range(40)}
    of = lambda w: {r.id: (r.rate, r.source, r.n_tokens) for r in mixing.fit_rates(docs, labels, w).collect()}
    listed = {k: of(w) for k, w in (("given", weights), ("default", None))}
    monkeypatch.setattr(mixing, "MAX_SOURCES", 3)
    for k, w in (("given", weights), ("default", None)):
        found = of(w)
        assert found.keys() == listed[k].keys() and all(abs(found[d][0] - listed[k][d][0]) < 1e-6 for d in found)
        size = sum(n for _, _, n in found.values())
        got, own = {}, {}
        for r, s, n in found.values():
            got[s], own[s] = got.get(s, 0) + r * n, own.get(s, 0) + n
        parts = weights if w else {s: n**mixing.TEMPER for s, n in own.items()}
        assert all(abs(got[s] - size * parts[s] / sum(parts.values())) < 0.01 * size / 40 for s in own)
