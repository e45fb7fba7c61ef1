import itertools
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from verifolio.llm import toxicity
from verifolio.llm.toxicity import Lexicon, TermAutomaton


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abcd", min_size=1, max_size=7), min_size=1, max_size=6), st.text("abcd", max_size=8), st.integers(0, 2))
def test_automaton_finds_all_terms_in_reach(terms, token, edits):
    automaton = TermAutomaton(terms, edits, 3)
    expected = {(t, d) for t in terms if (d := distance(t, token)) <= (edits if len(t) >= 3 else 0)}
    assert set(automaton.match(token)) == expected


def model(**weights):
    terms = sorted(weights)
    return Lexicon(terms, weights, 2.0, [-4.0, 1.0, 1.0, 0.0, 0.0, 0.0])


def test_misspelled_terms_count():
    m = model(moron=6.0, worthless=6.0)
    assert m.score("you are a moron") > 0.9
    assert m.score("you are a m0ron, a worthles one") > 0.5
    assert m.score("nothing to see here") < 0.05


def test_quotation_weighs_less_than_abuse():
    m = model(moron=6.0)
    abuse = m.features("get lost you moron and stay away")
    quoted = m.features('the word "moron" is an old term')
    reported = m.features("he said moron to the other man")
    assert abuse[0] > 5 and quoted[0] == 0 and 0 < quoted[2] < abuse[0] / 2
    assert reported[2] < abuse[0]


def test_quotations_are_paired_over_the_whole_text():
    m = model(moron=6.0)
    wide = m.features('she read "a very long sentence that goes on and on and has moron in it, and still goes on for many more words until here" aloud')
    assert wide[0] == 0 and wide[2] > 0
    second = m.features('he met "a man" and "the moron of the town" there')
    assert second[0] == 0 and second[2] > 0
    between = m.features('the "first" thing is that you moron broke the "second" thing')
    assert between[0] > 5
    stray = m.features('an inch is 1" long and you are a moron')
    assert stray[0] > 5
    for text, spans in (("„a b“ c “d”", [(0, 1), (3, 3)]), ('"', []), ('" a "', [(0, 2)]), ("«x y» z", [(0, 1)]), ('("a", b)', [(0, 0)])):
        assert toxicity.quotations(text.split()) == spans, text


def slow_score(m, text):
    """A score with distances to every term and quotations by a scan, hit by hit."""
    tokens = (text or "").lower().split()
    weight = {}
    for raw in set(tokens):
        form = toxicity.form(raw)
        reached = any(distance(t, form) <= (1 if len(t) >= 5 else 0) for t in m.terms if abs(len(t) - len(form)) < 2) if form else False
        weight[raw] = max(0.0, m.weights[form] if form in m.weights else m.unseen if reached else 0.0)
    hits = [i for i, t in enumerate(tokens) if weight[t] > 0]
    best, total = [0.0, 0.0], [0.0, 0.0]
    for k, i in enumerate(hits):
        near = {toxicity.form(t) for t in tokens[max(0, i - 6) : i + 7]}
        quoted, factor = False, 1.0
        if any(a <= i <= b for a, b in toxicity.quotations(tokens)):
            quoted, factor = True, 0.3
        elif near & toxicity._REPORTS:
            quoted, factor = True, 0.6
        elif near & toxicity._ADDRESS:
            factor = 1.15
        close = sum(abs(hits[j] - i) <= 6 for j in (k - 1, k + 1) if 0 <= j < len(hits))
        value = weight[tokens[i]] * factor * (1 + 0.1 * close)
        best[quoted] = max(best[quoted], value)
        total[quoted] += value
    x = [best[0], math.log1p(total[0]), best[1], math.log1p(total[1]), math.log1p(100 * len(hits) / len(tokens)) if tokens else 0.0]
    return 1 / (1 + math.exp(-(m.coefficients[0] + sum(a * b for a, b in zip(m.coefficients[1:], x)))))


def test_query_scores_against_loops(spark):
    folder = "/root/testdata/sf0.01"
    documents, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    m = toxicity.fit(documents, labels.where(toxicity.crc_mod("doc_id", 3) != 1))
    texts = {r.doc_id: r.text for r in documents.collect()}
    found = toxicity.toxicity(documents, labels).collect()
    assert len(found) == len(texts) and len(m.terms) > 0 and any(r.predicted for r in found)
    for r in found:
        assert r.predicted == (r.score >= 0.7)
        if r.predicted or r.doc_id % 10 == 0:
            assert abs(r.score - slow_score(m, texts[r.doc_id])) < 1e-9


def test_known_harmless_form_is_no_hit():
    m = model(moron=6.0)
    m.weights["oron"] = -3.0
    assert m.features("oron oron oron") == (0.0,) * 5


@pytest.fixture(scope="module")
def labelled(spark):
    random.seed(3)
    plain = ["".join(p) for p in itertools.product("bdgk", "aeiou", "lmnr", "aeiou")]
    bad = ["vermin", "wretch", "scoundrel"]
    rows, labels = [], []
    for i in range(400):
        words = random.choices(plain, k=40)
        toxic = i % 4 == 0
        if toxic:
            for at in random.sample(range(40), 3):
                words[at] = random.choice(bad)
        rows.append((i, " ".join(words)))
        if i < 300:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark, labelled):
    rows, labels = labelled
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(found) == 400
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in found)
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in found) > 390


def test_labels_of_held_out_rows_teach_nothing(spark, labelled):
    """Turning every held-out label over leaves all scores as they are."""
    import zlib

    rows, labels = labelled
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    turned = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 3 == 1 else t) for d, q, t in labels]
    scores = [
        {r.doc_id: round(r.score, 9) for r in toxicity.toxicity(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()}
        for x in (labels, turned)
    ]
    assert scores[0] == scores[1]


def test_odd_rows_and_empty_tables(spark, odd, none):
    schema = "doc_id long, quality int, toxic int"
    labels = spark.createDataFrame([(4, 1, 1), (5, None, 1), (6, 1, 0), (6, 0, 0), (None, 1, 1), (7, 1, None), (9, 1, 5)], schema)
    found = toxicity.toxicity(odd, labels).collect()
    assert len(found) == odd.count() and all(0 <= r.score <= 1 for r in found)
    no_labels = spark.createDataFrame([], schema)
    assert {r.score for r in toxicity.toxicity(odd, no_labels).collect()} == {0.0}
    assert toxicity.toxicity(none, labels).count() == 0
    kept = toxicity.drop_toxic(odd, no_labels)
    assert kept.columns == odd.columns and kept.count() == odd.count()
