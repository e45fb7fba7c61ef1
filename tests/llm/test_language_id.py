import zlib
from collections import Counter

import numpy as np
import pytest

from verifolio.llm import language_id
from verifolio.llm.language_id import UNDETERMINED, RankOrder, grams, ranked


def slow_grams(text):
    marked, out = ["_"], Counter()
    for c in text.lower():
        if c.isalpha():
            marked.append(c)
        elif marked[-1] != "_":
            marked.append("_")
    if marked[-1] != "_":
        marked.append("_")
    for n in (1, 2, 3):
        for i in range(len(marked) - n + 1):
            gram = marked[i : i + n]
            if gram != ["_"]:
                out["".join(gram)] += 1
    return out


def name(key):
    points = [key >> 42 & 0x1FFFFF, key >> 21 & 0x1FFFFF, key & 0x1FFFFF]
    return "".join("_" if p == 0 else chr(p) for p in points if p != 0x1FFFFF)


def test_grams_against_counting():
    for text in ("The cat, the CAT!", "éa  b1c", "日本語 text", "x", " a b "):
        assert Counter(name(int(k)) for k in grams(text)) == slow_grams(text)
    assert grams("12 ,. 😀") is None and grams("") is None


def test_ranks_break_ties_by_key():
    keys = np.array(sorted([5, 5, 5, 9, 9, 2, 2, 7]), np.uint64)
    assert ranked(keys, 3).tolist() == [5, 2, 9]
    assert ranked(keys, 10).tolist() == [5, 2, 9, 7]


def test_distance_by_hand():
    a, b = np.array([1, 2, 3], np.uint64), np.array([3, 9], np.uint64)
    model = RankOrder({"a": a, "b": b}, 3)
    at = model.places
    assert at[0].tolist() == [0, 1, 2, -1, -1] and at[1].tolist() == [-1, -1, 0, 1, -1]


def test_held_out_accuracy(documents):
    found = language_id.language_id(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) == documents.count()
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in found)


def slow_query(rows):
    """doc_id to prediction and score, with counters and lists only."""
    counts = {}
    for d, text, lang in rows:
        if zlib.crc32(str(d).encode()) % 4 != 2 and lang is not None and text is not None and any(c.isalpha() for c in text):
            counts.setdefault(lang, Counter()).update(slow_grams(text))

    def key(gram):
        points = [0 if c == "_" else ord(c) for c in gram]
        packed = [0x1FFFFF] * (3 - len(points)) + points
        return packed[0] << 42 | packed[1] << 21 | packed[2]

    def order(counter):
        return sorted(counter, key=lambda g: (-counter[g], key(g)))[:400]

    profiles = {lang: {g: i for i, g in enumerate(order(c))} for lang, c in sorted(counts.items())}
    out = {}
    for d, text, _ in rows:
        if not text or not any(c.isalpha() for c in text):
            out[d] = ("und", 0.0)
            continue
        own = order(slow_grams(text))
        far = {lang: sum(abs(p[g] - i) if g in p else 400 for i, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(far, key=lambda x: (far[x], x))
        worst = max(far.values())
        out[d] = (best, (worst - far[best]) / worst if worst else 0.0)
    return out


def test_query_against_counters(documents, spark):
    rows = [(r.doc_id, r.text, r.lang) for r in documents.collect()] + [(5000, None, "en"), (5001, "12 :", "de"), (5002, "ÄÖ straße", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: (r.lang_pred, r.score) for r in language_id.language_id(docs).collect()}
    expected = slow_query(rows)
    assert found.keys() == expected.keys()
    assert all(found[d][0] == expected[d][0] and abs(found[d][1] - expected[d][1]) < 1e-9 for d in found)


def test_what_is_no_language_raises(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 2)
    rows = spark.createDataFrame([(f"l{i}", "text") for i in range(3)], "lang string, text string")
    with pytest.raises(ValueError):
        language_id.learn_profiles(rows)


def test_odd_rows(odd, none):
    found = {(r.doc_id): r for r in language_id.language_id(odd).collect()}
    assert [found[i].lang_pred for i in (1, 2, 3)] == [UNDETERMINED] * 3
    assert language_id.language_id(none).count() == 0
    nothing = language_id.predict_languages(odd, {}, {"doc_id": odd.doc_id}).collect()
    assert {r.lang_pred for r in nothing} == {UNDETERMINED}
