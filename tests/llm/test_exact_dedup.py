import hashlib
import re

from verifolio.llm import exact_dedup


def brute(rows):
    """(doc_id, keep_id, group_size, text_sha256) of (doc_id, text) rows."""
    groups = {}
    for doc_id, text in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups.setdefault(key, []).append((-len(text or ""), doc_id is None, doc_id))
    out = []
    for key, members in groups.items():
        keep = min(members, key=lambda m: (m[0], m[1], m[2] or 0))[2]
        out += [(m[2], keep, len(members), hashlib.sha256(key.encode()).hexdigest()) for m in members]
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=repr)


def test_documents(documents):
    rows = documents.select("doc_id", "text").collect()
    assert got(exact_dedup.exact_dedup(documents)) == brute(rows)


def test_odd_rows(odd, odd_rows, none):
    found = exact_dedup.exact_dedup(odd)
    assert got(found) == brute([r[:2] for r in odd_rows])
    # of two repeated rows one stays; the text with more blanks is the longest of its group
    kept = [r.doc_id for r in found.where("kept").collect()]
    assert len(kept) == len(set(kept)) and 8 in kept and 6 not in kept
    assert exact_dedup.exact_dedup(none).count() == 0


def test_digits_run_to_the_end(spark):
    texts = ["a" * n for n in (31, 32, 33, 255, 256, 257, 2048, 2049)] * 2 + ["a" * 2048 + "b", "é" * 128, "é" * 128]
    rows = list(enumerate(texts))
    assert got(exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_shuffled_counts_give_the_same(documents, monkeypatch):
    expected = got(exact_dedup.exact_dedup(documents))
    monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", -1)
    assert got(exact_dedup.exact_dedup(documents)) == expected


def test_shuffled_ids_give_the_same(documents, monkeypatch):
    """More open rows than may be broadcast: texts pass a bitmap, small here, so that some pass in vain."""
    expected = got(exact_dedup.exact_dedup(documents))
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(exact_dedup, "SLOTS", 256)
    assert got(exact_dedup.exact_dedup(documents)) == expected


def test_filter_keeps_columns(odd, none):
    out = exact_dedup.drop_exact_copies(odd)
    assert out.columns == odd.columns
    assert out.count() == exact_dedup.exact_dedup(odd).where("kept").count()
    assert exact_dedup.drop_exact_copies(none).count() == 0
