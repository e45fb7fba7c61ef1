import re

import numpy as np
import pytest
import xxhash

from verifolio.llm import simhash


def slow_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, radius=3):
    root = list(range(len(prints)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def check(df, rows):
    prints = [slow_fingerprint(t) for _, t in rows]
    label = slow_components(prints)
    least = {}
    for (doc_id, _), c in zip(rows, label):
        if doc_id is not None:
            least[c] = min(least.get(c, doc_id), doc_id)
    expected = sorted(((d, f"{p:016x}", least.get(c)) for (d, _), p, c in zip(rows, prints, label)), key=repr)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=repr) == expected


def test_documents(documents):
    check(simhash.near_duplicates(documents), documents.select("doc_id", "text").collect())


def test_odd_rows(odd, odd_rows, none):
    check(simhash.near_duplicates(odd), [r[:2] for r in odd_rows])
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("tile", [4, 64])
def test_links_of_dense_blocks(spark, tile):
    """Many fingerprints close together, in blocks that need several tiles."""
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 1 << 62))
    prints = {base}
    for _ in range(120):
        flips = rng.choice(64, rng.integers(1, 4), replace=False)
        prints.add((base ^ sum(1 << int(f) for f in flips)) & ((1 << 64) - 1))
    prints |= {int(x) for x in rng.integers(0, 1 << 62, 200)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.link_forest(spark.createDataFrame([(p,) for p in signed], "fp long"), tile=tile).collect()
    for e in edges:
        assert ((e.u ^ e.v) & ((1 << 64) - 1)).bit_count() <= 6  # roots may be two links away
    label = slow_components(list(prints))
    found = {r.node: r.label for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    by = {}
    for s, c in zip(signed, label):
        by.setdefault(c, set()).add(found.get(s, s))
    assert all(len(x) == 1 for x in by.values()) and len({min(x) for x in by.values()}) == len(by)
    assert len(edges) < 5 * len(prints)


def test_long_chain(spark):
    edges = [(i + 1, i) for i in range(60)]
    found = simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.label for r in found} == {0} and len(found) == 61


def test_filter_keeps_one_of_each(odd, none):
    out = simhash.drop_near_copies(odd)
    groups = simhash.near_duplicates(odd).select("component_id").distinct().count()
    assert out.columns == odd.columns and out.count() == groups
    assert simhash.drop_near_copies(none).count() == 0
