import random

import pytest

from verifolio.llm import simhash
from verifolio.llm.common import stage


def slow(rows):
    """doc_id to the smallest id of its component, by comparing all with all."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}


def got(df):
    return {r.id: r.component_id for r in simhash.similar_groups(df).collect()}


def test_documents(documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    found = got(documents)
    assert found == slow(rows)
    assert found[177] == found[1] and found[145] == found[6]  # 11 and 7 SimHash bits apart


@pytest.mark.parametrize("rounds, tile", [(0, 2048), (2, 2048), (0, 8)])
def test_copies_chains_and_common_lines(spark, monkeypatch, rounds, tile):
    """Groups of near copies around the bound, a line that many texts have, short texts."""
    monkeypatch.setattr(simhash, "SAMPLE", 1)
    monkeypatch.setattr(simhash.similar_links, "__defaults__", (rounds, tile, simhash.WIDE))
    rng = random.Random(3)
    line = "permission is hereby granted free of charge to any person who asks"
    rows = []
    for _ in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        for k in range(8):
            if k:
                words = list(words)
                words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
            rows.append(" ".join(words) + (f" {line}" if rng.random() < 0.7 else ""))
    rows += ["one", "ONE ", "one two three four five six", "", None, " \n", line, line + " now"]
    rows = list(enumerate(rows))
    rng.shuffle(rows)
    found = got(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found == slow(rows) and 1 < len(set(found.values())) < len(rows)


@pytest.mark.parametrize("tile", [simhash.TILE, 16])
def test_tiles_leave_a_pair_once(spark, monkeypatch, tile):
    """Near copies share many blocks, which are dealt over many tasks."""
    monkeypatch.setattr(simhash, "SAMPLE", 1)
    monkeypatch.setattr(simhash.similar_links, "__defaults__", (0, tile, simhash.WIDE))
    kept, made = simhash._tile_links, []

    def counted(*args):
        pairs, tiled = kept(*args)
        pairs = stage(pairs, "test-pairs")
        made.append((pairs.count(), pairs.distinct().count()))
        return pairs, tiled

    monkeypatch.setattr(simhash, "_tile_links", counted)
    monkeypatch.setattr(simhash, "COMMON", 1 << 30)
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = [(k, " ".join(words[:k] + [f"x{k}"] + words[k + 1 :])) for k in range(40)]
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = got(spark.createDataFrame(rows, "doc_id long, text string"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert set(found.values()) == {0}
    (total, distinct), = made
    assert distinct == 40 * 39 // 2 and total == distinct


def test_filter_keeps_one_of_each(odd, none):
    out = simhash.drop_similar(odd)
    groups = simhash.similar_groups(odd).select("keep_uid").distinct().count()
    assert out.columns == odd.columns and out.count() == groups
    assert simhash.drop_similar(none).count() == 0
