"""Near-duplicate detection on 64-bit SimHash fingerprints.

**By differing bits** (``simhash_groups``). Fingerprints come from 3-word shingles (XXH64, seed 42, majority of each bit). Distinct
fingerprints within three differing bits are linked exactly: two such fingerprints agree
in at least one of their four 16-bit quarters, so each quarter's value names a block of
fingerprints that must meet. A block is cut into tiles by population count (and by hash
where one count has too many); tile pairs are compared whole with numpy exclusive-or and
bit counts, and pairs whose population counts differ beyond the radius are skipped, as
they cannot hold a link. From a tile pair only a spanning forest of its links leaves, so
n near copies give about n rows and not n squared, and no link between components is
lost. Components come from minimum labels with pointer jumping over staged tables.

**By similarity** (``similar_groups``). Texts are linked if the Jaccard similarity of their
sets of five-word shingles (ASCII lower case; a shorter text is one shingle) is at least 0.8.
Fingerprints of such texts may differ by more bits than quarters could find, so blocks come
from the shingles: under one order of all shingles, two similar sets share one of their first
n - ceil(0.8 n) + 1, and each of these names a block. The order puts shingles that a sample
found in many texts last; any order gives the same links. In a block fingerprints meet in
tiles as above, within ``WIDE`` bits: at a similarity of 0.8 a bit differs with a chance of
0.15, so 26 of 64 lie over five standard deviations out, and fewer than one link in 10^5 of
those at the very threshold is lost. An exact check follows: parity bitmaps (1024 values, of
which a set has an odd number of shingles; two sets differ by at least as many shingles as
their bitmaps by bits) drop most pairs, in the tile where they meet, and the sets of the
others are compared.

A block's texts first meet one of them, in two rounds with another choice; what that links
needs no further comparison among itself, so a group of n near copies takes about n
comparisons. Tiles then hold the texts of blocks that are still apart. Near copies share many
blocks and would leave each of them as a pair: a pair leaves the first block that both have
among their ``EARLY`` smallest, and only one without such a block leaves all it shares.

Defined results: null text counts as empty and has fingerprint zero, which links like any
other; equal texts share a fingerprint and so a component; by similarity, texts without a
word are near copies of each other; the component id is the smallest id in it (null only if
all its ids are null); an empty table gives no rows; other columns are ignored by the groups
and kept by ``drop_near_copies`` (by bits) and ``drop_similar`` (by similarity), which keep the
row with the smallest id of a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import UID, binaries, decided, drop_staged, few, identified, sliced, stage, trim, with_uid

RADIUS = 3
BANDS = 4
TILE = 2048
_BLOCK = 1 << 16

#: By similarity: words of a shingle, and the similarity as a fraction of whole numbers.
WORDS = 5
NUMERATOR, DENOMINATOR = 4, 5
WIDE = 26
#: One text in so many is sampled for common shingles, found in so many of these or more.
SAMPLE, COMMON, MAX_COMMON = 16, 8, 200_000
ROUNDS = 2
#: Longs of a parity bitmap.
LONGS = 16
#: Of the blocks of a text that are still apart, so many are carried to find the first one
#: that a pair shares.
EARLY = 8
_NONE = (1 << 63) - 1
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: bytes, words: int = 3) -> int:
    tokens = text.lower().split()
    n = len(tokens) - words + 1
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    hashed = xxhash.xxh64_intdigest
    if n <= 1:
        return hashed(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    spans = zip(starts, ends[words - 1 :].tolist())
    return majority(np.fromiter((hashed(joined[a:b], 42) for a, b in spans), np.uint64, n))


def majority(values: np.ndarray) -> int:
    """The bits that over half of the values have."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(values), _BLOCK):
        part = values[i : i + _BLOCK]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(len(part), 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.fromiter(map(fingerprint, binaries(batch.column(2))), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values.view(np.int64))], ["uid", "id", "fp"])


def _forest(left: np.ndarray, right: np.ndarray | None, radius: int, step: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, root) of a spanning forest of the links inside one tile or between two."""
    every = left if right is None else np.concatenate([left, right])
    counts = np.bitwise_count(every)
    order = np.argsort(counts, kind="stable")
    own = every[order]
    counts = counts[order].astype(np.int16)
    n = len(own)
    found_i, found_j = [], []
    for a in range(0, n, step):
        x, high = own[a : a + step], counts[min(a + step, n) - 1]
        for b in range(a, n, step):
            if counts[b] - high > radius:
                break
            i, j = np.nonzero(np.bitwise_count(x[:, None] ^ own[None, b : b + step]) <= radius)
            i, j = i + a, j + b
            keep = i < j
            found_i.append(i[keep])
            found_j.append(j[keep])
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    if not len(i):
        return own[:0], own[:0]
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = np.nonzero(label != np.arange(n))[0]
    return own[moved], own[label[moved]]


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by tile pair; one pair is at most two tiles."""
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        names = ["u", "v"]

        def edges(parts) -> list[tuple[np.ndarray, np.ndarray]]:
            pair, side, fp = (np.concatenate(x) for x in zip(*parts))
            cuts = np.concatenate(([0], np.nonzero(np.diff(pair))[0] + 1, [len(pair)]))
            out = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if b - a == 2:
                    if int(fp[a] ^ fp[a + 1]).bit_count() <= radius:
                        out.append((fp[a : a + 1], fp[a + 1 : b]))
                elif b - a > 2:
                    u, v = _forest(fp[a:b], None, radius)
                    if len(u):
                        out.append((u, v))
            return out

        def batch_of(found):
            u, v = (np.concatenate(x).view(np.int64) for x in zip(*found))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names)

        for batch in batches:
            pair = batch.column(0).to_numpy()
            side = batch.column(1).to_numpy()
            fp = batch.column(2).to_numpy().view(np.uint64)
            if not len(pair):
                continue
            last = int(np.searchsorted(pair, pair[-1]))
            held.append((pair[:last], side[:last], fp[:last]))
            if last or (held[0][0].size and held[0][0][0] != pair[0]):
                if found := edges(held):
                    yield batch_of(found)
                held = []
            held.append((pair[last:], side[last:], fp[last:]))
        if held and (found := edges(held)):
            yield batch_of(found)

    return run


def _tile_pairs(blocks: DataFrame, tile: int, radius: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(pair, side, fp) rows, with the columns to carry: every fingerprint once for each tile
    pair it takes part in."""
    cells = stage(blocks.groupBy("block", "ones").agg(F.count(F.lit(1)).alias("n")), "simhash-cells")
    totals = cells.groupBy("block").agg(F.sum("n").alias("total")).where("total > 1")
    small = blocks.join(totals.where(F.col("total") <= tile).select("block"), "block", "left_semi").select(
        F.col("block").cast("long").alias("pair"), F.lit(0).alias("side"), "fp", *carry
    )
    big = cells.join(totals.where(F.col("total") > tile).select("block"), "block", "left_semi").withColumn("subs", F.ceil(F.col("n") / tile).cast("int"))
    tiles = stage(big.select("block", "ones", "subs", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub")), "simhash-tiles")
    if tiles.isEmpty():
        return small
    a, b = tiles.alias("a"), tiles.alias("b")
    meets = (
        (F.col("a.block") == F.col("b.block"))
        & (F.struct("a.ones", "a.sub") <= F.struct("b.ones", "b.sub"))
        & (F.col("b.ones") - F.col("a.ones") <= radius)
    )
    pairs = a.join(b, meets).select(
        F.col("a.block").alias("block"),
        F.col("a.ones").alias("ones_a"),
        F.col("a.sub").alias("sub_a"),
        F.col("b.ones").alias("ones_b"),
        F.col("b.sub").alias("sub_b"),
        F.xxhash64("a.block", "a.ones", "a.sub", "b.ones", "b.sub").alias("pair"),
    )
    same = (F.col("ones_a") == F.col("ones_b")) & (F.col("sub_a") == F.col("sub_b"))
    use = pairs.select("pair", "block", F.lit(0).alias("side"), F.col("ones_a").alias("ones"), F.col("sub_a").alias("sub")).unionByName(
        pairs.where(~same).select("pair", "block", F.lit(1).alias("side"), F.col("ones_b").alias("ones"), F.col("sub_b").alias("sub"))
    )
    subs = tiles.where("sub = 0").select("block", "ones", "subs")
    placed = blocks.join(subs, ["block", "ones"]).withColumn("sub", F.pmod(F.xxhash64("fp"), F.col("subs")).cast("int"))
    large = placed.join(use, ["block", "ones", "sub"]).select("pair", "side", "fp", *carry)
    return small.unionByName(large)


def link_forest(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp): a spanning forest of all links."""
    if radius >= BANDS:
        raise ValueError("four quarters find links of up to three differing bits")
    quarters = F.array(*(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) + F.lit(65536 * i) for i in range(BANDS)))
    blocks = stage(
        fps.select("fp", F.bit_count("fp").alias("ones"), F.explode(quarters).alias("block")).select(F.col("block").cast("int"), "ones", "fp"),
        "simhash-blocks",
    )
    rows = _tile_pairs(blocks, tile, radius)
    sorted_rows = rows.repartition("pair").sortWithinPartitions("pair", "side")
    edges = stage(sorted_rows.mapInArrow(_compare(radius), "u long, v long").distinct(), "simhash-edges")
    drop_staged(blocks)
    return edges


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for every node of an edge (u, v)."""
    both = stage(edges.select("u", "v").union(edges.select("v", "u")).distinct(), "cc-edges")
    labels = stage(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("label")), "cc-labels")
    while True:
        seen = labels.select(F.col("node").alias("v"), F.col("label").alias("near"))
        near = both.join(seen, "v").groupBy(F.col("u").alias("node")).agg(F.min("near").alias("near"))
        better = stage(labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next")), "cc-next")
        jump = better.select(F.col("node").alias("next"), F.col("next").alias("far"))
        new = stage(better.join(jump, "next", "left").select("node", F.col("label").alias("old"), F.least("next", F.coalesce("far", "next")).alias("label")), "cc-labels")
        done = new.where("old <> label").isEmpty()
        drop_staged(labels, better)
        labels = new
        if done:
            drop_staged(both)
            return labels.select("node", "label")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """__vf_uid, id, fp, component_id, keep_uid (the row that stays) for every row of docs."""
    rows = stage(
        with_uid(docs).select(F.col(UID).alias("uid"), F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(_fingerprints, "uid long, id long, fp long"),
        "simhash-rows",
    )
    first = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "uid")).alias("best")
    fps = stage(rows.groupBy("fp").agg(first), "simhash-distinct")
    labels = components(link_forest(fps.select("fp"), radius, tile))
    named = fps.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"), "best")
    best = named.groupBy("label").agg(F.min("best").alias("best"))
    named = stage(named.select("fp", "label").join(best, "label").select(F.col("fp").alias("k"), "best"), "simhash-named")
    drop_staged(fps, labels)
    return rows.join(named, rows.fp == named.k).select(
        F.col("uid").alias(UID), "id", "fp", F.col("best.id").alias("component_id"), F.col("best.uid").alias("keep_uid")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs."""
    return simhash_groups(docs, id_col, text_col).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that stay: one of each component by bits."""
    rows = identified(docs)
    gone = stage(simhash_groups(rows, id_col, text_col).where(F.col(UID) != F.col("keep_uid")).select(F.col(UID).alias("__vf_k")), "simhash-gone")
    return decided(rows, gone, "left_anti").select(*(rows[c] for c in docs.columns))


# --- By similarity -----------------------------------------------------------------------


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    n = max(len(own) - words + 1, 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(words, len(own))):
        out = (out + own[k : k + n]) * _FACTOR
        out ^= out >> np.uint64(29)
    return np.unique(out)


def prefix(values: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first shingles of a set, of which two similar sets share one."""
    n = len(values)
    size = n - -(-NUMERATOR * n // DENOMINATOR) + 1 if n else 0
    if len(common) and n:
        place = np.searchsorted(common, values)
        place[place == len(common)] = 0
        last = common[place] == values
        values = np.concatenate([values[~last], values[last]])
    return values[:size]


def parity(values: np.ndarray) -> np.ndarray:
    odd = np.bincount((values >> np.uint64(17)).astype(np.int64) % (64 * LONGS), minlength=64 * LONGS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _lists(found: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, found)])
    flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 256):
        yield pa.RecordBatch.from_arrays([batch.column(0), _lists([shingles(t) for t in binaries(batch.column(1))])], ["node", "shingles"])


_SKETCHES = "uid long, id long, node long, n int, fp long, bits array<long>, prefix array<long>"


def _sketches(common: np.ndarray):
    names = [x.split()[0] for x in _SKETCHES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        for batch in sliced(batches, 512):
            sets = [shingles(t) for t in binaries(batch.column(2))]
            # a 64-bit hash stands for a set
            node = np.fromiter((xxhash.xxh64_intdigest(s.tobytes()) for s in sets), np.uint64, len(sets))
            fp = np.fromiter(map(majority, sets), np.uint64, len(sets))
            own = [batch.column(0), batch.column(1), pa.array(node.view(np.int64)), pa.array([len(s) for s in sets], pa.int32()), pa.array(fp.view(np.int64))]
            yield pa.RecordBatch.from_arrays([*own, _lists([parity(s) for s in sets]), _lists([prefix(s, common) for s in sets])], names)

    return run


def _common(texts: DataFrame) -> np.ndarray:
    """Shingles that are in many of the sampled texts."""
    some = texts.where(F.pmod(F.xxhash64("uid"), F.lit(SAMPLE)) == 0).select("uid", "text").mapInArrow(_sets, "node long, shingles array<long>")
    counted = some.select(F.explode("shingles").alias("h")).groupBy("h").count().where(F.col("count") >= COMMON)
    found = counted.orderBy(F.desc("count"), "h").limit(MAX_COMMON).select("h").toArrow().column(0).to_numpy()
    return np.sort(found.astype(np.int64).view(np.uint64))


def _similar(pairs: DataFrame, texts: DataFrame, heads: DataFrame) -> DataFrame:
    """The exact check: the pairs (u, v) of nodes whose sets are similar."""
    a, b = (heads.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}")) for k in "uv")
    differ = F.aggregate(F.zip_with("bits_u", "bits_v", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    may = (DENOMINATOR + NUMERATOR) * differ <= (DENOMINATOR - NUMERATOR) * (F.col("n_u") + F.col("n_v"))
    pairs = stage(pairs.distinct().join(a, "u").join(b, "v").where(may).select("u", "v"), "similar-pairs")
    needed = stage(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct().join(heads, "node").select("node", "first"), "similar-needed")
    rows = texts.join(few(needed), F.col("uid") == F.col("first")).select("node", "text")
    sets = stage(rows.mapInArrow(_sets, "node long, shingles array<long>"), "similar-sets")
    u, v = (sets.select(F.col("node").alias(k), F.col("shingles").alias(f"of_{k}")) for k in "uv")
    both = F.size(F.array_intersect("of_u", "of_v"))
    whole = F.size("of_u") + F.size("of_v") - both
    found = stage(pairs.join(u, "u").join(v, "v").where(DENOMINATOR * both.cast("long") >= NUMERATOR * whole.cast("long")).select("u", "v"), "similar-links")
    drop_staged(pairs, needed, sets)
    return found


def _sized(a: str, b: str):
    """Whether two sets' sizes allow the similarity."""
    return F.least(a, b).cast("long") * DENOMINATOR >= F.greatest(a, b).cast("long") * NUMERATOR


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of rows sorted by the first one, cut where it changes."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy() for c in batch.columns]
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns)]
        cuts = np.concatenate(([0], np.nonzero(np.diff(columns[0]))[0] + 1)).tolist()
        for i, j in zip(cuts[:-1], cuts[1:]):
            yield [c[i:j] for c in columns]
        held = [c[cuts[-1] :] for c in columns]
    if held is not None:
        yield held


def _later(block: int, early: np.ndarray, i: np.ndarray, j: np.ndarray, step: int = 1 << 14) -> np.ndarray:
    """Whether rows i and j share a block before this one among those carried."""
    early = np.where(early < block, early, _NONE)
    out = np.zeros(len(i), bool)
    for a in range(0, len(i), step):
        x, y = early[i[a : a + step]], early[j[a : a + step]]
        for k in range(early.shape[1]):
            own = x[:, k]
            out[a : a + step] |= (own != _NONE) & (own[:, None] == y).any(1)
    return out


def _near(radius: int, step: int = 512):
    """Pairs (u, v) of nodes that are apart, of sizes and parity bitmaps that allow the
    similarity, and within the radius; population counts that differ by more are skipped.
    Of two tiles only rows of different ones are compared: each tile also comes alone."""

    def pairs(side, fp, node, n, label, block, *carried):
        bits, early = np.stack(carried[:LONGS], 1).view(np.uint64), np.stack(carried[LONGS:], 1)
        ones = np.bitwise_count(fp).astype(np.int16)
        order = np.argsort(ones, kind="stable")
        side, two = side[order], side.any()
        fp, node, n, label, ones, bits, early = fp[order], node[order], n[order].astype(np.int64), label[order], ones[order], bits[order], early[order]
        for a in range(0, len(fp), step):
            x, high = slice(a, a + step), ones[min(a + step, len(fp)) - 1]
            for b in range(a, len(fp), step):
                if ones[b] - high > radius:
                    break
                y = slice(b, b + step)
                i, j = np.nonzero(np.bitwise_count(fp[x, None] ^ fp[None, y]) <= radius)
                i, j = i + a, j + b
                low, most = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
                keep = (i < j) & (label[i] != label[j]) & (~two | (side[i] != side[j])) & (DENOMINATOR * low >= NUMERATOR * most)
                i, j = i[keep], j[keep]
                differ = np.zeros(len(i), np.int64)
                for k in range(bits.shape[1]):
                    differ += np.bitwise_count(bits[i, k] ^ bits[j, k])
                keep = (DENOMINATOR + NUMERATOR) * differ <= (DENOMINATOR - NUMERATOR) * (n[i] + n[j])
                i, j = i[keep], j[keep]
                keep = ~_later(int(block[0]), early, i, j)
                if keep.any():
                    u, v = node[i[keep]], node[j[keep]]
                    yield np.minimum(u, v), np.maximum(u, v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            found = np.unique(np.stack([np.concatenate(x) for x in zip(*held)], 1), axis=0)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["u", "v"])

        for _, side, fp, node, n, label, *carried in _grouped(batches):
            for found in pairs(side, fp.view(np.uint64), node, n, label, *carried):
                held.append(found)
                size += len(found[0])
                if size > 1 << 18:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def _met(rows: DataFrame, k: int) -> DataFrame:
    """Rows of blocks (h, node, n, fp, label) that are apart, with the text ``one`` that the
    others of the block meet in round k, and the block's size: one window for all."""
    block = Window.partitionBy("h")
    order = F.struct(F.xxhash64("node", F.lit(k)).alias("at"), "node", "n", "fp", "label")
    found = rows.withColumns({"lo": F.min("label").over(block), "hi": F.max("label").over(block), "size": F.count(F.lit(1)).over(block), "one": F.min(order).over(block)})
    return found.where("lo < hi").select("h", "node", "n", "fp", "label", "size", "one")


def _tile_links(apart: DataFrame, heads: DataFrame, tile: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (u, v) that the tiles of blocks (h, node, n, fp, label) leave to the exact check,
    and the staged table that they read."""
    longs = {f"bits_{k}": F.col("bits")[k] for k in range(LONGS)}
    early = {f"early_{k}": F.coalesce(F.get("early", F.lit(k)), F.lit(_NONE)) for k in range(EARLY)}
    first = apart.groupBy(F.col("node").alias("s_node")).agg(F.slice(F.sort_array(F.collect_list("h")), 1, EARLY).alias("early"))
    sketch = first.join(heads, F.col("node") == F.col("s_node")).select("s_node", *(c.alias(k) for k, c in (longs | early).items()))
    tiled = apart.join(sketch, F.col("node") == F.col("s_node")).select(F.col("h").alias("block"), F.bit_count("fp").alias("ones"), "fp", "node", "n", "label", *longs, *early)
    tiled = stage(tiled, "similar-tiled")
    rows = _tile_pairs(tiled, tile, radius, ("node", "n", "label", "block", *longs, *early))
    return rows.repartition("pair").sortWithinPartitions("pair", "side").mapInArrow(_near(radius), "u long, v long"), tiled


def similar_links(blocks: DataFrame, texts: DataFrame, heads: DataFrame, rounds: int = ROUNDS, tile: int = TILE, radius: int = WIDE) -> DataFrame:
    """Links (u, v) that join all similar nodes of the blocks (as ``_met`` gives them)."""
    every, apart = None, blocks
    for k in range(rounds):
        near = F.bit_count(F.col("fp").bitwiseXOR(F.col("one.fp"))) <= radius
        pairs = apart.where((F.col("label") != F.col("one.label")) & _sized("n", "one.n") & near)
        found = _similar(pairs.select(F.least("node", "one.node").alias("u"), F.greatest("node", "one.node").alias("v")), texts, heads)
        every = found if every is None else every.unionByName(found)
        labels = components(every).select(F.col("node").alias("l_node"), F.col("label").alias("l"))
        # both of a block of two have met
        open_ = apart.where("size > 2").join(few(labels), F.col("node") == F.col("l_node"), "left")
        last, apart = apart, stage(_met(open_.select("h", "node", "n", "fp", F.coalesce("l", "node").alias("label")), k + 1), "similar-apart")
        drop_staged(labels, last)
    pairs, tiled = _tile_links(apart, heads, tile, radius)
    drop_staged(apart)
    found = _similar(pairs, texts, heads)
    drop_staged(tiled)
    return found if every is None else every.unionByName(found)


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """__vf_uid, id, component_id and keep_uid (the row that stays) for every row of docs."""
    texts = identified(docs.select(id_col, text_col) if UID not in docs.columns else docs)
    texts = texts.select(F.col(UID).alias("uid"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketched = stage(texts.mapInArrow(_sketches(_common(texts)), _SKETCHES), "similar-sketches")
    rows = stage(sketched.select("uid", "id", "node"), "similar-rows")
    heads = stage(
        sketched.groupBy("node").agg(
            F.min(F.struct(F.col("id").isNull().alias("no"), "id", "uid")).alias("best"), F.min("uid").alias("first"), F.first("n").alias("n"), F.first("bits").alias("bits")
        ),
        "similar-heads",
    )
    placed = sketched.select(F.explode("prefix").alias("h"), "node", "n", "fp", F.col("node").alias("label"))
    # rows of one set count once: a block holds nodes
    blocks = stage(_met(placed, 0).dropDuplicates(["h", "node"]), "similar-blocks")
    drop_staged(sketched)
    labels = components(similar_links(blocks, texts.select("uid", "text"), heads.select("node", "first", "n", "bits")))
    named = heads.join(labels.withColumnRenamed("node", "l_node"), F.col("node") == F.col("l_node"), "left").select("node", F.coalesce("label", "node").alias("label"), "best")
    best = named.groupBy("label").agg(F.min("best").alias("best"))
    named = stage(named.select("node", "label").join(best, "label").select(F.col("node").alias("k"), "best"), "similar-named")
    drop_staged(heads, labels)
    return rows.join(named, rows.node == named.k).select(
        F.col("uid").alias(UID), "id", F.col("best.id").alias("component_id"), F.col("best.uid").alias("keep_uid")
    )


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that stay: one of each component by similarity."""
    rows = identified(docs)
    gone = stage(similar_groups(rows, id_col, text_col).where(F.col(UID) != F.col("keep_uid")).select(F.col(UID).alias("__vf_k")), "similar-gone")
    return decided(rows, gone, "left_anti").select(*(rows[c] for c in docs.columns))
