"""Exact deduplication by distributed most-significant-digit radix partitioning.

Texts are equal when identical after deleting the characters ``[\\x20\\x09-\\x0D]``.
Documents start in one group. Each round takes the next bytes of the normalised text
as the digit, splits every group by it, and retires groups that are singletons or whose
text has ended; only undecided rows, with the bytes not yet read, go on. Digits widen
from round to round, so a text of n bytes takes about log8(n) rounds. Equality is decided
by the bytes alone; the digest in the result is a label.

Groups are never gathered: a round counts its (group, digit) keys with partial
aggregation and joins the counts of keys with several rows back to the rows, which are
narrow: a row's id, group and digit. Open rows are found there, and then their texts are
fetched by row id from the staged documents: by a broadcast of the ids where they are few,
else by a shuffle of the texts that a bitmap of fixed size lets through. The texts of other
rows never move, on either side of that switch, and both sides give the same rows.

Defined results: null text counts as empty; empty and blank texts form one group; of
equal texts the row with the most code points in the original text stays, then the
smallest id (null ids last), then one of the repeated rows; an empty table gives no rows;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UID, decided, drop_staged, identified, stage

FIRST_WIDTH = 32
GROWTH = 8
LAST_WIDTH = 1 << 20
#: Counts of keys are broadcast up to this measured size, ids of open rows up to this number.
BROADCAST_BYTES = 32 << 20
BROADCAST_ROWS = 1_000_000
#: Slots of the bitmap that stands for more ids: a million words of 64.
SLOTS = 1 << 26
KEY = ["grp", "digit", "ended"]


def normalised(text: str):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", "").cast("binary")


def _counts(rows: DataFrame, label: str) -> DataFrame:
    """The keys with several rows: their size, a new group id, and the row that stays."""
    best = F.max(F.struct("points", (-F.col("id")).alias("nid"), (-F.col(UID)).alias("nuid"))).alias("best")
    grouped = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("size"), best, F.min(UID).alias("next")).where("size > 1")
    return stage(
        grouped.select(*(F.col(k).alias(f"k_{k}") for k in KEY), "size", "next", (-F.col("best.nid")).alias("keep_id"), (-F.col("best.nuid")).alias("keep_uid")),
        label,
    )


def _with_counts(rows: DataFrame, counts: DataFrame, how: str) -> DataFrame:
    """Narrow rows with the counts of their key. Counts of a measured size under the limit
    are broadcast; larger ones are joined by a shuffle."""
    n, size = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("k_digit")), F.lit(0))).first()
    side = F.broadcast(counts) if size + 64 * n <= BROADCAST_BYTES else counts
    return rows.join(side, (rows.grp == side.k_grp) & (rows.digit == side.k_digit) & (rows.ended == side.k_ended), how)


def _marked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Of rows (with __vf_uid) about those whose id is among ids (k_uid): a bitmap of
    ``SLOTS`` hash slots, of fixed size, is broadcast, so that the texts of other rows are
    not shuffled. Some pass that are not among them; the join that follows drops these."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS))
    bit = F.expr("shiftleft(1L, int(pmod(slot, 64)))")
    words = ids.select(slot("k_uid").alias("slot")).groupBy(F.floor(F.col("slot") / 64).alias("word")).agg(F.bit_or(bit).alias("bits"))
    own = rows.withColumn("slot", slot(UID)).withColumn("own", F.floor(F.col("slot") / 64))
    hit = own.join(F.broadcast(words), F.col("own") == F.col("word")).where(F.col("bits").bitwiseAND(bit) != 0)
    return hit.select(*rows.columns)


def _opened(texts: DataFrame, heads: DataFrame, open_keys: DataFrame, label: str) -> DataFrame:
    """The rows of open groups with their text: found on narrow heads first, so that only
    their texts move. Few ids are broadcast, and then no text moves at all."""
    ids = stage(_with_counts(heads, open_keys, "inner").select(F.col(UID).alias("k_uid"), "next"), label)
    if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return texts.join(F.broadcast(ids), F.col(UID) == F.col("k_uid"))
    return _marked(texts, ids).join(ids, F.col(UID) == F.col("k_uid"))


def _closed(rows: DataFrame, counts: DataFrame, label: str) -> DataFrame:
    """Rows whose group is a singleton, and so has no counts, or whose text has ended."""
    single = F.col("size").isNull()
    return stage(
        _with_counts(rows.select(UID, "id", "sha", *KEY), counts, "left")
        .where(single | F.col("ended"))
        .select(
            UID,
            "id",
            F.when(single, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.when(single, F.col(UID)).otherwise(F.col("keep_uid")).alias("keep_uid"),
            F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
            F.col("sha").alias("text_sha256"),
        ),
        label,
    )


def _digits(rows: DataFrame, carry: list, grp, norm: str, width: int) -> DataFrame:
    return rows.select(
        *carry,
        grp.alias("grp"),
        F.substring(norm, 1, width).alias("digit"),
        (F.octet_length(norm) <= width).alias("ended"),
        F.substring(norm, width + 1, 1 << 30).alias("tail"),
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: __vf_uid, id, keep_id, keep_uid, group_size, text_sha256."""
    norm = identified(docs).select(
        UID, F.col(id_col).alias("id"), F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("points"), normalised(text_col).alias("norm")
    )
    carry = [UID, "id", "points", "sha"]
    width, k = FIRST_WIDTH, 0
    # digits are staged without the texts, which are read again for open groups only
    texts = _digits(norm, [UID, "id", "points", F.sha2("norm", 256).alias("sha")], F.lit(0).cast("long"), "norm", width)
    rows = stage(texts.drop("tail"), "radix-heads")
    found = []
    while rows is not None:
        counts = _counts(rows, f"radix-{k}-keys")
        found.append(_closed(rows, counts, f"radix-{k}"))
        open_keys = counts.where("not k_ended")
        before = rows
        if open_keys.isEmpty():
            rows = None
        else:
            next_width = min(width * GROWTH, LAST_WIDTH) if k else FIRST_WIDTH * (GROWTH - 1)
            if k == 0:
                still = _opened(texts, rows, open_keys, "radix-ids")
            else:
                still = _with_counts(rows, open_keys, "inner")
            rows = stage(_digits(still.select(*carry, "next", "tail"), carry, F.col("next"), "tail", next_width), f"radix-{k}-open")
            width, k = next_width, k + 1
        drop_staged(before, counts)
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs."""
    return exact_groups(docs.select(id_col, text_col), id_col, text_col).select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        (F.col(UID) == F.col("keep_uid")).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that stay."""
    rows = identified(docs)
    groups = exact_groups(rows, id_col, text_col)
    gone = stage(groups.where(F.col(UID) != F.col("keep_uid")).select(F.col(UID).alias("__vf_k")), "exact-gone")
    return decided(rows, gone, "left_anti").select(*(rows[c] for c in docs.columns))
