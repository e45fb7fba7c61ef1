"""Mixing sources to target weights with soft memberships.

A domain is a source together with a class of the labelled table (quality). A document's
source is known, its class is not for most: a classifier learned from labelled rows gives
class posteriors, so a document belongs to its source's domains by its posteriors. Rates
r_d >= 0 say how often a document should be used; they minimise

    sum_k (sum_d r_d t_d p_dk - T_k)^2 / A_k

where t_d is its tokens, T_k the domain's target tokens and A_k its tokens at rate 1. The
minimum is found by projected gradient steps from r = 1 in the metric of the tokens, where
the largest curvature is 1, so a step of 1 never overshoots. Each step adds up the domain
totals with partial aggregation, sends back one number per domain, updates every rate in
place and clips it at 0. Every source has domains of its own. Totals, targets and gaps of up
to ``MAX_SOURCES`` sources are arrays in the driver; those of more sources are a table, which
each step joins to the documents (by a broadcast after its rows were counted, if few).

Targets: a source's weight is given, or its tokens to the power ``TEMPER`` (below 1 evens
sources out); a class's weight is given, or the labelled share moved half way to the best
class. They are scaled so that the mix has as many tokens as the input.

The classifier is a ridge logistic regression, one against the rest, on a hashed byte
bigram profile with a few shape features; it is fitted on a bounded sample of labelled
rows (``MAX_FIT_ROWS``), and learns from all classes that the labels have.

A rate becomes whole copies: its integer part, plus one if a hash of the id is below the
rest. Defined results: null text is empty and has no token (it keeps rate 1 if no step
moves it); a null source is a source of its own; without labels there is one class; of
several labels of one id the largest counts; repeated ids share their hash; an empty table
gives no rows; other columns are ignored by the fit and kept by ``mixed``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UID, as_table, binaries, decided, drop_staged, few, identified, sliced, stage, with_uid, worker_cache

MAX_FIT_ROWS = 6_000
MAX_SOURCES = 256
TEMPER = 0.7
BUCKETS = 256
STEPS = 40
TOLERANCE = 1e-3
_SHAPE = 5


def features(text: bytes) -> np.ndarray:
    """Square roots of the shares of hashed byte bigrams, then length, repetition and
    letter shape; a constant comes first."""
    raw = np.frombuffer(text, np.uint8).astype(np.int64)
    out = np.zeros(1 + BUCKETS + _SHAPE)
    out[0] = 1.0
    if len(raw) > 1:
        hashed = (raw[:-1] * 257 + raw[1:]) * 2654435761 >> 12 & BUCKETS - 1
        out[1 : 1 + BUCKETS] = np.sqrt(np.bincount(hashed, minlength=BUCKETS) / len(hashed))
    words = text.split()
    if words:
        n = len(words)
        kinds = np.bincount(raw, minlength=256)
        upper, digits = kinds[65:91].sum(), kinds[48:58].sum()
        signs = kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum()
        out[1 + BUCKETS :] = np.log1p(n) / 10, len(set(words)) / n, upper / len(raw), digits / len(raw), signs / len(raw)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float) -> np.ndarray:
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-6
    beta = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


class Classifier:
    """Class posteriors of a text; a single class has posterior 1."""

    def __init__(self, classes: list[int], coefficients: np.ndarray | None):
        self.classes, self.coefficients = classes, coefficients

    def posteriors(self, text: bytes) -> list[float]:
        if self.coefficients is None:
            return [1.0]
        z = self.coefficients @ features(text)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if len(self.classes) == 2:
            return [1 - float(p[1]), float(p[1])]
        return (p / p.sum()).tolist()


def fit_classifier(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_FIT_ROWS, penalty: float = 0.3) -> tuple[Classifier, dict[int, float]]:
    """The classifier, and the classes' shares among the rows it was fitted on."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("k"), F.col(label_col).cast("int").alias("y"))
    picked = known.groupBy("k").agg(F.max("y").alias("y")).orderBy(F.xxhash64("k", F.lit(8)), "k").limit(max_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("text")).join(F.broadcast(picked), "k")
    # one text of an id, so that repeated ids leave the sample as small as it was asked for
    rows = rows.groupBy("k").agg(F.first("y").alias("y"), F.min("text").alias("text")).select("y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache(None)
        for batch in sliced(batches):
            x = [features(t).astype(np.float32).tobytes() for t in binaries(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], ["y", "x"])

    found = rows.mapInArrow(run, "y int, x binary").toArrow()
    y = found.column(0).to_numpy()
    classes, counts = np.unique(y, return_counts=True)
    shares = dict(zip(classes.tolist(), (counts / max(len(y), 1)).tolist()))
    if len(classes) < 2:
        return Classifier(classes.tolist() or [0], None), shares or {0: 1.0}
    x = np.frombuffer(b"".join(found.column(1).to_pylist()), np.float32).reshape(len(y), -1).astype(np.float64)
    order = np.lexsort(x.T[::-1][-4:])
    x, y = x[order], y[order]
    rest = [_logistic(x, (y == c).astype(float), penalty) for c in (classes[1:] if len(classes) == 2 else classes)]
    if len(classes) == 2:
        rest.insert(0, -rest[0])
    return Classifier(classes.tolist(), np.array(rest)), shares


def _weights(given: dict | None, fallback: dict) -> dict:
    found = {k: max(float((given or fallback).get(k, 0.0)), 0.0) for k in fallback}
    total = sum(found.values())
    return {k: v / total for k, v in found.items()} if total else fallback


def fit_rates(
    docs: DataFrame,
    labels: DataFrame,
    source_weights: dict | None = None,
    class_weights: dict | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    steps: int = STEPS,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """__vf_uid, id, source, n_tokens, posteriors (array, by class), rate, copies per row."""
    classifier, shares = fit_classifier(docs, labels, id_col=id_col, text_col=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache(None)
        for batch in sliced(batches):
            texts = binaries(batch.column(3))
            n = [len(t.split()) for t in texts]
            p = [classifier.posteriors(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(3)), pa.array(n, pa.int64()), pa.array(p, pa.list_(pa.float64()))], ["uid", "id", "source", "n", "p"]
            )

    rows = with_uid(docs).select(F.col(UID).alias("uid"), F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col))
    known = stage(rows.mapInArrow(run, "uid long, id long, source string, n long, p array<double>"), "mix-posteriors")
    best = max(shares)
    halved = {c: shares[c] / 2 + (0.5 if c == best else 0.0) for c in classifier.classes} if len(shares) > 1 else {c: 1.0 for c in classifier.classes}
    by_class = _weights(class_weights, halved)
    sizes = stage(known.groupBy("source").agg(F.sum("n").alias("n")), "mix-sources")
    if sizes.limit(MAX_SOURCES + 1).count() > MAX_SOURCES:
        state = _joined_rates(known, sizes, source_weights, [by_class[c] for c in classifier.classes], steps, tolerance)
    else:
        state = _listed_rates(known, sizes, source_weights, [by_class[c] for c in classifier.classes], steps, tolerance)
    part = F.pmod(F.xxhash64("id", F.lit("copies")), F.lit(1 << 53)) / float(1 << 53)
    rated = state.select(F.col("uid").alias("r_uid"), F.col("r").alias("rate"))
    return known.join(rated, F.col("uid") == F.col("r_uid")).select(
        F.col("uid").alias(UID),
        "id",
        "source",
        F.col("n").alias("n_tokens"),
        F.col("p").alias("posteriors"),
        "rate",
        (F.floor("rate") + (part < F.col("rate") - F.floor("rate")).cast("long")).alias("copies"),
    )


def _listed_rates(known: DataFrame, sizes: DataFrame, source_weights: dict | None, by_class: list[float], steps: int, tolerance: float) -> DataFrame:
    """uid and rate r, with the domains' totals, targets and gaps as arrays."""
    names = [r.source for r in sizes.orderBy(F.desc("n"), F.col("source").asc_nulls_first()).collect()]
    listed = as_table(known.sparkSession, {"s_name": pa.array(names, pa.string()), "s": pa.array(range(len(names)), pa.int32())})
    state = known.join(F.broadcast(listed), F.col("source").eqNullSafe(F.col("s_name")))
    k = len(by_class)
    state = state.select("uid", "s", "n", "p", F.lit(1.0).alias("r"))

    def totals(state: DataFrame) -> np.ndarray:
        out = np.zeros((len(names), k))
        for row in state.groupBy("s").agg(*(F.sum(F.col("n") * F.col("p")[c] * F.col("r")).alias(f"t{c}") for c in range(k))).collect():
            out[row.s] = [x or 0.0 for x in row[1:]]
        return out

    whole = totals(state)
    used = whole.sum(1) > 0
    by_source = _weights(
        None if source_weights is None else {i: source_weights.get(name, 0.0) for i, name in enumerate(names)},
        dict(enumerate(np.where(used, whole.sum(1) ** TEMPER, 0.0).tolist())),
    )
    target = np.outer([by_source[i] for i in range(len(names))], by_class) * whole.sum()
    scale = np.where(whole > 0, whole, 1.0)
    now = whole
    for _ in range(steps):
        gap = np.where(whole > 0, (now - target) / scale, 0.0)
        if not used.any() or np.abs(now - target)[whole > 0].max() <= tolerance * target.max():
            break
        push = F.lit(0.0)
        table = F.array(*(F.array(*map(F.lit, row)) for row in gap.tolist()))
        for c in range(k):
            push = push + F.col("p")[c] * table[F.col("s")][c]
        new = stage(state.select("uid", "s", "n", "p", F.greatest(F.lit(0.0), F.col("r") - push).alias("r")), "mix-rates")
        drop_staged(state)
        state = new
        now = totals(state)
    return state


def _joined_rates(known: DataFrame, sizes: DataFrame, source_weights: dict | None, by_class: list[float], steps: int, tolerance: float) -> DataFrame:
    """uid and rate r, with the domains' totals, targets and gaps as a table by source."""
    k = len(by_class)
    fallback = sizes.withColumn("weight", F.when(F.col("n") > 0, F.pow(F.col("n").cast("double"), F.lit(TEMPER))).otherwise(0.0))
    weighted = fallback
    if source_weights is not None:
        weights = [max(float(w), 0.0) for w in source_weights.values()]
        given = as_table(known.sparkSession, {"g_source": pa.array(list(source_weights), pa.string()), "g_weight": pa.array(weights, pa.float64())})
        own = sizes.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("g_source")), "left").withColumn("weight", F.coalesce("g_weight", F.lit(0.0)))
        weighted = own if own.agg(F.sum("weight")).first()[0] else fallback
    share, tokens = weighted.agg(F.sum("weight"), F.sum("n")).first()
    targets = weighted.withColumn("s", F.monotonically_increasing_id()).select(
        "s", F.col("source").alias("s_name"), F.array(*(F.col("weight") / (share or 1.0) * (w * (tokens or 0)) for w in by_class)).alias("target")
    )
    targets = stage(targets, "mix-targets")
    most = targets.agg(F.max(F.array_max("target"))).first()[0]
    state = known.join(few(targets.select("s", "s_name")), F.col("source").eqNullSafe(F.col("s_name"))).select("uid", "s", "n", "p", F.lit(1.0).alias("r"))
    state = stage(state, "mix-rates")

    def totals(state: DataFrame) -> DataFrame:
        sums = (F.coalesce(F.sum(F.col("n") * F.col("p")[c] * F.col("r")), F.lit(0.0)) for c in range(k))
        return state.groupBy("s").agg(F.array(*sums).alias("now"))

    whole = stage(totals(state).withColumnRenamed("now", "whole"), "mix-whole")
    for _ in range(steps):
        domains = whole.join(totals(state), "s").join(targets.select("s", "target"), "s")
        places = [(F.col("whole")[c], F.col("now")[c] - F.col("target")[c]) for c in range(k)]
        gaps = F.array(*(F.when(w > 0, off / w).otherwise(0.0) for w, off in places)).alias("gap")
        off = F.array_max(F.array(*(F.when(w > 0, F.abs(off)).otherwise(0.0) for w, off in places))).alias("off")
        domains = stage(domains.select(F.col("s").alias("d"), gaps, off), "mix-gaps")
        if not tokens or domains.agg(F.max("off")).first()[0] <= tolerance * most:
            break
        push = F.lit(0.0)
        for c in range(k):
            push = push + F.col("p")[c] * F.col("gap")[c]
        moved = state.join(few(domains.select("d", "gap")), F.col("s") == F.col("d"))
        new = stage(moved.select("uid", "s", "n", "p", F.greatest(F.lit(0.0), F.col("r") - push).alias("r")), "mix-rates")
        drop_staged(state, domains)
        state = new
    return state


def mixed(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all their columns, each as many times as the mix asks."""
    rows = identified(docs)
    rated = fit_rates(rows, labels, **options)
    other = stage(rated.where("copies <> 1").select(F.col(UID).alias("__vf_k"), F.col("copies").alias("__vf_copies")), "mix-copies")
    copies = F.coalesce("__vf_copies", F.lit(1).cast("long"))
    once = F.array_repeat(F.lit(1), copies.cast("int"))
    return decided(rows, other, "left").withColumn("__vf_copy", F.explode(once)).select(*(rows[c] for c in docs.columns))


def mixing(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, source, n_tokens, posterior of the best class, rate and copies for every row."""
    return fit_rates(docs, labels).select(
        F.col("id").alias("doc_id"), "source", "n_tokens", F.element_at("posteriors", -1).alias("posterior"), "rate", "copies"
    )
