"""Personal data: pattern-based base spans, and bootstrapped contextual extraction.

Base spans (email, ip, card, phone) are the leftmost matches of fixed patterns that pass a
check of their own. They are the seeds. The words around a seed induce lexical patterns:
the two words before it, and the word before with the word after. Looser candidates of
each kind (obfuscated addresses, numbers of an identifier's length) get patterns the same
way. Patterns and instances form a graph that Spark scores in rounds: a pattern's
confidence is the mean score of the distinct instances it extracts, seeds counting 1, with
a prior against it, where their scores sum up to ``MIN_SEEDS`` (seeds alone in the first round,
what was discovered too in later ones); an instance's score is the noisy-or of its confident patterns. In the
end candidates that stand in a pattern of high confidence, and score high themselves,
become spans.

Everything is DataFrame expressions. Each text is scanned once per pattern; what goes on
are narrow rows of matches and the few characters around them, so only they are shuffled.
A gap before each match gives its place by a running sum, so long texts cost no more a
match than short ones. The repeats in the patterns are possessive: they can match nothing
else, and Java's matcher then needs no stack for long runs.

Defined results: null text counts as empty; a row without spans has zero counts and the
digest of the empty string; repeated ids keep their rows; offsets are code points; an
added span never overlaps a base span; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import UID, drop_staged, identified, stage, with_uid

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Pattern, and a string or class without which it cannot match. A match begins where the
#: run of its first class begins, or where the match before it ended.
PATTERNS = {
    "email": (rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++", F.contains, "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", F.rlike, r"[0-9]\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", F.rlike, r"[0-9][\x20-]?[0-9]"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", F.contains, "+"),
}
#: Candidates: addresses with the signs spelled out, and numbers of seven or more digits.
CANDIDATES = {
    "spelled": (
        rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++ ?[(\[]at[)\]] ?{_HOST}++(?: ?(?:[(\[]dot[)\]]|\.) ?{_HOST}++)++",
        F.rlike,
        r"[(\[]at[)\]]",
    ),
    "number": (r"(?<![0-9A-Za-z])[0-9](?:[\x20().-]{0,2}[0-9]){6,}+(?![0-9A-Za-z])", F.rlike, r"[0-9](?:[\x20().-]{0,2}[0-9]){6}"),
}
_TAIL, _HEAD = 60, 40
ROUNDS = 3
MIN_SEEDS = 3
CONFIDENT = 0.8
#: Pseudo-instances that score 0, in every pattern's mean.
PRIOR = 0.5


def _pieces(text: str, pattern: str, guard, sign: str) -> Column:
    """The gap before each match (length, first and last characters) with the match; the
    gap behind the last one has a null match. Null for texts without the sign."""
    gaps = F.split(F.col(text), pattern, -1)
    hits = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    pieces = F.transform(
        F.arrays_zip(gaps.alias("gap"), hits.alias("hit")),
        lambda x: F.struct(
            F.char_length(x["gap"]).alias("gap"),
            F.substring(x["gap"], 1, _HEAD).alias("head"),
            F.right(x["gap"], F.lit(_TAIL)).alias("tail"),
            x["hit"].alias("hit"),
        ),
    )
    return F.when(guard(F.col(text), F.lit(sign)), pieces)


def _digits(hit: str) -> Column:
    return F.regexp_replace(hit, r"[^0-9]", "")


def _valid() -> Column:
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    digits = _digits("hit")
    return (
        F.when(F.col("kind") == "email", True)
        .when(F.col("kind") == "ip", F.rlike("hit", F.lit(rf"^{part}(?:\.{part}){{3}}$")))
        .when(F.col("kind") == "card", F.length(digits).between(12, 19) & F.expr("luhn_check(regexp_replace(hit, '[^0-9]', ''))"))
        .when(F.col("kind") == "phone", F.length(digits).between(9, 15))
        .otherwise(True)
    )


def _candidate_kind() -> Column:
    digits = F.length(_digits("hit"))
    return (
        F.when(F.col("kind") == "spelled", "email")
        .when(F.rlike("hit", F.lit(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$")), "ip")
        .when(digits.between(12, 19), "card")
        .when(digits.between(7, 11), "phone")
    )


def _contexts() -> Column:
    """The lexical patterns of a match, each with a word in it; digits count alike."""

    def words(column: str) -> Column:
        folded = F.lower(F.regexp_replace(F.col(column), "[0-9]", "0"))
        return F.filter(F.split(folded, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    before, after = words("tail"), words("next")
    one = F.element_at(before, -1)
    both = F.when(F.size(before) >= 2, F.concat(F.lit("L "), F.element_at(before, -2), F.lit(" "), one))
    around = F.when((F.size(before) >= 1) & (F.size(after) >= 1), F.concat(F.lit("B "), one, F.lit(" _ "), F.element_at(after, 1)))
    return F.filter(F.array(both, around), lambda x: F.rlike(x, F.lit(r"[ _]\p{L}{2}")))


def _matches(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(uid, id) of all rows, and their matches: uid, kind, start, stop, hit, contexts."""
    rows = with_uid(docs).select(F.col(UID).alias("uid"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    every = PATTERNS | CANDIDATES
    scanned = stage(rows.select("uid", "id", *(_pieces("text", *spec).alias(kind) for kind, spec in every.items())), "pii-scan")
    parts = None
    for kind in every:
        one = scanned.where(F.size(kind) > 1).select("uid", F.lit(kind).alias("kind"), F.posexplode(kind).alias("k", "p")).select("uid", "kind", "k", "p.*")
        parts = one if parts is None else parts.unionByName(one)
    order = Window.partitionBy("uid", "kind").orderBy("k")
    length = F.coalesce(F.char_length("hit"), F.lit(0))
    placed = (
        parts.withColumn("stop", F.sum(F.col("gap") + length).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("next", F.lead("head").over(order))
        .where("hit is not null")
        .where(_valid())
    )
    found = placed.select("uid", "kind", (F.col("stop") - length).alias("start"), "stop", "hit", _contexts().alias("contexts"))
    return scanned, stage(found, "pii-matches")


def _joined(spans: str) -> Column:
    ordered = F.array_sort(spans)
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _place() -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")


def _span() -> Column:
    return F.struct("start", _place().alias("place"), "kind", "stop")


def discover(matches: DataFrame, base: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, confident: float = CONFIDENT) -> DataFrame:
    """Spans (uid, kind, start, stop, confidence) that confident patterns add to the base spans.

    ``base``: uid and the array ``spans`` of its base spans."""
    seeds = matches.where(F.col("kind").isin(*KINDS)).select("kind", "hit", "contexts", F.lit(1.0).alias("seed"))
    loose = matches.where(~F.col("kind").isin(*KINDS)).withColumn("kind", _candidate_kind()).where("kind is not null")
    free = (
        loose.join(base.withColumnRenamed("uid", "b_uid"), F.col("uid") == F.col("b_uid"), "left")
        .where(F.col("spans").isNull() | ~F.exists("spans", lambda s: (s["start"] < F.col("stop")) & (s["stop"] > F.col("start"))))
        .select("uid", "kind", "start", "stop", "hit", "contexts")
    )
    free = stage(free, "pii-free")
    both = seeds.unionByName(free.select("kind", "hit", "contexts", F.lit(0.0).alias("seed")))
    edges = stage(
        both.select("kind", F.lower("hit").alias("instance"), "seed", F.explode("contexts").alias("pattern"))
        .groupBy("kind", "pattern", "instance")
        .agg(F.max("seed").alias("seed")),
        "pii-graph",
    )
    scores = None
    for _ in range(rounds):
        if scores is None:
            scored = edges.withColumn("score", F.col("seed"))
        else:
            scored = edges.join(scores, ["kind", "instance"], "left").withColumn("score", F.greatest("seed", F.coalesce("reached", F.lit(0.0))))
        patterns = stage(
            scored.groupBy("kind", "pattern")
            .agg(F.sum("score").alias("support"), (F.sum("score") / (F.count(F.lit(1)) + PRIOR)).alias("confidence"))
            .where(F.col("support") >= min_seeds)
            .where(F.col("confidence") >= confident / 2)
            .select("kind", "pattern", "confidence"),
            "pii-patterns",
        )
        reached = edges.join(patterns, ["kind", "pattern"]).groupBy("kind", "instance")
        last = scores
        scores = stage(reached.agg((1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))).alias("reached")), "pii-scores")
        if last is not None:
            drop_staged(last, before)
        before = patterns
    chosen = patterns.where(F.col("confidence") >= confident)
    hits = free.withColumn("instance", F.lower("hit")).select("*", F.explode("contexts").alias("pattern"))
    return (
        hits.join(chosen, ["kind", "pattern"])
        .join(scores, ["kind", "instance"])
        .where(F.col("reached") >= confident)
        .groupBy("uid", "kind", "start", "stop")
        .agg(F.max("confidence").alias("confidence"))
    )


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """uid, id, base spans and all spans (arrays of start, place, kind, stop) for every row."""
    rows, matches = _matches(docs, id_col, text_col)
    base = stage(matches.where(F.col("kind").isin(*KINDS)).groupBy("uid").agg(F.collect_list(_span()).alias("spans")), "pii-base")
    added = discover(matches, base).groupBy("uid").agg(F.collect_list(_span()).alias("added"))
    added = stage(added.withColumnRenamed("uid", "a_uid"), "pii-added")
    out = rows.select("uid", "id").join(base.withColumnRenamed("uid", "b_uid"), F.col("uid") == F.col("b_uid"), "left")
    out = out.join(added, F.col("uid") == F.col("a_uid"), "left")
    none = F.array().cast(base.schema["spans"].dataType)
    return out.select("uid", "id", F.coalesce("spans", none).alias("base"), F.concat(F.coalesce("spans", none), F.coalesce("added", none)).alias("spans"))


def pii_digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans for every row of docs."""

    def of(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [of(kind) for kind in KINDS]
    return find_pii(docs).select(
        F.col("id").alias("doc_id"), *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans")
    )


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """uid, id and the text with every span replaced by its kind in brackets."""
    staged = identified(docs.select(id_col, text_col))
    found = find_pii(staged, id_col, text_col).select("uid", F.array_sort("spans").alias("spans"))
    rows = staged.select(F.col(UID).alias("m_uid"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    put = lambda a, s: F.when(
        s["start"] >= a["at"],
        F.struct(F.concat(a["out"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]")).alias("out"), s["stop"].alias("at")),
    ).otherwise(a)
    end = lambda a: F.concat(a["out"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.lit(2147483647)))
    return rows.join(found, F.col("m_uid") == F.col("uid")).select("uid", "id", F.aggregate("spans", start, put, end).alias("text"))
