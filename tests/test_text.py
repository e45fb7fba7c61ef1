"""Text functions against plain Python."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verifolio.functions import text as T

FOLD = dict(zip(T.FOLD_FROM, T.FOLD_TO)) | {T.ELLIPSIS: "..."}


def normalize(s):
    return re.sub(r"\s+", " ", "".join(FOLD.get(c, c) for c in s)).strip().lower()


def gather(strategy, n=500):
    """Examples of a strategy, as rows, so that Spark sees them all at once."""
    out = []

    @settings(max_examples=n, deadline=None, database=None, derandomize=True)
    @given(strategy)
    def collect(x):
        out.append(x)

    collect()
    return out


_odd = st.text(st.sampled_from("aB \t\n\x0b\x0c\r\x1c\x1f\x85\xa0\u1680\u2003\u2007\u2028\u202f\u3000\u2018\u2019\u201c\u2014\u2212\u2026-'\"é日😀") | st.characters(max_codepoint=0x2FF), max_size=30)


def test_normalize_squash_strip(spark):
    texts = gather(_odd)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    c = F.col("t")
    rows = df.select("t", T.normalize(c).alias("n"), T.squash(c).alias("q"), T.strip(c).alias("s"), T.blank(c).alias("b"), T.collapse(c).alias("c")).collect()
    for r in rows:
        assert (r.n, r.q) == (normalize(r.t), normalize(r.t).replace(" ", ""))
        assert (r.s, r.b, r.c) == (r.t.strip(), not r.t.strip(), " ".join(r.t.split()))


def test_lines(spark):
    texts = gather(st.text(st.sampled_from("ab\r\n\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"), max_size=12), 300)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.lines(F.col("t")).alias("l")).collect()
    for r in rows:
        assert [x for x in r.l if x] == [x for x in r.t.splitlines() if x]


def test_list_items(spark):
    cases = {
        "• one\n▪ two": ["one", "two"],
        "- a\\n- b\\r\\n- c": ["a", "b", "c"],
        "plain": ["plain"],
        "•\n-": ["•\n-"],
        "\\tx\n\n– y ": ["x", "y"],
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.list_items(F.col("t")).alias("i")).collect()
    assert {r.t: r.i for r in rows} == cases


def test_percent_and_preview(spark):
    row = spark.range(1).select(
        *(T.percent(F.lit(x)).alias(f"p{i}") for i, x in enumerate((0.005, 0.015, 0.025, 1.0, 0.994))),
        T.preview(F.array(*map(F.lit, "abcde")), 3, ", ").alias("more"),
        T.preview(F.array(F.lit("abcdef")), 3, ", ", 2).alias("cut"),
        T.padded(F.array(F.lit("x")), F.lit(3)).alias("wide"),
        T.padded(F.array(F.lit("x"), F.lit("y")), F.lit(1)).alias("narrow"),
        T.padded(F.array(F.lit("x")), F.lit(0)).alias("none"),
    ).first()
    assert [row.p0, row.p1, row.p2, row.p3, row.p4] == ["0%", "2%", "2%", "100%", "99%"]
    assert (row.more, row.cut) == ("a, b, c (+2 more)", "ab")
    assert (row.wide, row.narrow, row.none) == (["x", "", ""], ["x"], [])


def test_let_computes_once(spark):
    """The normalised text of a lambda is an argument of it, not a part of its body."""
    from verifolio.operators import checks

    df = spark.createDataFrame([("Some words here", "words")], "s string, p string")
    plan = df.select(checks.missing_words(F.col("s"), F.col("p")).alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate") <= 3
