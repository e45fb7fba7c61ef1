"""Registered queries of the engine's operators, each with SQL that gives the same rows.

The tables of the data folder stand in for page content by fixed arithmetic, the same in
Spark and SQL: a document's lines get coordinates and font sizes from their number, an
extraction is the document without every line whose ``(line * 7 + doc) % 10`` is 0, and
grids come from parts and nations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import schema
from .functions import text as T
from .operators import checks, repair, select, spatial
from .plans import markdown, ordered, sheet, word
from .session import spread, table
from .sinks import office as sinks
from .sources import history, office, pdf, providers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


# --- SQL fragments ---------------------------------------------------------------------

_WS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_TO = T.FOLD_TO.replace("'", "''")


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'))"


def _n(x: str) -> str:
    folded = f"replace(translate({x}, '{T.FOLD_FROM}', '{_TO}'), '{T.ELLIPSIS}', '...')"
    return f"lower({_collapse(folded)})"


def _q(x: str) -> str:
    return f"replace({_n(x)}, ' ', '')"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


_EXTRACTED = "array_to_string([x for x, i in string_split(text, chr(10)) if ((i - 1) * 7 + doc_id) % 10 <> 0], chr(10))"
_PAIR = f"pair AS (SELECT doc_id, text AS src, {_EXTRACTED} AS got FROM documents)"
_NORMED = f"{_PAIR}, normed AS (SELECT doc_id, src, {_n('src')} AS ns, {_q('got')} AS qg FROM pair)"
_WORDS = f"{_NORMED}, words AS (SELECT *, list_distinct([w for w in string_split(ns, ' ') if length(w) > 3]) AS ws FROM normed)"
_MISSING = f"{_WORDS}, gone AS (SELECT *, list_sort([w for w in ws if NOT contains(qg, w)]) AS lost FROM words)"
_LINES = (
    "raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents), "
    "lines AS (SELECT doc_id, 1 AS page_no, line, text, 8.0 + (doc_id + line) % 5 AS size, 72.0 + (line % 3) * 40 AS x0, "
    "72.0 + (line % 3) * 40 + least(length(text), 90) * 4 AS x1, 12.0 * (line // 2) AS y0, 12.0 * (line // 2) + 10 AS y1 "
    f"FROM raw WHERE length({_collapse('text')}) > 0)"
)
_BLOCK_TEXT = "CASE WHEN line % 4 = 1 THEN replace(l.text, 'e', 'q') ELSE l.text END"
_BLOCKS = f"{_LINES}, blocks AS (SELECT l.doc_id, line AS block_ord, {_BLOCK_TEXT} AS text, {_n('d.text')} AS ns FROM lines l JOIN documents d USING (doc_id))"
_SHARE = "CASE WHEN len(ws) > 0 THEN len([w for w in ws if contains(ns, w)])::DOUBLE / len(ws) ELSE 0 END"
_JUDGED = (
    f"{_BLOCKS}, cut AS (SELECT *, [w for w in string_split({_n('text')}, ' ') if length(w) > 3] AS ws FROM blocks), "
    f"judged AS (SELECT *, contains(replace(ns, ' ', ''), {_q('text')}) AS held, {_SHARE} AS share FROM cut)"
)
_PART_TABLES = (
    "tables AS (SELECT p_partkey // 20 AS doc_id, list([p_partkey::VARCHAR, p_name, p_type] ORDER BY p_partkey) AS rows FROM part GROUP BY ALL), "
    "faulty AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN [] ELSE [CASE WHEN (doc_id + i - 1) % 9 <> 0 THEN r ELSE r[1:2] END for r, i in rows] END AS rows, "
    "len(rows) + (doc_id % 3 = 0)::INT AS n_data_rows, doc_id % 4 <> 0 AS has_header, "
    "CASE WHEN doc_id % 5 = 0 THEN ['Key', 'Name'] ELSE ['Key', 'Name', 'Type'] END AS header FROM tables)"
)
_NATIONS = (
    "cells AS (SELECT n_regionkey AS doc_id, list([n_nationkey::VARCHAR, n_name] ORDER BY n_nationkey) AS grid, "
    "list([n_nationkey::VARCHAR, n_name] ORDER BY n_nationkey) FILTER (n_nationkey % 7 <> 0) AS rows FROM nation GROUP BY ALL)"
)


# --- Derived tables ----------------------------------------------------------------------


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as pages: source_text, and what a lossy extraction kept of it."""
    d = _documents(spark, sf)
    kept = F.filter(F.split("text", "\n"), lambda x, i: (i * 7 + F.col("doc_id")) % 10 != 0)
    return d.select("doc_id", F.lit(1).alias("page_no"), F.col("text").alias("source_text"), F.array_join(kept, "\n").alias("produced"))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    d = _documents(spark, sf)
    raw = d.select("doc_id", F.lit(1).alias("page_no"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    kept = raw.where(~T.blank(F.col("text")))
    x0 = 72.0 + (F.col("line") % 3) * 40
    y0 = 12.0 * F.floor(F.col("line") / 2)
    return kept.select(
        "doc_id",
        "page_no",
        "line",
        F.col("line").alias("ord"),
        "text",
        (8.0 + (F.col("doc_id") + F.col("line")) % 5).alias("size"),
        x0.alias("x0"),
        (x0 + F.least(F.length("text"), F.lit(90)) * 4).alias("x1"),
        y0.alias("y0"),
        (y0 + 10).alias("y1"),
        (F.col("line") % 6 == 0).alias("bold"),
    )


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as text blocks, a quarter of them misread."""
    text = F.when(F.col("line") % 4 == 1, F.replace("text", F.lit("e"), F.lit("q"))).otherwise(F.col("text"))
    return _lines(spark, sf).select("doc_id", "page_no", F.col("line").alias("block_ord"), F.lit("paragraph").alias("kind"), text.alias("text"), *_no_table())


def _block_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The same blocks as arrays in their page's row, with its source text."""
    misread = lambda x, i: F.when(i % 4 == 1, F.replace(x, F.lit("e"), F.lit("q"))).otherwise(x)
    none = F.lit(None)
    block = lambda x, i: F.struct(
        i.alias("block_ord"), F.lit("paragraph").alias("kind"), misread(x, i).alias("text"), none.cast("array<string>").alias("header"), none.cast("array<array<string>>").alias("rows")
    )
    bs = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.when(~T.blank(x), block(x, i))), lambda b: b.isNotNull())
    return _documents(spark, sf).select("doc_id", F.lit(1).alias("page_no"), F.col("text").alias("source_text"), bs.alias("bs"))


def _no_table() -> list:
    none = F.lit(None)
    return [
        F.lit("left").alias("align"),
        F.lit("normal").alias("size"),
        F.lit(False).alias("bold"),
        none.cast("boolean").alias("has_header"),
        none.cast("int").alias("n_data_rows"),
        none.cast("int").alias("n_cols"),
        none.cast("array<string>").alias("header"),
        none.cast("array<array<string>>").alias("rows"),
    ]


def _part_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty parts a table, some of them with faults."""
    p = table(spark, sf, "part")
    row = F.struct("p_partkey", F.array(F.col("p_partkey").cast("string"), "p_name", "p_type").alias("r"))
    grouped = p.groupBy(F.floor(F.col("p_partkey") / 20).alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["r"]).alias("all"))
    d = F.col("doc_id")
    ragged = F.transform("all", lambda r, i: F.when((d + i) % 9 != 0, r).otherwise(F.slice(r, 1, 2)))
    return grouped.select(
        "doc_id",
        F.lit(1).alias("page_no"),
        F.lit(0).alias("block_ord"),
        F.lit("table").alias("kind"),
        F.lit(None).cast("string").alias("text"),
        (d % 4 != 0).alias("has_header"),
        (F.size("all") + (d % 3 == 0).cast("int")).alias("n_data_rows"),
        F.lit(3).alias("n_cols"),
        F.when(d % 5 == 0, F.array(F.lit("Key"), F.lit("Name"))).otherwise(F.array(F.lit("Key"), F.lit("Name"), F.lit("Type"))).alias("header"),
        F.when(d % 7 == 0, F.array().cast("array<array<string>>")).otherwise(ragged).alias("rows"),
    )


def _nation_tables(spark: SparkSession, sf: str) -> DataFrame:
    """A region's nations as a detected grid, and as an extracted table without some rows."""
    n = table(spark, sf, "nation")
    row = F.struct("n_nationkey", F.array(F.col("n_nationkey").cast("string"), "n_name").alias("r"))
    grouped = n.groupBy(F.col("n_regionkey").alias("doc_id")).agg(F.array_sort(F.collect_list(row)).alias("all"))
    pick = lambda xs: F.transform(xs, lambda x: x["r"])
    return grouped.select(
        "doc_id",
        F.lit(1).alias("page_no"),
        F.lit(0).alias("block_ord"),
        F.lit("table").alias("kind"),
        F.lit(False).alias("has_header"),
        F.lit(2).alias("n_cols"),
        F.array().cast("array<string>").alias("header"),
        pick(F.filter("all", lambda x: x["n_nationkey"] % 7 != 0)).alias("rows"),
        pick("all").alias("grid"),
        F.lit(2).alias("col_count"),
    ).withColumn("n_data_rows", F.size("rows"))


def _doc_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as pages of text blocks: the first line a heading, the fourth a list, the fifth a caption."""
    d = _documents(spark, sf)
    kinds = lambda i: F.when(i == 0, "heading").when(i == 3, "list").when(i == 4, "caption").otherwise("paragraph")
    sizes = lambda i: F.when(i == 0, "large").when(i % 5 == 4, "small").otherwise("normal")
    block = lambda x, i: F.struct(kinds(i).alias("kind"), x.alias("text"), F.lit("left").alias("align"), sizes(i).alias("size"), (i == 0).alias("bold"), *_no_table()[3:])
    return d.select(F.col("doc_id"), F.lit(1).alias("page_no"), F.transform(F.split("text", "\n"), block).alias("blocks"))


def _pictures(spark: SparkSession, sf: str) -> DataFrame:
    d = _documents(spark, sf)
    return d.select(
        "doc_id",
        F.lit(1).alias("page_no"),
        F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int"))).alias("ord"),
        (F.col("doc_id") % 10 / 10.0).alias("frac_above"),
        (F.col("doc_id") % 9 * 1.0).alias("width_in"),
        (F.col("doc_id") % 7 * 1.5).alias("height_in"),
        (F.col("doc_id") % 5 * 40).cast("int").alias("px_w"),
        (F.col("doc_id") % 4 * 30).cast("int").alias("px_h"),
        F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"),
    )


# --- Text ----------------------------------------------------------------------------------


@query(f"SELECT doc_id, {_n('text')} AS normalized FROM documents")
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select("doc_id", T.normalize(F.col("text")).alias("normalized"))


@query(f"SELECT doc_id, {_q('text')} AS squashed FROM documents")
def squash_text(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select("doc_id", T.squash(F.col("text")).alias("squashed"))


@query(rf"SELECT page_id, {_n('html')} AS normalized, {_strip('html')} AS stripped FROM pages")
def normalize_pages(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    return p.select("page_id", T.normalize(F.col("html")).alias("normalized"), T.strip(F.col("html")).alias("stripped"))


_EOL_SQL = r"\r\n|[\x0A-\x0D\x1C-\x1E\x{85}\x{2028}\x{2029}]"


@query(
    rf"""
    WITH u AS (SELECT doc_id, replace(replace(replace(replace(text, '. ', chr(92) || 'n- '), chr(92) || 'r' || chr(92) || 'n', chr(10)), chr(92) || 'n', chr(10)), chr(92) || 't', chr(9)) AS t,
               replace(text, '. ', chr(92) || 'n- ') AS whole FROM documents),
    i AS (SELECT doc_id, whole, [x for x in [trim(y, ' •◦▪-–' || chr(9)) for y in regexp_split_to_array(t, '{_EOL_SQL}')] if x <> ''] AS xs FROM u)
    SELECT doc_id, len(CASE WHEN len(xs) > 0 THEN xs ELSE [whole] END)::BIGINT AS n, array_to_string(CASE WHEN len(xs) > 0 THEN xs ELSE [whole] END, '|') AS items FROM i
    """
)
def list_splitting(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as list blocks: real line ends, and sentences written as items with
    spelled-out ones."""
    items = T.list_items(F.replace("text", F.lit(". "), F.lit("\\n- ")))
    return _documents(spark, sf).select("doc_id", F.size(items).cast("long").alias("n"), F.array_join(items, "|").alias("items"))


# --- Coverage --------------------------------------------------------------------------------


@query(
    f"""WITH {_MISSING} SELECT doc_id, len(ws)::BIGINT AS n_words, len(lost)::BIGINT AS n_missing,
    CASE WHEN ns = '' THEN NULL WHEN len(ws) = 0 THEN 1.0 ELSE round_even(1 - len(lost)::DOUBLE / len(ws), 6) END AS coverage FROM gone"""
)
def word_coverage(spark: SparkSession, sf: str) -> DataFrame:
    found = checks.coverage(_pairs(spark, sf), "source_text", "produced")
    return found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.size("missing").cast("long").alias("n_missing"), F.bround("coverage", 6).alias("coverage"))


@query(
    f"""WITH {_MISSING} SELECT doc_id, array_to_string(lost[1:8], ', ') || CASE WHEN len(lost) > 8 THEN ' (+' || (len(lost) - 8) || ' more)' ELSE '' END AS shown
    FROM gone WHERE len(lost) > 0"""
)
def missing_words_top8(spark: SparkSession, sf: str) -> DataFrame:
    found = checks.coverage(_pairs(spark, sf), "source_text", "produced").where(F.size("missing") > 0)
    return found.select("doc_id", T.preview(F.col("missing"), 8, ", ").alias("shown"))


_GONE_LINES = (
    f"{_WORDS}, raw AS (SELECT doc_id, qg, unnest(string_split(src, chr(10))) AS raw, generate_subscripts(string_split(src, chr(10)), 1) - 1 AS ord FROM words WHERE len(ws) > 0), "
    f"keyed AS (SELECT *, {_n('raw')} AS key FROM raw), "
    "first AS (SELECT doc_id, key, min(ord) AS ord, arg_min(raw, ord) AS raw FROM keyed WHERE length(key) >= 8 AND NOT contains(qg, replace(key, ' ', '')) GROUP BY doc_id, key)"
)


@query(f"WITH {_GONE_LINES} SELECT doc_id, ord::BIGINT AS ord, {_strip('raw')} AS line FROM first")
def missing_lines(spark: SparkSession, sf: str) -> DataFrame:
    found = checks.missing_lines(_pairs(spark, sf), "source_text", "produced")
    return found.select("doc_id", F.col("ord").cast("long").alias("ord"), "line")


@query(
    f"""WITH {_GONE_LINES}, gone AS (SELECT *, list_sort([w for w in ws if NOT contains(qg, w)]) AS lost FROM words),
    share AS (SELECT *, CASE WHEN ns = '' THEN NULL WHEN len(ws) = 0 THEN 1.0 ELSE 1 - len(lost)::DOUBLE / len(ws) END AS c FROM gone),
    listed AS (SELECT doc_id, list({_strip('raw')} ORDER BY ord) AS ls FROM first GROUP BY doc_id)
    SELECT doc_id, 'problem' AS severity, round_even(c * 100, 0)::BIGINT || '% of the words are there, ' || len(lost) || ' missing: ' || array_to_string(lost[1:8], ', ')
           || CASE WHEN len(lost) > 8 THEN ' (+' || (len(lost) - 8) || ' more)' ELSE '' END AS message FROM share WHERE c < 0.95
    UNION ALL SELECT doc_id, 'problem', len(ls) || ' line(s) missing: ' || array_to_string([substr(x, 1, 50) for x in ls[1:4]], '; ')
           || CASE WHEN len(ls) > 4 THEN ' (+' || (len(ls) - 4) || ' more)' ELSE '' END FROM listed"""
)
def coverage_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that lost words beyond the threshold, and pages that lost whole lines."""
    return checks.coverage_findings(_pairs(spark, sf), "source_text", "produced").select("doc_id", "severity", "message")


# --- Grounding --------------------------------------------------------------------------------


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select("doc_id", F.lit(1).alias("page_no"), F.col("text").alias("source_text"))


@query(f"WITH {_JUDGED} SELECT doc_id, sum((held OR share >= 0.9)::INT)::BIGINT AS found, count(*)::BIGINT AS total FROM judged GROUP BY doc_id")
def grounding_share(spark: SparkSession, sf: str) -> DataFrame:
    found = checks.grounding(None, _block_pages(spark, sf), "source_text")
    return checks.grounding_share(found).select("doc_id", "found", "total")


@query(
    f"""WITH {_JUDGED} SELECT doc_id, block_ord::BIGINT AS block_ord,
    'block[' || block_ord || '] kind=paragraph: text not in the source (' || round_even(share * 100, 0)::BIGINT || '% of its words are)' AS message
    FROM judged WHERE NOT held AND share < 0.9"""
)
def grounding_word_fallback(spark: SparkSession, sf: str) -> DataFrame:
    found = checks.grounding(None, _block_pages(spark, sf), "source_text").where("message is not null")
    return found.select("doc_id", F.col("block_ord").cast("long").alias("block_ord"), "message")


@query(f"WITH {_JUDGED} SELECT doc_id, block_ord::BIGINT AS block_ord FROM judged WHERE NOT held AND share < 0.9")
def ungrounded_text(spark: SparkSession, sf: str) -> DataFrame:
    found = checks.ungrounded_text(None, _block_pages(spark, sf), "source_text")
    return found.select("doc_id", F.col("block_ord").cast("long").alias("block_ord"))


@query(
    f"""WITH {_JUDGED} SELECT doc_id, count(*)::BIGINT AS n_blocks FROM judged WHERE NOT (NOT held AND share < 0.9 AND doc_id % 2 = 0) GROUP BY doc_id"""
)
def hallucination_drop(spark: SparkSession, sf: str) -> DataFrame:
    """Misread blocks go on pages with pictures, here those of even documents."""
    images = _sources(spark, sf).where("doc_id % 2 = 0")
    kept = checks.drop_hallucinated(_blocks(spark, sf), _sources(spark, sf), "source_text", images)
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_blocks"))


_PART_SOURCE = (
    "src AS (SELECT p_partkey // 20 AS doc_id, "
    f"string_agg(CASE WHEN (p_partkey // 20) % 4 = 1 THEN 'nothing of it' ELSE p_partkey || ' ' || p_name END, chr(10) ORDER BY p_partkey) AS text FROM part GROUP BY ALL), "
    f"n AS (SELECT doc_id, {_n('text')} AS ns FROM src)"
)


@query(
    f"""WITH {_PART_TABLES}, {_PART_SOURCE},
    c AS (SELECT doc_id, ns, string_split(ns, ' ') AS sw, unnest(list_concat(header, flatten(rows))) AS cell FROM faulty JOIN n USING (doc_id)),
    g AS (SELECT doc_id, (len([p for p in string_split({_n('cell')}, ' ') if p <> '' AND NOT list_contains(sw, p)]) = 0
                 OR (length({_n('cell')}) > 8 AND contains(replace(ns, ' ', ''), {_q('cell')}))) AS ok FROM c WHERE length({_collapse('cell')}) > 0)
    SELECT doc_id, count(*)::BIGINT AS cells, sum((NOT ok)::INT)::BIGINT AS gone, sum((NOT ok)::INT)::DOUBLE / count(*) >= 0.8 AS flagged FROM g GROUP BY doc_id"""
)
def ungrounded_tables(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    line = F.when(F.floor(F.col("p_partkey") / 20) % 4 == 1, "nothing of it").otherwise(F.concat(F.col("p_partkey").cast("string"), F.lit(" "), F.col("p_name")))
    grouped = p.groupBy(F.floor(F.col("p_partkey") / 20).alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("l")))).alias("ls"))
    pages = grouped.select("doc_id", F.lit(1).alias("page_no"), F.array_join(F.transform("ls", lambda x: x["l"]), "\n").alias("source_text"))
    found = checks.ungrounded_cells(_part_tables(spark, sf), pages, "source_text")
    flagged = (F.col("gone") / F.col("cells") >= checks.UNGROUNDED_CELLS).alias("flagged")
    return found.select("doc_id", F.col("cells").cast("long"), F.col("gone").cast("long"), flagged)


# --- Structure, routing, verdicts ---------------------------------------------------------------


@query(
    f"""WITH {_PART_TABLES}, f AS (
      SELECT doc_id, 'table without rows' AS m FROM faulty WHERE len(rows) = 0
      UNION ALL SELECT doc_id, 'claims ' || n_data_rows || ' rows, has ' || len(rows) FROM faulty WHERE len(rows) > 0 AND len(rows) <> n_data_rows
      UNION ALL SELECT doc_id, 'claims 3 columns, header has ' || len(header) FROM faulty WHERE len(rows) > 0 AND has_header AND len(header) <> 3
      UNION ALL SELECT doc_id, 'claims no header, has ' || len(header) || ' labels' FROM faulty WHERE len(rows) > 0 AND NOT has_header
      UNION ALL SELECT doc_id, 'claims 3 columns, rows differ: ' || array_to_string([(i - 1) || ':' || len(r) for r, i in rows if len(r) <> 3], ', ')
                FROM faulty WHERE len(rows) > 0 AND len([1 for r in rows if len(r) <> 3]) > 0)
    SELECT doc_id, 'problem' AS severity, 'block[0] kind=table: ' || m AS message FROM f"""
)
def structure_findings(spark: SparkSession, sf: str) -> DataFrame:
    return checks.block_structure(_part_tables(spark, sf)).select("doc_id", "severity", "message")


_ROUTED = (
    "pages AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN ' ' || chr(10) || chr(160) ELSE text END AS s, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE text END AS o FROM documents), "
    f"t AS (SELECT *, length({_collapse('s')}) = 0 AS scanned, length({_collapse(chr(39) * 2 + ' || coalesce(o, ' + chr(39) * 2 + ')')}) = 0 AS no_ocr FROM pages)"
)


def _routed(spark: SparkSession, sf: str) -> DataFrame:
    d = _documents(spark, sf)
    pages = d.select(
        "doc_id",
        F.lit(1).alias("page_no"),
        F.when(F.col("doc_id") % 5 == 0, " \n ").otherwise(F.col("text")).alias("source_text"),
        F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.col("text")).alias("ocr_text"),
    )
    return select.route_pages(pages, "both")


@query(
    f"""WITH {_ROUTED} SELECT doc_id, scanned, CASE WHEN NOT scanned THEN 'pdf' WHEN NOT no_ocr THEN 'ocr' ELSE 'none' END AS verify_trust,
    CASE WHEN scanned THEN 'separate' ELSE 'embed' END AS image_use,
    length(CASE WHEN NOT scanned THEN s WHEN NOT no_ocr THEN o ELSE '' END)::BIGINT AS n_verify FROM t"""
)
def trust_router(spark: SparkSession, sf: str) -> DataFrame:
    return _routed(spark, sf).select("doc_id", "scanned", "verify_trust", "image_use", F.length("verify_text").cast("long").alias("n_verify"))


@query(
    f"""WITH {_ROUTED} SELECT doc_id, NOT scanned AS repair_lines, NOT (scanned AND NOT no_ocr) AS repair_rows, NOT scanned AS measure_look, scanned AND NOT no_ocr AS report_lines FROM t"""
)
def repair_policy(spark: SparkSession, sf: str) -> DataFrame:
    return repair.repair_policy(_routed(spark, sf)).select("doc_id", "repair_lines", "repair_rows", "measure_look", "report_lines")


@query(
    f"""WITH {_MISSING}, v AS (SELECT doc_id, doc_id % 4 AS k, CASE WHEN ns = '' THEN NULL WHEN len(ws) = 0 THEN 1.0 ELSE 1 - len(lost)::DOUBLE / len(ws) END AS c FROM gone)
    SELECT doc_id, CASE WHEN k = 0 THEN 'n/a' WHEN k = 1 THEN 'pass' ELSE 'fail' END AS grounding,
           CASE WHEN c IS NULL THEN 'n/a' WHEN c >= 0.95 THEN 'pass' ELSE 'fail' END AS coverage FROM v"""
)
def check_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    covered = checks.coverage(_pairs(spark, sf), "source_text", "produced")
    k = F.col("doc_id") % 4
    pages = covered.select("doc_id", "page_no", F.when(k == 0, "none").otherwise("pdf").alias("verify_trust"))
    shares = covered.where(k > 0).select("doc_id", "page_no", F.lit(1).alias("found"), F.when(k == 1, 1).otherwise(2).alias("total"))
    return checks.verdicts(pages, shares, covered).select("doc_id", "grounding", "coverage")


@query(
    """WITH s AS (SELECT o_orderkey, (o_orderkey % 5 + 1)::VARCHAR || '-' || (o_orderkey % 7 + 2) || ', ' || (o_orderkey % 3 + 1) AS spec, (o_orderkey % 6 + 1)::INT AS n FROM orders),
    p AS (SELECT o_orderkey, n, list_concat(range((o_orderkey % 5 + 1)::BIGINT, (o_orderkey % 7 + 3)::BIGINT), [(o_orderkey % 3 + 1)::BIGINT]) AS ps FROM s),
    k AS (SELECT o_orderkey, [x - 1 for x in ps if x <= n] AS ks FROM p)
    SELECT o_orderkey, unnest(ks)::BIGINT AS page_index, (generate_subscripts(ks, 1) - 1)::BIGINT AS target_ord FROM k"""
)
def page_selection(spark: SparkSession, sf: str) -> DataFrame:
    o = F.col("o_orderkey")
    text = lambda c: c.cast("string")
    spec = F.concat(text(o % 5 + 1), F.lit("-"), text(o % 7 + 2), F.lit(", "), text(o % 3 + 1))
    rows = table(spark, sf, "orders").select("o_orderkey", spec.alias("spec"), (o % 6 + 1).cast("int").alias("n"))
    found = select.parse_pages(rows, "spec", "n")
    return found.select("o_orderkey", F.col("page_index").cast("long"), F.col("target_ord").cast("long"))


@query("SELECT p_partkey, p_size >= 40 / 2 AND p_retailprice >= 28 AND p_size * 3 >= 40 AND p_retailprice / 40 >= 28 AND p_size * 2 >= 40 AS kept FROM part")
def image_filter(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    kept = select.is_picture(F.col("p_size") * 2, F.col("p_size") * 3, F.col("p_retailprice"), F.col("p_retailprice") / 40)
    return p.select("p_partkey", kept.alias("kept"))


# --- Coordinates ----------------------------------------------------------------------------------


@query(
    f"""WITH {_LINES}, w AS (SELECT doc_id, round_even(size, 0) AS v, sum(length(text)) AS n, min(line) AS o FROM lines GROUP BY ALL)
    SELECT doc_id, arg_max(v, n * 1000000 - o) AS body FROM w GROUP BY doc_id"""
)
def dominant_size(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.body_size(_lines(spark, sf)).select("doc_id", "body")


@query(
    """WITH c AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'small' WHEN 'assistant' THEN 'normal' ELSE 'large' END AS size, length(text) AS n FROM conversations),
    w AS (SELECT conv_id, size, sum(n) AS n, min(turn) AS o FROM c GROUP BY ALL)
    SELECT conv_id AS doc_id, arg_max(size, n * 1000 - o) AS anchor FROM w GROUP BY conv_id"""
)
def size_scale_anchor(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    label = F.when(F.col("role") == "user", "small").when(F.col("role") == "assistant", "normal").otherwise("large")
    blocks = c.select(F.col("conv_id").alias("doc_id"), F.lit(1).alias("page_no"), F.col("turn").alias("block_ord"), F.lit("paragraph").alias("kind"), label.alias("size"), "text")
    return word.size_anchor(blocks)


@query(
    f"""WITH {_LINES}, y AS (SELECT doc_id, y0, sum(length(text)) AS n FROM lines GROUP BY ALL),
    a AS (SELECT doc_id, y0, sum(n) OVER (PARTITION BY doc_id ORDER BY y0) - n AS above, sum(n) OVER (PARTITION BY doc_id) AS total FROM y)
    SELECT l.doc_id, l.line::BIGINT AS line, above::BIGINT AS above, total::BIGINT AS total FROM lines l JOIN a USING (doc_id, y0)"""
)
def text_above(spark: SparkSession, sf: str) -> DataFrame:
    found = spatial.text_above(_lines(spark, sf))
    return found.select("doc_id", F.col("line").cast("long"), F.col("above").cast("long"), F.col("total").cast("long"))


@query(
    f"""WITH {_LINES}, img AS (SELECT doc_id, o AS ord, 30.0 * o + doc_id % 11 AS y0, 30.0 * o + doc_id % 11 + 25 AS y1 FROM documents, (SELECT unnest([0, 1, 2]) AS o)),
    j AS (SELECT i.doc_id, i.ord, i.y0 AS iy0, i.y1 AS iy1, l.y0, l.y1, l.x0, length(l.text) AS n, {_collapse('l.text')} AS t FROM img i LEFT JOIN lines l USING (doc_id))
    SELECT doc_id, ord::BIGINT AS ord, round_even(coalesce(sum(n) FILTER (y1 <= iy0), 0)::DOUBLE / greatest(coalesce(sum(n), 0), 1), 6) AS frac_above,
           (max({{'a': y0, 'b': y1, 'c': x0, 'd': t}}) FILTER (y1 <= iy0)).d AS text_before, (min({{'a': y0, 'b': y1, 'c': x0, 'd': t}}) FILTER (y0 >= iy1)).d AS text_after
    FROM j GROUP BY doc_id, ord"""
)
def image_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    d = _documents(spark, sf).select("doc_id", F.lit(1).alias("page_no"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("ord"))
    y0 = 30.0 * F.col("ord") + F.col("doc_id") % 11
    found = spatial.image_places(d.select("*", y0.alias("y0"), (y0 + 25).alias("y1")), _lines(spark, sf))
    return found.select("doc_id", F.col("ord").cast("long"), F.bround("frac_above", 6).alias("frac_above"), "text_before", "text_after")


@query(
    f"""WITH {_LINES}, box AS (SELECT doc_id, 60.0 AS bx0, 24.0 * (doc_id % 4) AS by0, 300.0 AS bx1, 24.0 * (doc_id % 4) + 30 AS by1 FROM documents)
    SELECT l.doc_id, l.line::BIGINT AS line FROM lines l JOIN box USING (doc_id)
    WHERE greatest(least(x1, bx1) - greatest(x0, bx0), 0) * greatest(least(y1, by1) - greatest(y0, by0), 0) / greatest((x1 - x0) * (y1 - y0), 1) <= 0.5"""
)
def overlap_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    d = _documents(spark, sf)
    y0 = 24.0 * (F.col("doc_id") % 4)
    boxes = d.select("doc_id", F.lit(1).alias("page_no"), F.lit(60.0).alias("x0"), y0.alias("y0"), F.lit(300.0).alias("x1"), (y0 + 30).alias("y1"))
    return spatial.outside_tables(_lines(spark, sf), boxes).select("doc_id", F.col("line").cast("long").alias("line"))


@query(
    f"""WITH {_LINES}, keyed AS (SELECT *, {_n('text')} AS nt FROM lines),
    b AS (SELECT doc_id, line AS block_ord, substr(nt, 1, 20) AS head FROM keyed WHERE length(substr(nt, 1, 20)) >= 6),
    j AS (SELECT b.doc_id, block_ord, k.line, k.size, k.x0, k.x1, k.line % 6 = 0 AS bold, row_number() OVER (PARTITION BY b.doc_id, block_ord ORDER BY NOT starts_with(k.nt, head), k.line) AS rn
          FROM b JOIN keyed k ON k.doc_id = b.doc_id AND contains(k.nt, head)),
    w AS (SELECT doc_id, round_even(size, 1) AS v, sum(length(text)) AS n, min(line) AS o FROM lines GROUP BY ALL),
    body AS (SELECT doc_id, arg_max(v, n * 1000000 - o) AS body FROM w GROUP BY doc_id)
    SELECT j.doc_id, block_ord::BIGINT AS block_ord, line::BIGINT AS line, bold,
           CASE WHEN size >= body * 1.15 THEN 'large' WHEN size <= body * 0.85 THEN 'small' ELSE 'normal' END AS size,
           CASE WHEN abs((x0 + x1) / 2 - 306) < 24 AND x0 > 40 AND 612 - x1 > 40 THEN 'center' WHEN x0 > (612 - x1) * 3 AND x0 > 100 THEN 'right' ELSE 'left' END AS align
    FROM j JOIN body USING (doc_id) WHERE rn = 1"""
)
def block_look_lookup(spark: SparkSession, sf: str) -> DataFrame:
    lines = _lines(spark, sf)
    blocks = lines.select("doc_id", "page_no", F.col("line").alias("block_ord"), F.lit("paragraph").alias("kind"), "text")
    found = spatial.first_line(blocks, lines).join(spatial.body_size(lines, 1), ["doc_id", "page_no"])
    line = F.col("line")
    look = spatial.measured_look(line["size"], F.col("body"), line["x0"], line["x1"], F.lit(612.0), line["bold"])
    return found.select("doc_id", F.col("block_ord").cast("long"), line["ord"].cast("long").alias("line"), look["bold"].alias("bold"), look["size"].alias("size"), look["align"].alias("align"))


@query(
    """WITH p AS (SELECT p_partkey, 400.0 + p_size * 40 AS w, CASE WHEN p_partkey % 3 = 0 THEN (400.0 + p_size * 40) * 11 / 8.5 WHEN p_partkey % 3 = 1 THEN (400.0 + p_size * 40) * 8.27 / 11.69 ELSE p_retailprice END AS h FROM part),
    s AS (SELECT unnest([0, 1, 2, 3, 4, 5]) AS i, unnest(['Letter', 'Legal', 'A4', 'A3', 'A5', 'Tabloid']) AS name, unnest([8.5, 8.5, 8.27, 11.69, 5.83, 11.0])::DOUBLE AS sw, unnest([11.0, 14.0, 11.69, 16.54, 8.27, 17.0])::DOUBLE AS sh),
    c AS (SELECT 2 * i AS o, name, sw AS a, sh AS b FROM s UNION ALL SELECT 2 * i + 1, name, sh, sw FROM s),
    e AS (SELECT p_partkey, w, h, name, a, b, abs(w::DOUBLE / h - a / b) / (a / b) AS err, o FROM p, c),
    best AS (SELECT p_partkey, any_value(w) AS w, any_value(h) AS h, min(err) AS err, min({'err': err, 'o': o, 'name': name, 'a': a, 'b': b}) AS m FROM e GROUP BY p_partkey)
    SELECT p_partkey, CASE WHEN greatest(w, h) / 72 > 17.5 AND err < 0.02 THEN m.name END AS name,
           round_even(CASE WHEN greatest(w, h) / 72 > 17.5 AND err < 0.02 THEN m.a * 72 ELSE w::DOUBLE END, 3) AS width_pt FROM best"""
)
def page_size_match(spark: SparkSession, sf: str) -> DataFrame:
    w = 400.0 + F.col("p_size") * 40
    h = F.when(F.col("p_partkey") % 3 == 0, w * 11 / 8.5).when(F.col("p_partkey") % 3 == 1, w * 8.27 / 11.69).otherwise(F.col("p_retailprice"))
    box = table(spark, sf, "part").select("p_partkey", spatial.standard_page(w, h).alias("box"))
    return box.select("p_partkey", "box.name", F.bround("box.width_pt", 3).alias("width_pt"))


@query(
    f"""WITH {_LINES}, w AS (SELECT doc_id, round_even(size, 0) AS v, sum(length(text)) AS n, min(line) AS o FROM lines GROUP BY ALL),
    body AS (SELECT doc_id, arg_max(v, n * 1000000 - o) AS body FROM w GROUP BY doc_id),
    m AS (SELECT doc_id, min(x0) AS l, 612 - max(x1) AS r, min(y0) AS t FROM lines GROUP BY doc_id)
    SELECT d.doc_id, coalesce(l, 72.0)::DOUBLE AS left_pt, coalesce(r, 72.0)::DOUBLE AS right_pt, coalesce(t, 72.0)::DOUBLE AS top_pt, coalesce(body, 11.0)::DOUBLE AS body_pt
    FROM documents d LEFT JOIN m USING (doc_id) LEFT JOIN body USING (doc_id)"""
)
def page_layout(spark: SparkSession, sf: str) -> DataFrame:
    pages = _sources(spark, sf).select("doc_id", "page_no", F.lit(612.0).alias("width_pt"), F.lit(792.0).alias("height_pt"))
    lines = _lines(spark, sf)
    spans = lines.select("*", F.lit(0).alias("blk"), F.lit(0).alias("span"))
    found = spatial.page_layout(pages, lines, spans)
    return found.select("doc_id", *(F.col(c).cast("double") for c in ("left_pt", "right_pt", "top_pt", "body_pt")))


# --- Tables and repairs ---------------------------------------------------------------------------------


@query(
    f"""WITH {_NATIONS} SELECT doc_id, len(rows)::BIGINT AS model_rows, coalesce(len(rows[1]), 0)::BIGINT AS model_cols, len(grid)::BIGINT AS real_rows, len(rows) <> len(grid) AS differs FROM cells"""
)
def zip_join_tables(spark: SparkSession, sf: str) -> DataFrame:
    t = _nation_tables(spark, sf)
    detected = t.select("doc_id", "page_no", F.lit(0.0).alias("x0"), F.lit(1.0).alias("y0"), "grid", "col_count").unionByName(
        t.select("doc_id", "page_no", F.lit(0.0).alias("x0"), F.lit(9.0).alias("y0"), "grid", "col_count")
    )
    shapes = checks.table_shapes(repair.paired_tables(t.drop("grid", "col_count"), detected))
    return shapes.select(
        "doc_id",
        F.col("model_rows").cast("long"),
        F.col("model_cols").cast("long"),
        F.col("real_rows").cast("long"),
        (F.col("model_rows") != F.col("real_rows")).alias("differs"),
    )


@query(f"""WITH {_NATIONS}, g AS (SELECT doc_id, unnest(grid) AS r, generate_subscripts(grid, 1) - 1 AS pos, rows FROM cells)
    SELECT doc_id, pos::BIGINT AS pos, array_to_string(r, '|') AS item FROM g WHERE NOT list_contains(rows, r)""")
def missing_table_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = repair.missing_rows(_nation_tables(spark, sf)).select("doc_id", F.explode("new").alias("n"))
    return rows.select("doc_id", F.col("n.pos").cast("long").alias("pos"), F.array_join("n.item", "|").alias("item"))


@query(f"""WITH {_NATIONS} SELECT doc_id, array_to_string([array_to_string(r, '|') for r in grid], '/') AS rows, (len(grid) - len(rows))::BIGINT AS restored FROM cells""")
def repair_rows_insert(spark: SparkSession, sf: str) -> DataFrame:
    fixed = repair.restore_rows(_nation_tables(spark, sf))
    return fixed.select("doc_id", F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "/").alias("rows"), F.col("restored").cast("long"))


def repair_lines_insert(spark: SparkSession, sf: str) -> DataFrame:
    """Extracted lines as blocks, with the dropped ones back; the insertions of a page move
    one another, so there is no SQL for it: tests compare it with lists."""
    kinds = lambda x: F.struct(F.lit("paragraph").alias("kind"), x.alias("text"), *_no_table())
    blocks = F.transform(F.filter(F.split("produced", "\n"), lambda x: ~T.blank(x)), kinds)
    x0 = lambda i: 72.0 + (i % 3) * 40
    y0 = lambda i: 12.0 * F.floor(i / 2)
    line = lambda x, i: F.struct(
        i.alias("ord"), x.alias("text"), (8.0 + (F.col("doc_id") + i) % 5).alias("size"), x0(i).alias("x0"), y0(i).alias("y0"), (x0(i) + F.least(F.length(x), F.lit(90)) * 4).alias("x1"), (y0(i) + 10).alias("y1")
    )
    lines = F.filter(F.transform(F.split("source_text", "\n"), line), lambda l: ~T.blank(l["text"]))
    box = F.struct(F.lit(0.0).alias("x0"), F.lit(-9.0).alias("y0"), F.lit(1.0).alias("x1"), F.lit(-8.0).alias("y1"))
    gone = F.transform(checks.lost_lines(F.col("source_text"), F.col("produced")), lambda g: g["raw"])
    none = F.array().cast("array<string>")
    pages = _pairs(spark, sf).select(
        "doc_id", "page_no", F.lit(612.0).alias("width_pt"), blocks.alias("blocks"), lines.alias("lines"), F.coalesce(gone, none).alias("missing"), F.array(box).alias("boxes")
    )
    fixed = repair.put_back(pages)
    return fixed.select("doc_id", F.size("blocks").cast("long").alias("n_blocks"), F.col("restored").cast("long"), F.sha1(F.array_join(F.transform("blocks", lambda b: b["text"]), "\n")).alias("digest"))


QUERIES["repair_lines_insert"] = repair_lines_insert


# --- Rendering and plans ------------------------------------------------------------------------------------


@query(
    f"""WITH {_PART_TABLES}, h AS (SELECT doc_id, rows, CASE WHEN has_header THEN header ELSE ['' for x in range(CASE WHEN len(rows) > 0 THEN len(rows[1]) ELSE 1 END)] END AS head FROM faulty)
    SELECT doc_id, array_to_string(list_concat(['| ' || array_to_string(head, ' | ') || ' |', '|' || array_to_string(['---' for x in range(greatest(len(head), 1))], '|') || '|'],
           ['| ' || array_to_string(r, ' | ') || ' |' for r in rows]), chr(10)) AS markdown FROM h"""
)
def markdown_tables(spark: SparkSession, sf: str) -> DataFrame:
    return _part_tables(spark, sf).select("doc_id", markdown.render_table(F.col("has_header"), F.col("header"), F.col("rows")).alias("markdown"))


_MD_LIST = f"array_to_string(['- ' || {_strip('y')} for y in [x] if length({_collapse('y')}) > 0], chr(10))"


@query(
    f"""SELECT doc_id, '# ' || doc_id || chr(10) || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '*(page 1)*' || chr(10) || chr(10) || array_to_string(
        [CASE WHEN i = 1 THEN '## ' || x WHEN i = 4 THEN {_MD_LIST} WHEN i = 5 THEN '*' || x || '*' ELSE x END for x, i in string_split(text, chr(10))], chr(10)) AS markdown FROM documents"""
)
def markdown_document(spark: SparkSession, sf: str) -> DataFrame:
    return markdown.render_documents(_doc_pages(spark, sf))


@query(
    """WITH b AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents)
    SELECT doc_id, o::BIGINT AS ord, least(n, round_even(doc_id % 10 / 10.0 * n, 0))::BIGINT AS slot FROM b, (SELECT unnest([0, 1, 2]) AS o) WHERE o <= doc_id % 3"""
)
def image_slots(spark: SparkSession, sf: str) -> DataFrame:
    rows = ordered.interleaved(_doc_pages(spark, sf), _pictures(spark, sf)).where("is_block = 0")
    return rows.select("doc_id", F.col("img_ord").cast("long").alias("ord"), F.col("slot").cast("long").alias("slot"))


@query(
    f"""WITH b AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k, len(string_split(text, chr(10))) AS n FROM documents),
    i AS (SELECT DISTINCT doc_id, n, o FROM b, (SELECT unnest([0, 1, 2]) AS o) WHERE o <= doc_id % 3),
    every AS (SELECT doc_id, k AS slot, 1 AS blk, -1 AS o, CASE WHEN length({_collapse('t')}) = 0 THEN 0 ELSE 2 END AS h, t, k FROM b
              UNION ALL SELECT doc_id, least(n, round_even(doc_id % 10 / 10.0 * n, 0)), 0, o, 3, NULL, NULL FROM i),
    r AS (SELECT *, 1 + coalesce(sum(h) OVER (PARTITION BY doc_id ORDER BY slot, blk, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS row FROM every)
    SELECT doc_id, row::BIGINT AS row, 1::BIGINT AS col, {_strip('t')} AS value, k = 0 AS bold, regexp_matches({_strip('t')}, '^[=+\\-@]') AS quote FROM r WHERE blk = 1 AND h > 0"""
)
def sheet_rows(spark: SparkSession, sf: str) -> DataFrame:
    return sheet.sheet_cells(sheet.sheet_items(_doc_pages(spark, sf), _pictures(spark, sf)))


@query("SELECT n_regionkey::BIGINT AS doc_id, 1::BIGINT AS col, least(max(length(n_name)) + 2, 60)::BIGINT AS width FROM nation GROUP BY n_regionkey")
def column_widths(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_regionkey").cast("long").alias("doc_id"), F.lit(1).cast("long").alias("col"), F.col("n_name").alias("value"))
    return sheet.column_widths(n)


@query(
    """WITH i AS (SELECT doc_id, (doc_id % 9 * 1.0)::DOUBLE AS w, (doc_id % 7 * 1.5)::DOUBLE AS h, doc_id % 5 * 40 AS pw, doc_id % 4 * 30 AS ph FROM documents),
    c AS (SELECT *, CASE WHEN w = 0 THEN 2.0 ELSE least(w, 6.5) END AS cw, CASE WHEN h = 0 THEN 2.0 ELSE least(h, 8.0) END AS ch FROM i),
    f AS (SELECT doc_id, CASE WHEN pw > 0 AND ph > 0 AND h > 0 AND w = 0 THEN ch / (ph::DOUBLE / pw) ELSE cw END AS fw, CASE WHEN pw > 0 AND ph > 0 AND w > 0 AND h = 0 THEN cw * (ph::DOUBLE / pw) ELSE ch END AS fh FROM c)
    SELECT doc_id, round_even(fw * 96, 4)::DOUBLE AS px_w, round_even(fh * 96, 4)::DOUBLE AS px_h, round_even(fw * 96 / 7.0, 4)::DOUBLE AS chars, round_even(fh * 96 / (96.0 / 72.0), 4)::DOUBLE AS points FROM f"""
)
def picture_frames(spark: SparkSession, sf: str) -> DataFrame:
    p = _pictures(spark, sf).where("ord = 0")
    frame = sheet.picture_frame(F.col("width_in"), F.col("height_in"), F.col("px_w"), F.col("px_h"))
    return p.select("doc_id", frame.alias("f")).select("doc_id", *(F.bround(f"f.{c}", 4).alias(c) for c in ("px_w", "px_h", "chars", "points")))


@query(
    f"""WITH b AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents),
    s AS (SELECT *, CASE WHEN k = 0 THEN 'large' WHEN k % 5 = 4 THEN 'small' ELSE 'normal' END AS size FROM b),
    w AS (SELECT doc_id, size, sum(length(t)) AS n, min(k) AS o FROM s GROUP BY ALL),
    a AS (SELECT doc_id, arg_max(size, n * 1000000 - o) AS anchor FROM w GROUP BY doc_id),
    f AS (SELECT s.*, (CASE size WHEN 'small' THEN 0.8 WHEN 'large' THEN 1.6 ELSE 1.0 END / CASE anchor WHEN 'small' THEN 0.8 WHEN 'large' THEN 1.6 ELSE 1.0 END)::DOUBLE AS f FROM s JOIN a USING (doc_id) WHERE length({_collapse('t')}) > 0),
    p AS (SELECT *, round_even(greatest(8.0, least(11.0 * f, 11.0 * 2.2))::DOUBLE, 1) AS pt FROM f)
    SELECT doc_id, k::BIGINT AS block_ord, CASE WHEN k = 0 THEN 'heading' WHEN k = 3 THEN 'item' WHEN k = 4 THEN 'caption' ELSE 'paragraph' END AS op,
           CASE WHEN k = 3 THEN NULL WHEN k = 4 AND f = 1.0 THEN 9.0 WHEN f <> 1.0 OR k NOT IN (0, 4) THEN pt END AS point FROM p"""
)
def docx_plan(spark: SparkSession, sf: str) -> DataFrame:
    """What a Word document is written with: kind and size of every block."""
    none = _pictures(spark, sf).where("false")
    plan = word.word_plan(_doc_pages(spark, sf), none)
    order = ["doc_id", "page_no"]
    blocks = _doc_pages(spark, sf).select(*order, F.posexplode("blocks").alias("block_ord", "b")).where(~T.blank(F.col("b.text")))
    rn = F.row_number().over(Window.partitionBy("doc_id").orderBy("block_ord"))
    listed = blocks.select("doc_id", "block_ord", rn.alias("seq"))
    return plan.join(listed, ["doc_id", "seq"]).select("doc_id", F.col("block_ord").cast("long"), "op", "point")


@query(
    f"""WITH {_MISSING}, p AS (SELECT doc_id, ns, qg, ws, lost, [x for x in string_split(src, chr(10)) if length({_collapse('x')}) > 0] AS ps FROM gone),
    k AS (SELECT *, len([x for x in ps if length({_n('x')}) >= 8 AND NOT contains(qg, {_q('x')})]) AS away FROM p)
    SELECT doc_id, round_even(CASE WHEN len(ws) = 0 THEN 1.0 ELSE 1 - len(lost)::DOUBLE / len(ws) END, 6) AS coverage, (len(ps) - away)::BIGINT AS kept_paragraphs, len(ps)::BIGINT AS paragraphs,
           ((CASE WHEN len(ws) = 0 THEN 1.0 ELSE 1 - len(lost)::DOUBLE / len(ws) END < 0.99)::INT + (away > 0)::INT)::BIGINT AS problems FROM k"""
)
def roundtrip_verify(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _pairs(spark, sf)
    none = F.array().cast("array<struct<rows:int,cols:int,cells:array<string>>>")
    paragraphs = F.filter(F.split("source_text", "\n"), lambda x: ~T.blank(x))
    src = pairs.select("doc_id", F.col("source_text").alias("text"), paragraphs.alias("paragraphs"), none.alias("tables"), F.lit(0).alias("images"))
    out = pairs.select("doc_id", F.col("produced").alias("text"), none.alias("tables"), F.lit(0).alias("images"))
    found = checks.converted(src, out)
    problems = F.size(F.filter("findings", lambda x: x["severity"] == "problem")).cast("long")
    return found.select("doc_id", F.bround("coverage", 6).alias("coverage"), "kept_paragraphs", "paragraphs", problems.alias("problems"))


# --- History and digests -------------------------------------------------------------------------------------


_RUNS = "d AS (SELECT event_type AS label, strftime(ts, '%Y-%m-%d') AS day, count(*) AS blocks, round_even(sum(value), 4) AS wall_s FROM events GROUP BY ALL)"


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("label", F.col("event_type"))
    return e.groupBy("label", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("blocks"), F.bround(F.sum("value"), 4).alias("wall_s"))


@query(
    f"""WITH {_RUNS}, l AS (SELECT *, lag(blocks) OVER w AS b0, lag(wall_s) OVER w AS w0 FROM d WINDOW w AS (PARTITION BY label ORDER BY day))
    SELECT label, day, round_even(CASE WHEN b0 <> 0 THEN (blocks - b0)::DOUBLE / b0 * 100 END, 4) AS blocks_pct, round_even(CASE WHEN w0 <> 0 THEN (wall_s - w0) / w0 * 100 END, 2) AS wall_s_pct FROM l"""
)
def bench_delta(spark: SparkSession, sf: str) -> DataFrame:
    found = history.deltas(_runs(spark, sf), "day", ["blocks", "wall_s"], ["label"])
    return found.select("label", "day", F.bround("blocks_pct", 4).alias("blocks_pct"), F.bround("wall_s_pct", 2).alias("wall_s_pct"))


@query(
    f"""WITH {_RUNS}, l AS (SELECT *, lag(blocks) OVER (PARTITION BY label ORDER BY day) AS b0 FROM d)
    SELECT label, day, 'blocks changed from ' || b0 || ' to ' || blocks AS warning FROM l WHERE b0 <> blocks"""
)
def bench_warnings(spark: SparkSession, sf: str) -> DataFrame:
    """Runs whose amount of content differs from that of the run before."""
    return history.changed_content(_runs(spark, sf), "day", ["label"]).where("warning is not null").select("label", "day", "warning")


@query(
    """WITH r AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0.0 ELSE value END AS s, event_id % 3 AS k, event_type FROM events)
    SELECT event_id, round_even(CASE WHEN s = 0 THEN 0.0 ELSE (event_id % 1000)::DOUBLE / s END, 6)::DOUBLE AS rate,
           CASE WHEN k = 0 THEN '100% GPU' WHEN k = 1 THEN '41%/59% CPU/GPU' ELSE 'unknown' END AS processor FROM r"""
)
def run_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Rates of runs, 0 where no time passed, and the processor out of a listing of processes."""
    e = table(spark, sf, "events")
    seconds = F.when(F.col("event_id") % 4 == 0, 0.0).otherwise(F.col("value"))
    k = F.col("event_id") % 3
    listing = F.when(k == 0, "NAME ID SIZE PROCESSOR\nm1 a 3GB  100%   GPU\nm2 b 1GB 7% CPU").when(k == 1, "NAME\nm2 z 8% GPU\nm1 y 41%/59% CPU/GPU").otherwise("NAME\nother x 100% GPU")
    return e.select("event_id", F.bround(history.rate(F.col("event_id") % 1000, seconds), 6).alias("rate"), history.processor(listing, F.lit("m1")).alias("processor"))


@query("SELECT doc_id, sha1(text) AS digest FROM documents")
def image_digest(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select("doc_id", F.sha1(F.col("text").cast("binary")).alias("digest"))


# --- Answers, structure ---------------------------------------------------------------------------------------


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as responses of a model: a page with one block, some of them damaged or cut off."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_no"), "role", "text")
    k = (F.col("doc_id") + F.col("page_no")) % 8
    block = F.struct(
        F.when(k == 1, "poem").otherwise("paragraph").alias("kind"),
        F.when(k == 2, F.lit(None)).when(k == 3, " ").otherwise(F.col("text")).alias("text"),
        F.when(k == 4, "top").otherwise("left").alias("align"),
        F.lit("normal").alias("size"),
        F.lit("false").alias("bold"),
    )
    counts = F.when(k == 5, F.array_repeat(F.lit("2"), 12)).otherwise(F.array().cast("array<string>"))
    page = F.struct(F.struct(F.when(k == 6, "3").otherwise("1").alias("n_blocks"), counts.alias("table_column_counts")).alias("analysis"), F.array(block).alias("blocks"))
    content = F.when(k == 7, "no json").otherwise(F.to_json(page))
    return c.select("doc_id", "page_no", content.alias("content"), F.when(F.col("page_no") % 5 == 4, "length").otherwise("stop").alias("done_reason"))


_K = "k AS (SELECT conv_id AS doc_id, turn::INT AS page_no, (conv_id + turn) % 8 AS k, turn % 5 = 4 AS cut, text FROM conversations)"


@query(
    f"""WITH {_K} SELECT doc_id, page_no::BIGINT AS page_no, CASE WHEN cut THEN 'cut off at 4000 tokens' END AS error, CASE WHEN cut OR k = 7 THEN 'failed' ELSE 'ok' END AS status,
    (CASE WHEN cut OR k = 7 THEN NULL WHEN k = 6 THEN 3 ELSE 1 END)::BIGINT AS n_blocks, (CASE WHEN cut OR k = 7 THEN -1 ELSE 1 END)::BIGINT AS got FROM k"""
)
def parsed_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Responses that were cut off or are no JSON fail; others are parsed."""
    answers = schema.model_answers(_answers(spark, sf))
    parsed = schema.parse_model_pages(answers).join(answers.select(*schema.KEY, "error"), schema.KEY)
    got = F.coalesce(F.size("blocks"), F.lit(-1))
    return parsed.select("doc_id", F.col("page_no").cast("long").alias("page_no"), "error", "status", F.col("n_blocks").cast("long").alias("n_blocks"), got.cast("long").alias("got"))


@query(
    f"""WITH {_K}, u AS (SELECT * FROM k WHERE NOT cut AND k <> 7)
    SELECT doc_id, page_no::BIGINT AS page_no, 'schema' AS "check", 'problem' AS severity, CASE k WHEN 1 THEN 'block[0]: kind is unknown' WHEN 2 THEN 'block[0]: text is missing' WHEN 4 THEN 'block[0]: align is unknown'
           ELSE 'announces 12 tables, more than 10' END AS message FROM u WHERE k IN (1, 2, 4, 5)
    UNION ALL SELECT doc_id, page_no, 'structure', 'note', 'announced 3 blocks, got 1 (paragraph)' FROM u WHERE k = 6
    UNION ALL SELECT doc_id, page_no, 'structure', 'problem', 'block[0] kind=paragraph: no text' FROM u WHERE k IN (2, 3)"""
)
def answer_findings(spark: SparkSession, sf: str) -> DataFrame:
    """What answers say that they may not, and where they contradict themselves."""
    parsed = schema.parse_model_pages(schema.model_answers(_answers(spark, sf)))
    good = parsed.where("status = 'ok'")
    columns = [*schema.KEY, "check", "severity", "message"]
    found = schema.validate(schema.explode_blocks(good)).select(*columns).unionByName(schema.page_findings(good).select(*columns)).unionByName(checks.structure(good).select(*columns))
    return found.withColumn("page_no", F.col("page_no").cast("long"))


@query(
    f"""WITH {_PART_TABLES}, t AS (SELECT doc_id, 1 AS tables, len(rows) AS table_rows FROM faulty)
    SELECT doc_id, (1 + doc_id % 3)::BIGINT AS blocks, tables::BIGINT AS tables, table_rows::BIGINT AS table_rows FROM t"""
)
def run_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks, tables and table rows of pages: a table with none to two texts beside it."""
    tables = _part_tables(spark, sf).select("doc_id", "page_no", "kind", "rows")
    texts = tables.where("doc_id % 3 > 0").select("doc_id", "page_no", F.explode(F.sequence(F.lit(1), (F.col("doc_id") % 3).cast("int"))).alias("i"))
    texts = texts.select("doc_id", "page_no", F.lit("paragraph").alias("kind"), F.lit(None).cast("array<array<string>>").alias("rows"))
    return schema.run_counts(tables.unionByName(texts), ["doc_id"])


# --- Lines from spans, looks, layouts -----------------------------------------------------------------------


@query(
    f"""WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
    w AS (SELECT doc_id, line, unnest(string_split(t, ' ')) AS word, generate_subscripts(string_split(t, ' '), 1) - 1 AS k FROM raw),
    l AS (SELECT doc_id, line, string_agg(word || ' ', '' ORDER BY k) AS t, max(9.0 + k % 4) AS size, max(72.0 + 10 * k + 9) AS x1, bool_or(k % 7 = 3) AS bold FROM w GROUP BY ALL)
    SELECT doc_id, line::BIGINT AS line, {_strip('t')} AS text, size::DOUBLE AS size, x1::DOUBLE AS x1, bold FROM l WHERE length({_strip('t')}) > 0"""
)
def span_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines put together from spans: here the words of a line, in sizes and fonts that vary."""
    d = _documents(spark, sf)
    lines = d.select("doc_id", F.lit(1).alias("page_no"), F.lit(0).alias("blk"), F.posexplode(F.split("text", "\n")).alias("line", "t"))
    words = lines.select("doc_id", "page_no", "blk", "line", F.posexplode(F.split("t", " ")).alias("span", "w"))
    k = F.col("span")
    spans = words.select(
        "doc_id", "page_no", "blk", "line", "span", F.concat("w", F.lit(" ")).alias("text"), (9.0 + k % 4).alias("size"), F.when(k % 7 == 3, "Serif-Bold").otherwise("Serif").alias("font"),
        (72.0 + 10 * k).alias("x0"), F.lit(0.0).alias("y0"), (72.0 + 10 * k + 9).alias("x1"), F.lit(10.0).alias("y1"),
    )
    return spatial.line_table(spans).select("doc_id", F.col("line").cast("long").alias("line"), "text", "size", "x1", "bold")


@query(
    f"""WITH {_LINES}, w AS (SELECT doc_id, round_even(size, 0) AS v, sum(length(text)) AS n, min(line) AS o FROM lines GROUP BY ALL),
    body AS (SELECT doc_id, arg_max(v, n * 1000000 - o) AS body FROM w GROUP BY doc_id)
    SELECT l.doc_id, line::BIGINT AS line, CASE WHEN size >= body * 1.25 THEN 'heading' WHEN size <= body * 0.88 THEN 'caption' ELSE 'paragraph' END AS kind,
           CASE WHEN abs((x0 + x1) / 2 - 306) < 20 THEN 'center' ELSE 'left' END AS align, CASE WHEN size >= body * 1.25 THEN 'large' WHEN size <= body * 0.88 THEN 'small' ELSE 'normal' END AS size, false AS bold
    FROM lines l JOIN body USING (doc_id)"""
)
def restored_looks(spark: SparkSession, sf: str) -> DataFrame:
    """Kind and look that a line gets which comes back from the text layer."""
    lines = _lines(spark, sf)
    rows = lines.join(spatial.body_size(lines), ["doc_id", "page_no"])
    look = spatial.restored_look(F.col("size"), F.col("body"), F.col("x0"), F.col("x1"), F.lit(612.0))
    kind = spatial.kind_of_line(F.col("size"), F.col("body"))
    return rows.select("doc_id", F.col("line").cast("long").alias("line"), kind.alias("kind"), look.alias("l")).select("doc_id", "line", "kind", "l.align", "l.size", "l.bold")


@query("SELECT conv_id AS doc_id, (500 + max(turn) * 7)::DOUBLE AS width_pt, (10 + max(turn))::DOUBLE AS left_pt FROM conversations GROUP BY conv_id")
def document_layouts(spark: SparkSession, sf: str) -> DataFrame:
    """A document's layout is that of the page that was processed first; here the last one."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"))
    page = F.col("page_no")
    layouts = c.select("doc_id", "page_no", (500.0 + page * 7).alias("width_pt"), (10.0 + page).alias("left_pt"))
    return spatial.document_layout(layouts, c.select("doc_id", "page_no", (-page).alias("target_ord")))


# --- Tables, written and checked --------------------------------------------------------------------------------


@query(
    f"""WITH {_PART_TABLES}, g AS (SELECT doc_id, unnest(rows) AS r, generate_subscripts(rows, 1) - 1 AS k, len(rows[1]) AS w FROM faulty)
    SELECT doc_id, k::BIGINT AS row, array_to_string(CASE WHEN k % 4 = 3 THEN [r[1]] || ['' for x in range(w - 1)] ELSE list_resize(r, w, '') END, '|') AS cells, k % 4 = 3 AND w > 1 AS divider FROM g"""
)
def table_grids(spark: SparkSession, sf: str) -> DataFrame:
    """Rows on the grid of their table, cut or padded; a row with a first cell only divides."""
    t = _part_tables(spark, sf).where("size(rows) > 0")
    rows = F.transform("rows", lambda r, i: F.when(i % 4 == 3, F.slice(r, 1, 1)).otherwise(r))
    b = t.select("doc_id", F.struct(rows.alias("rows")).alias("b"), F.size(F.get("rows", F.lit(0))).alias("w"))
    found = b.select("doc_id", F.posexplode(word.grid(F.col("b"), F.col("w"))).alias("row", "g"))
    return found.select("doc_id", F.col("row").cast("long").alias("row"), F.array_join("g.cells", "|").alias("cells"), F.col("g.divider").alias("divider"))


@query(
    f"""WITH {_PART_TABLES}, t AS (SELECT doc_id, rows, CASE WHEN has_header THEN len(header) WHEN len(rows) > 0 THEN len(rows[1]) END AS w FROM faulty),
    r AS (SELECT doc_id, w, unnest(rows) AS r, generate_subscripts(rows, 1) - 1 AS i FROM t)
    SELECT doc_id, 'page 1 block[0]: table without rows, skipped' AS message FROM t WHERE len(rows) = 0
    UNION ALL SELECT doc_id, 'page 1 block[0] row ' || i || ': ' || len(r) || ' cells on a grid of ' || w || CASE WHEN len(r) < w THEN ', padded' ELSE ', cut' END FROM r WHERE len(r) <> w
    UNION ALL SELECT doc_id, 'page 1 block[1]: empty caption, skipped' FROM t"""
)
def write_problems(spark: SparkSession, sf: str) -> DataFrame:
    """What a writer reshapes or skips: ragged tables, empty ones, and a blank caption."""
    t = _part_tables(spark, sf)
    names = [x.split()[0] for x in schema.BLOCK.split(", ")]
    kinds = dict(x.split(" ", 1) for x in schema.BLOCK.split(", "))
    first = F.struct(*((F.col(n) if n in t.columns else F.lit(None)).cast(kinds[n]).alias(n) for n in names))
    blank = {"kind": F.lit("caption"), "text": F.lit("  ")}
    second = F.struct(*(blank.get(n, F.lit(None)).cast(kinds[n]).alias(n) for n in names))
    return word.write_problems(t.select("doc_id", "page_no", F.array(first, second).alias("blocks"))).select("doc_id", "message")


def _detected(spark: SparkSession, sf: str) -> DataFrame:
    """The nations' grids with blank rows at their end, and a second one on even pages."""
    t = _nation_tables(spark, sf)
    blank = F.array(F.array(F.lit(" "), F.lit(None).cast("string")), F.array(F.lit(""), F.lit("\u00a0")))
    one = t.select("doc_id", "page_no", F.lit(5.0).alias("x0"), F.lit(1.0).alias("y0"), F.concat("grid", blank).alias("grid"), (F.lit(2) + F.col("doc_id") % 2).cast("int").alias("col_count"))
    two = t.where("doc_id % 2 = 0").select("doc_id", "page_no", F.lit(5.0).alias("x0"), F.lit(9.0).alias("y0"), "grid", "col_count")
    return one.unionByName(two)


@query(
    f"""WITH {_NATIONS} SELECT doc_id, 'note' AS severity, 'tables: 1 extracted, 2 detected' AS message FROM cells WHERE doc_id % 2 = 0
    UNION ALL SELECT doc_id, 'note', 'table[0]: ' || len(rows) || 'x2 extracted, ' || len(grid) || 'x' || (2 + doc_id % 2) || ' detected' FROM cells WHERE len(rows) <> len(grid) OR doc_id % 2 = 1"""
)
def geometry_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Tables that differ from the detected ones in number or shape; blank rows do not count."""
    blocks = _nation_tables(spark, sf).drop("grid", "col_count")
    return checks.geometry(blocks, _detected(spark, sf)).select("doc_id", "severity", "message")


@query(f"WITH {_NATIONS} SELECT doc_id, (len(grid) + 2)::BIGINT AS rows, len(grid)::BIGINT AS real FROM cells")
def blank_grid_rows(spark: SparkSession, sf: str) -> DataFrame:
    d = _detected(spark, sf).where("y0 = 1.0")
    return d.select("doc_id", F.size("grid").cast("long").alias("rows"), F.size(select.real_rows(F.col("grid"))).cast("long").alias("real"))


# --- Files, written and read back -------------------------------------------------------------------------------


@query(
    f"""WITH b AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents),
    p AS (SELECT doc_id, -1 AS k, 'Title' AS style, 'document ' || doc_id AS t FROM documents
          UNION ALL SELECT doc_id, k, CASE WHEN k = 0 THEN 'Heading2' WHEN k = 3 THEN 'ListBullet' END, CASE WHEN k = 3 THEN trim(t, ' •◦▪-–' || chr(9)) ELSE {_strip('t')} END FROM b WHERE length({_collapse('t')}) > 0)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::BIGINT AS ord, style, {_strip('t')} AS text FROM p"""
)
def docx_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as Word files, read back: every paragraph in order, with its style."""
    pages = _doc_pages(spark, sf)
    titles = pages.select("doc_id", F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("title"))
    made = sinks.word_files(word.word_plan(pages, _pictures(spark, sf).where("false"), titles=titles))
    body = office.word_body(made).where("error is null")
    return body.select(F.regexp_extract("path", r"^(\d+)", 1).cast("long").alias("doc_id"), F.col("ord").cast("long").alias("ord"), "style", T.strip(F.col("text")).alias("text"))


_XLSX = SQL["sheet_rows"].replace("doc_id, row::BIGINT AS row, 1::BIGINT AS col", "doc_id, 'Sheet1' AS sheet, row::BIGINT AS row, 1::BIGINT AS col")


@query(f"SELECT doc_id, sheet, row, col, value FROM ({_XLSX})")
def xlsx_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as Excel files, read back: every cell with a value."""
    items = sheet.sheet_items(_doc_pages(spark, sf), _pictures(spark, sf))
    cells = sheet.sheet_cells(items)
    made = sinks.sheet_files(cells, sheet.column_widths(cells))
    read = office.sheet_cells(made).where("error is null")
    return read.select(F.regexp_extract("path", r"^(\d+)", 1).cast("long").alias("doc_id"), "sheet", "row", "col", "value")


@query(
    """WITH n AS (SELECT n_regionkey AS doc_id, count(*) AS n FROM nation GROUP BY ALL)
    SELECT doc_id::BIGINT AS doc_id, kind, (CASE WHEN kind = 'image' THEN n ELSE 1 END)::BIGINT AS n FROM n, (SELECT unnest(['image', 'table', 'text']) AS kind)"""
)
def body_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Word files with a heading, a table and a picture for each nation, and what is in them."""
    t = _nation_tables(spark, sf)
    names = [x.split()[0] for x in schema.BLOCK.split(", ")]
    kinds = dict(x.split(" ", 1) for x in schema.BLOCK.split(", "))
    head = {"kind": F.lit("heading"), "text": F.lit("Nations")}
    grid = {"kind": F.lit("table"), "has_header": F.lit(False), "rows": F.col("grid")}
    block = lambda found: F.struct(*(found.get(n, F.lit(None)).cast(kinds[n]).alias(n) for n in names))
    pages = t.select("doc_id", "page_no", F.array(block(head), block(grid)).alias("blocks"))
    images = t.select("doc_id", "page_no", F.posexplode("grid").alias("ord", "g")).select(
        "doc_id", "page_no", "ord", F.lit(1.0).alias("frac_above"), F.lit(2.0).alias("width_in"), F.lit(1.0).alias("height_in"), F.lit(40).alias("px_w"), F.lit(20).alias("px_h"), F.get("g", F.lit(1)).alias("path")
    )
    data = images.select("path", F.col("path").cast("binary").alias("data"), F.lit("png").alias("ext"))
    body = office.word_body(sinks.word_files(word.word_plan(pages, images), data))
    return office.body_counts(body).select(F.regexp_extract("path", r"^(\d+)", 1).cast("long").alias("doc_id"), "kind", "n")


@query("SELECT sum((doc_id % 3 > 0)::INT)::BIGINT AS ok, sum((doc_id % 3 = 0)::INT)::BIGINT AS failed FROM documents")
def batch_tally(spark: SparkSession, sf: str) -> DataFrame:
    """Files that passed and failed; notes fail nothing."""
    severity = F.when(F.col("doc_id") % 3 == 0, "problem").otherwise("note")
    return checks.tally(_documents(spark, sf).select("doc_id", F.array(F.struct(severity.alias("severity"))).alias("findings")))


@query(
    f"""WITH {_MISSING} SELECT doc_id, len(ws)::BIGINT AS n_words, CASE WHEN ns = '' THEN NULL WHEN len(ws) = 0 THEN 1.0 ELSE round_even(1 - len(lost)::DOUBLE / len(ws), 6) END AS coverage FROM gone"""
)
def file_readback(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the sources that written and read files still hold."""
    pairs = _pairs(spark, sf)
    names = [x.split()[0] for x in schema.BLOCK.split(", ")]
    kinds = dict(x.split(" ", 1) for x in schema.BLOCK.split(", "))
    of = {"kind": F.lit("paragraph"), "text": F.col("produced")}
    pages = pairs.select("doc_id", "page_no", F.array(F.struct(*(of.get(n, F.lit(None)).cast(kinds[n]).alias(n) for n in names))).alias("blocks"))
    read = office.word_summary(office.word_body(sinks.word_files(word.word_plan(pages, _pictures(spark, sf).where("false")))))
    read = read.select(F.regexp_extract("path", r"^(\d+)", 1).cast("long").alias("r_doc"), F.col("text").alias("read"))
    both = pairs.join(read, F.col("doc_id") == F.col("r_doc"), "left")
    return checks.readback(both, "source_text", "read").select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.bround("coverage", 6).alias("coverage"))


# --- Pictures, scans, PDF pages -----------------------------------------------------------------------------------


def _page_images(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as pictures of pages, twenty a page, some of them too small."""
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    return p.select(
        F.floor(k / 20).alias("doc_id"), F.lit(1).alias("page_no"), (k % 20).cast("int").alias("ord"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"),
        (F.col("p_size") * 2.0).alias("x1"), (F.col("p_size") * 3.0).alias("y1"), (F.col("p_size") * 4).alias("px_w"), (F.col("p_size") * 6).alias("px_h"), F.lit("png").alias("ext"), F.col("p_name").cast("binary").alias("data"),
    )


@query(
    """WITH k AS (SELECT p_partkey // 20 AS doc_id, row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) - 1 AS ord, p_name, p_size FROM part WHERE p_size * 4 >= 40 AND p_size * 6 >= 40 AND p_size * 2 >= 28 AND p_size * 3 >= 28)
    SELECT doc_id || '/p001_img' || CASE WHEN ord < 10 THEN '0' ELSE '' END || ord || '.png' AS path, sha1(p_name) AS sha1, strlen(p_name)::BIGINT AS n_bytes, round_even(p_size * 2.0 / 72, 6)::DOUBLE AS width_in FROM k"""
)
def image_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Pictures that are kept, as the files they become, with digests of their bytes."""
    found = select.extracted_images(_page_images(spark, sf))
    files = sinks.image_files(found).select("path", F.octet_length("content").cast("long").alias("n_bytes"))
    return found.select("path", "sha1", F.bround("width_in", 6).alias("width_in")).join(files, "path")


@query(
    """WITH d AS (SELECT DISTINCT p_partkey // 20 AS doc_id FROM part), m AS (SELECT doc_id FROM d WHERE doc_id % 2 = 0),
    s AS (SELECT doc_id, 1 AS page_no, 'image' AS op, 0.5 AS ratio, 1 AS seq FROM m UNION ALL SELECT doc_id, 1, 'page_break', NULL, 2 FROM m UNION ALL SELECT doc_id, 2, 'image', 2.0, 3 FROM m)
    SELECT doc_id, page_no::BIGINT AS page_no, seq::BIGINT AS seq, op, ratio::DOUBLE AS ratio, (CASE WHEN op = 'image' THEN 6.0 END)::DOUBLE AS width_in FROM s"""
)
def scan_document(spark: SparkSession, sf: str) -> DataFrame:
    """The separate document of scanned pages: pictures and page breaks, on their layout."""
    pages = _part_tables(spark, sf).select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("page_no"))
    pages = pages.withColumn("blocks", F.array().cast(f"array<struct<{','.join(x.replace(' ', ':', 1) for x in schema.BLOCK.split(', '))}>>"))
    images = pages.where("doc_id % 2 = 0").select(
        "doc_id", "page_no", F.lit(0).alias("ord"), F.lit(0.0).alias("frac_above"), F.lit(8.5).alias("width_in"), F.lit(11.0).alias("height_in"),
        F.lit(100).alias("px_w"), F.when(F.col("page_no") == 1, 50).otherwise(200).alias("px_h"), F.lit("s").alias("path"),
    )
    layouts = pages.select("doc_id").distinct().select("doc_id", F.lit(612.0).alias("width_pt"), F.lit(90.0).alias("left_pt"), F.lit(90.0).alias("right_pt"), F.lit(10.0).alias("body_pt"))
    plan = word.scan_plan(pages, images, layouts)
    return plan.select("doc_id", F.col("page_no").cast("long").alias("page_no"), F.col("seq").cast("long").alias("seq"), "op", "ratio", "width_in")


@query(
    """WITH c AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ord FROM conversations),
    w AS (SELECT conv_id, 'x' || conv_id AS sha1 FROM c GROUP BY conv_id),
    p AS (SELECT conv_id, count(*) AS n, arg_max(text, turn) AS last, arg_min(text, turn) AS first FROM c GROUP BY conv_id)
    SELECT conv_id AS doc_id, 'COUNT' AS "check", '1 extracted, 2 written' AS message FROM p WHERE conv_id % 3 = 1
    UNION ALL SELECT conv_id, 'BYTES', 'image 0 differs' FROM p WHERE conv_id % 4 = 0
    UNION ALL SELECT conv_id, 'POSITION', 'image 0 should follow nowhere to be seen' FROM p WHERE conv_id % 5 = 0"""
)
def image_verify(spark: SparkSession, sf: str) -> DataFrame:
    """Pictures of written documents, put behind the text, against what was extracted: a second
    one, other bytes, and a text that should stand before it but does not, are found."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("ord"), F.lit("text").alias("kind"), F.lit(None).cast("string").alias("sha1"), "text")
    docs = c.groupBy("doc_id").agg(F.max_by("text", "ord").alias("text"))
    shape = lambda d, at: d.select("doc_id", F.lit(1000 + at).alias("ord"), F.lit("image").alias("kind"), F.concat(F.lit("x"), F.col("doc_id").cast("string")).alias("sha1"), F.lit(None).cast("string").alias("text"))
    written = c.unionByName(shape(docs, 0)).unionByName(shape(docs.where("doc_id % 3 = 1"), 1))
    d = F.col("doc_id")
    expected = docs.select(
        "doc_id", F.lit(0).alias("ord"), F.when(d % 4 == 0, "y").otherwise(F.concat(F.lit("x"), d.cast("string"))).alias("sha1"),
        F.when(d % 5 == 0, "nowhere to be seen").otherwise(F.col("text")).alias("text_before"), F.lit(None).cast("string").alias("text_after"),
    )
    return word.verify_images(expected, written)


def _pdf_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files of the fake format: a page for each line, with a table and pictures."""
    box = lambda k: (F.lit(72.0).alias("x0"), (12.0 * k).alias("y0"), F.lit(300.0).alias("x1"), (12.0 * k + 10).alias("y1"))
    span = lambda x, k: F.struct(F.lit(0).alias("blk"), F.lit(0).alias("line"), F.lit(0).alias("span"), x.alias("text"), (8.0 + k % 5).alias("size"), F.lit("Serif").alias("font"), *box(k))
    grid = lambda k: F.array_repeat(F.array(F.lit("a"), F.lit("b")), (k % 3 + 1).cast("int"))
    table_ = lambda k: F.struct(F.lit(0).alias("ord"), *box(k), F.lit(2).alias("col_count"), grid(k).alias("grid"))
    image = lambda k: F.struct(F.lit(0).alias("ord"), *box(k), F.lit(100).alias("px_w"), F.lit(50).alias("px_h"), F.lit("png").alias("ext"))
    page = lambda x, k: F.struct(
        (k + 1).alias("page_no"), F.lit(612.0).alias("width_pt"), F.lit(792.0).alias("height_pt"), x.alias("source_text"),
        F.array(span(x, k)).alias("spans"), F.array(F.struct(F.lit(0).alias("ord"), *box(k), x.alias("text"))).alias("geo"),
        F.array_repeat(table_(k), F.when(k % 4 == 0, 1).otherwise(0)).alias("tables"), F.array_repeat(image(k), (k % 2).cast("int")).alias("images"),
    )
    content = F.to_json(F.transform(F.split("text", "\n"), page)).cast("binary")
    broken = F.when(F.col("doc_id") % 50 == 49, F.lit("no pages").cast("binary")).otherwise(content)
    return _documents(spark, sf).select(F.col("doc_id").cast("string").alias("path"), broken.alias("content"))


_PAGED = "g AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents WHERE doc_id % 50 <> 49)"


@query(
    f"""WITH {_PAGED} SELECT doc_id::VARCHAR AS doc_id, string_agg(t, chr(10) ORDER BY k) AS text, count(*)::BIGINT AS pages, sum(k % 2)::BIGINT AS images, sum((k % 4 = 0)::INT)::BIGINT AS tables,
    sum(CASE WHEN k % 4 = 0 THEN k % 3 + 1 ELSE 0 END)::BIGINT AS table_rows FROM g GROUP BY ALL"""
)
def pdf_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Text, pages, images and tables of files that a provider read."""
    found = pdf.pdf_summary(pdf.read_pages(_pdf_files(spark, sf), providers.FakePdf()))
    rows = F.aggregate("tables", F.lit(0), lambda a, t: a + t["rows"])
    return found.select("doc_id", "text", F.col("pages").cast("long").alias("pages"), F.col("images").cast("long").alias("images"), F.size("tables").cast("long").alias("tables"), rows.cast("long").alias("table_rows"))


@query(
    f"""WITH {_PAGED} SELECT doc_id::VARCHAR AS doc_id, (k + 1)::BIGINT AS page_no, t AS text, (8.0 + k % 5)::DOUBLE AS size, (12.0 * k)::DOUBLE AS y0 FROM g
    UNION ALL SELECT doc_id::VARCHAR, NULL, 'unreadable', NULL, NULL FROM documents WHERE doc_id % 50 = 49"""
)
def pdf_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of files that a provider read; files that it could not read fail alone."""
    tables = pdf.pdf_tables(pdf.read_pages(_pdf_files(spark, sf), providers.FakePdf()))
    spans = tables.spans.select("doc_id", F.col("page_no").cast("long").alias("page_no"), "text", "size", "y0")
    none = F.lit(None)
    return spans.unionByName(tables.errors.select("doc_id", none.cast("long").alias("page_no"), F.lit("unreadable").alias("text"), none.cast("double").alias("size"), none.cast("double").alias("y0")))


@query(
    f"""WITH {_PAGED} SELECT doc_id::VARCHAR AS doc_id, (k + 1)::BIGINT AS page_no, 125::BIGINT AS dpi, sha1(t) AS digest FROM g"""
)
def page_renders(spark: SparkSession, sf: str) -> DataFrame:
    """Pages rendered by a provider, at the resolution that a model is asked with."""
    found = providers.provided(_pdf_files(spark, sf), providers.FakeRender(125)).where("error is null")
    return found.select(F.col("path").alias("doc_id"), F.col("page_no").cast("long").alias("page_no"), F.col("dpi").cast("long").alias("dpi"), F.sha1(F.coalesce("image", F.lit(b""))).alias("digest"))
