"""Tables of the engine, and the parser of model answers.

A model answer is JSON; a field of the wrong type is read leniently (``"3"`` as 3, ``"true"``
as true), as its producers do. What is still missing or outside its domain makes findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_SOURCE = "doc_id string, page_no int, width_pt double, height_pt double, source_text string, ocr_text string"
SPANS = (
    "doc_id string, page_no int, blk int, line int, span int, text string, size double, font string, "
    "x0 double, y0 double, x1 double, y1 double"
)
GEO_BLOCKS = "doc_id string, page_no int, ord int, x0 double, y0 double, x1 double, y1 double, text string"
DETECTED = "doc_id string, page_no int, x0 double, y0 double, x1 double, y1 double, col_count int, grid array<array<string>>"
IMAGES = (
    "doc_id string, page_no int, ord int, x0 double, y0 double, x1 double, y1 double, px_w int, px_h int, ext string, data binary"
)
MODEL_PAGES = "doc_id string, page_no int, json string"
FINDINGS = "doc_id string, page_no int, block_ord int, check string, severity string, message string"
BLOCK = (
    "kind string, text string, align string, size string, bold boolean, has_header boolean, n_data_rows int, n_cols int, "
    "header array<string>, rows array<array<string>>"
)
BLOCKS = f"doc_id string, page_no int, block_ord int, {BLOCK}"
KEY = ["doc_id", "page_no"]

# The kinds, alignments and sizes that an answer may name, the number of tables
# whose widths it may announce, and the limits of a model call.
TEXT_KINDS = ("heading", "paragraph", "caption", "list", "image")
ALIGNMENTS = ("left", "center", "right")
SIZES = ("large", "normal", "small")
MAX_TABLE_COUNTS = 10
CONTEXT_TOKENS, MOST_TOKENS, TEMPERATURE = 8192, 4000, 0

_RAW = (
    "struct<analysis: struct<n_blocks: string, table_column_counts: array<string>>, blocks: array<struct<kind: string, text: string, "
    "align: string, size: string, bold: string, has_header: string, n_data_rows: string, n_cols: string, header: array<string>, "
    "rows: array<array<string>>>>>"
)


def parse_model_pages(pages: DataFrame) -> DataFrame:
    """One row per page: n_blocks, table_column_counts, blocks (array), and status, which
    is ``failed`` for a page whose answer is no JSON object with blocks."""
    read = pages.select(*KEY, F.from_json("json", _RAW).alias("a"))
    block = F.transform(
        "a.blocks",
        lambda b: F.struct(
            b["kind"].alias("kind"),
            b["text"].alias("text"),
            b["align"].alias("align"),
            b["size"].alias("size"),
            b["bold"].try_cast("boolean").alias("bold"),
            b["has_header"].try_cast("boolean").alias("has_header"),
            b["n_data_rows"].try_cast("int").alias("n_data_rows"),
            b["n_cols"].try_cast("int").alias("n_cols"),
            b["header"].alias("header"),
            b["rows"].alias("rows"),
        ),
    )
    return read.select(
        *KEY,
        F.col("a.analysis.n_blocks").try_cast("int").alias("n_blocks"),
        F.transform("a.analysis.table_column_counts", lambda x: x.try_cast("int")).alias("table_column_counts"),
        block.alias("blocks"),
        F.when(F.col("a.blocks").isNull(), "failed").otherwise("ok").alias("status"),
    )


def model_answers(responses: DataFrame, most: int = MOST_TOKENS) -> DataFrame:
    """Responses of a model (keys, content, done_reason) as answers (keys, json, error). One that
    ended at the token limit was cut off and is no answer, whatever it holds."""
    cut = F.lower(F.coalesce("done_reason", F.lit(""))) == "length"
    error = F.when(cut, f"cut off at {most} tokens").when(F.col("content").isNull(), "no answer")
    return responses.select(*KEY, F.when(error.isNull(), F.col("content")).alias("json"), error.alias("error"))


def page_findings(parsed: DataFrame) -> DataFrame:
    """Findings of whole answers: more announced table widths than an answer may hold."""
    many = F.size(F.coalesce("table_column_counts", F.array().cast("array<int>")))
    said = F.concat(F.lit("announces "), many.cast("string"), F.lit(f" tables, more than {MAX_TABLE_COUNTS}"))
    found = as_findings(parsed, finding(many > MAX_TABLE_COUNTS, "schema", "problem", said), keys=KEY)
    return found.select(*KEY, F.lit(None).cast("int").alias("block_ord"), "check", "severity", "message")


def run_counts(blocks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per page: blocks, tables, and rows of tables, as a benchmark run records them."""
    is_table = F.col("kind") == "table"
    rows = F.size(F.coalesce("rows", F.array().cast("array<array<string>>")))
    return blocks.groupBy(*(keys or KEY)).agg(
        F.count(F.lit(1)).alias("blocks"), F.count_if(is_table).alias("tables"), F.sum(F.when(is_table, rows).otherwise(0)).cast("long").alias("table_rows")
    )


def explode_blocks(parsed: DataFrame) -> DataFrame:
    """One row per block, in reading order (block_ord from 0)."""
    return parsed.select(*KEY, F.posexplode("blocks").alias("block_ord", "b")).select(*KEY, "block_ord", "b.*")


def gather_blocks(blocks: DataFrame) -> DataFrame:
    """The blocks of a page as one array in reading order."""
    names = [x.split()[0] for x in BLOCK.split(", ")]
    item = F.struct(F.col("block_ord"), F.struct(*names).alias("b"))
    return blocks.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["b"]).alias("blocks"))


def finding(when: Column, check: str, severity: str, message: Column) -> Column:
    """A finding where the condition holds, else null."""
    return F.when(when, F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"), message.alias("message")))


def as_findings(df: DataFrame, *found: Column, keys: list[str] | None = None) -> DataFrame:
    """One row per finding that is there."""
    keys = keys or [*KEY, "block_ord"]
    kept = df.select(*keys, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("f"))
    return kept.select(*keys, "f.*")


def validate(blocks: DataFrame) -> DataFrame:
    """Findings for blocks whose fields are missing or outside their domains."""
    is_table = F.col("kind") == "table"
    is_text = F.col("kind").isin(*TEXT_KINDS)
    text = lambda c: F.concat(F.lit("block["), F.col("block_ord").cast("string"), F.lit(f"]: {c}"))
    missing = [
        finding(is_text & F.col(c).isNull(), "schema", "problem", text(f"{c} is missing")) for c in ("text", "align", "size", "bold")
    ] + [finding(is_table & F.col(c).isNull(), "schema", "problem", text(f"{c} is missing")) for c in ("has_header", "n_data_rows", "n_cols", "header", "rows")]
    return as_findings(
        blocks,
        finding(~F.coalesce(is_table | is_text, F.lit(False)), "schema", "problem", text("kind is unknown")),
        finding(is_text & ~F.col("align").isin(*ALIGNMENTS), "schema", "problem", text("align is unknown")),
        finding(is_text & ~F.col("size").isin(*SIZES), "schema", "problem", text("size is unknown")),
        *missing,
    )
