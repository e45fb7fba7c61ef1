"""Markdown rendering of blocks and documents, as Column expressions and one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def _row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def render_table(has_header: Column, header: Column, rows: Column) -> Column:
    """A grid as wide as its header; a table without one gets an empty header as wide as
    its first row, as Markdown has no other. Rows stay as wide as they are."""
    none = F.array().cast("array<array<string>>")
    rows = F.coalesce(rows, none)
    width = F.when(F.size(rows) > 0, F.size(F.get(rows, F.lit(0)))).otherwise(1)
    empty = F.array_repeat(F.lit(""), width)
    head = F.when(has_header, F.coalesce(header, F.array().cast("array<string>"))).otherwise(empty)
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---"), F.greatest(F.size(head), F.lit(1))), "|"), F.lit("|"))
    return F.array_join(F.concat(F.array(_row(head), rule), F.transform(rows, _row)), "\n")


def render_block(b: Column) -> Column:
    """One block (a struct of the blocks table) as Markdown."""
    items = F.transform(F.filter(T.lines(b["text"]), lambda x: ~T.blank(x)), lambda x: F.concat(F.lit("- "), T.strip(x)))
    text = F.coalesce(b["text"], F.lit(""))
    return (
        F.when(b["kind"] == "table", render_table(F.coalesce(b["has_header"], F.lit(False)), b["header"], b["rows"]))
        .when(b["kind"] == "heading", F.concat(F.lit("## "), text))
        .when(b["kind"] == "caption", F.concat(F.lit("*"), text, F.lit("*")))
        .when(b["kind"] == "list", F.array_join(items, "\n"))
        .otherwise(text)
    )


def render_documents(pages: DataFrame, titles: DataFrame | None = None, order: str = "page_no") -> DataFrame:
    """(doc_id, markdown): a title line, then each page's head and blocks, in order. Pages
    whose blocks are null (failed, or an image only) add nothing."""
    kept = pages.where("blocks is not null")
    head = F.concat(F.lit("\n---\n\n*(page "), F.col("page_no").cast("string"), F.lit(")*\n"))
    body = F.array_join(F.concat(F.array(head), F.transform("blocks", render_block)), "\n")
    parts = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), body.alias("md")))).alias("p"))
    title = F.concat(F.lit("# "), F.coalesce(F.col("title"), F.col("doc_id").cast("string")), F.lit("\n"))
    rows = parts.join(titles, "doc_id", "left") if titles is not None else parts.withColumn("title", F.lit(None).cast("string"))
    return rows.select("doc_id", F.array_join(F.concat(F.array(title), F.transform("p", lambda x: x["md"])), "\n").alias("markdown"))


def write_markdown(documents: DataFrame, path: str) -> None:
    """One text row per document, in folders by document."""
    documents.select("doc_id", F.col("markdown").alias("value")).write.partitionBy("doc_id").text(path)
