"""PDF files as the engine's tables, through whichever provider reads them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import KEY
from .providers import Provider, provided, provider


@dataclass
class PdfTables:
    pages: DataFrame
    spans: DataFrame
    geo: DataFrame
    detected: DataFrame
    images: DataFrame
    errors: DataFrame


def read_pages(files: DataFrame, made_by: Provider | None = None) -> DataFrame:
    """One row per page of files (path, content), with what the provider saw on it; a file that
    cannot be read is one row with its error. ``doc_id`` is the file's path."""
    return provided(files, made_by or provider("pdf")).withColumnRenamed("path", "doc_id")


def pdf_tables(read: DataFrame) -> PdfTables:
    """The tables of the engine from read pages."""
    good = read.where("error is null")
    part = lambda column, *names: good.select(*KEY, F.explode(column).alias("x")).select(*KEY, *(f"x.{n}" for n in names))
    box = ("x0", "y0", "x1", "y1")
    return PdfTables(
        good.select(*KEY, "width_pt", "height_pt", "source_text", F.lit(None).cast("string").alias("ocr_text")),
        part("spans", "blk", "line", "span", "text", "size", "font", *box),
        part("geo", "ord", *box, "text"),
        part("tables", "ord", *box, "col_count", "grid"),
        part("images", "ord", *box, "px_w", "px_h", "ext", "data"),
        read.where("error is not null").select("doc_id", "error"),
    )


def pdf_summary(read: DataFrame) -> DataFrame:
    """Per file: the text of all pages, joined by line ends, its pages, images, and tables
    (rows, cols), for ``checks.converted``."""
    page = F.struct("page_no", F.coalesce("source_text", F.lit("")).alias("text"), "tables", F.coalesce(F.size("images"), F.lit(0)).alias("n"))
    rows = read.where("error is null").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", page.alias("p")))).alias("ps"))
    pages = F.transform("ps", lambda x: x["p"])
    none = F.array().cast(read.schema["tables"].dataType)
    tables = F.flatten(F.transform(pages, lambda p: F.coalesce(p["tables"], none)))
    return rows.select(
        "doc_id",
        F.array_join(F.transform(pages, lambda p: p["text"]), "\n").alias("text"),
        F.size("ps").alias("pages"),
        F.aggregate(pages, F.lit(0), lambda a, p: a + p["n"]).alias("images"),
        F.transform(tables, lambda t: F.struct(F.size(t["grid"]).alias("rows"), t["col_count"].alias("cols"))).alias("tables"),
    )
