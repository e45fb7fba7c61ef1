"""Plan of an Excel sheet: cells with absolute rows, column widths, picture frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import KEY
from .ordered import interleaved, order_window, table_width

# Picture limits in inches, and the units of a sheet.
MOST_WIDE_IN, MOST_HIGH_IN, DEFAULT_IN = 6.5, 8.0, 2.0
DPI, PX_PER_CHAR, PX_PER_POINT = 96, 7.0, 96.0 / 72.0
MOST_CHARS = 60
NAME_CHARS = 31


def needs_quote(value: Column) -> Column:
    """Texts that a sheet would read as a formula."""
    return F.rlike(value, F.lit(r"^[=+\-@]"))


def picture_frame(width_in: Column, height_in: Column, px_w: Column, px_h: Column) -> Column:
    """Displayed size within limits, a missing side from the pixels' proportions, in pixels;
    with the column width in characters and the row height in points that frame it."""
    wide, high = F.coalesce(width_in, F.lit(0.0)), F.coalesce(height_in, F.lit(0.0))
    w = F.when(wide == 0, DEFAULT_IN).otherwise(F.least(wide, F.lit(MOST_WIDE_IN)))
    h = F.when(high == 0, DEFAULT_IN).otherwise(F.least(high, F.lit(MOST_HIGH_IN)))
    known = (F.coalesce(px_w, F.lit(0)) != 0) & (F.coalesce(px_h, F.lit(0)) != 0)
    ratio = px_h / px_w
    fit_h = F.when(known & (wide != 0) & (high == 0), w * ratio).otherwise(h)
    fit_w = F.when(known & (high != 0) & (wide == 0), h / ratio).otherwise(w)
    return F.struct(
        (fit_w * DPI).alias("px_w"),
        (fit_h * DPI).alias("px_h"),
        (fit_w * DPI / PX_PER_CHAR).alias("chars"),
        (fit_h * DPI / PX_PER_POINT).alias("points"),
    )


def sheet_items(pages: DataFrame, images: DataFrame) -> DataFrame:
    """Blocks and pictures with the row each begins at: a running sum of heights. A table
    has its rows and a blank one, a text two rows, a picture a blank row on either side,
    a page one more row at its end."""
    b = F.col("b")
    width = table_width(b)
    rows = F.size(b["rows"]) + F.coalesce(b["has_header"], F.lit(False)).cast("int")
    height = (
        F.when(F.col("is_block") == 0, 3)
        .when(F.col("is_block") == 2, 1)
        .when(b["kind"] == "table", F.when(width > 0, rows + 1).otherwise(0))
        .when(T.blank(b["text"]), 0)
        .otherwise(2)
    )
    ends = pages.select(*KEY, F.lit(1 << 30).alias("slot"), F.lit(2).alias("is_block"), F.lit(-1).alias("img_ord"))
    every = interleaved(pages, images).unionByName(ends, allowMissingColumns=True)
    before = order_window("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return every.withColumn("height", height).withColumn("row", 1 + F.coalesce(F.sum("height").over(before), F.lit(0)))


def sheet_cells(items: DataFrame) -> DataFrame:
    """doc_id, row, col, value, bold, quote. Rows are cut or filled up to the table's grid."""
    b = F.col("b")
    width = table_width(b)
    head = F.coalesce(b["has_header"], F.lit(False))
    lines = F.when(
        (b["kind"] == "table") & (width > 0),
        F.concat(
            F.when(head, F.array(F.struct(T.padded(b["header"], width).alias("cells"), F.lit(True).alias("bold")))).otherwise(F.array().cast("array<struct<cells:array<string>,bold:boolean>>")),
            F.transform(b["rows"], lambda r: F.struct(T.padded(r, width).alias("cells"), F.lit(False).alias("bold"))),
        ),
    ).when((b["kind"] != "table") & ~T.blank(b["text"]), F.array(F.struct(F.array(T.strip(b["text"])).alias("cells"), (b["kind"] == "heading").alias("bold"))))
    rows = items.where("is_block = 1").select("doc_id", "row", F.posexplode(lines).alias("down", "l"))
    cells = rows.select("doc_id", (F.col("row") + F.col("down")).alias("row"), F.posexplode("l.cells").alias("right", "value"), F.col("l.bold").alias("bold"))
    value = F.coalesce("value", F.lit(""))
    return cells.select("doc_id", F.col("row").cast("long"), (F.col("right") + 1).cast("long").alias("col"), value.alias("value"), "bold", needs_quote(value).alias("quote"))


def sheet_pictures(items: DataFrame) -> DataFrame:
    """doc_id, row, path and frame of the pictures; a picture stands below its blank row."""
    i = F.col("image")
    frame = picture_frame(i["width_in"], i["height_in"], i["px_w"], i["px_h"])
    return items.where("is_block = 0").select("doc_id", (F.col("row") + 1).cast("long").alias("row"), i["path"].alias("path"), frame.alias("frame"))


def column_widths(cells: DataFrame, most: int = MOST_CHARS) -> DataFrame:
    """doc_id, col, width: the longest line of the column's values and two, up to a limit."""
    longest = F.array_max(F.transform(F.split("value", "\n"), F.length))
    return cells.where("value is not null").groupBy("doc_id", "col").agg(F.least(F.max(longest) + 2, F.lit(most)).cast("long").alias("width"))


def sheet_name(title: Column) -> Column:
    return F.substring(title, 1, NAME_CHARS)
