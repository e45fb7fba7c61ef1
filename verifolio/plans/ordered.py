"""Reading order of blocks and pictures, shared by the Word and Excel plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import BLOCK, KEY

_BLOCK_NAMES = [x.split()[0] for x in BLOCK.split(", ")]


def image_slot(frac_above: Column, n_blocks: Column) -> Column:
    """The block a picture goes before, by the share of text above it; n_blocks is the end."""
    return F.least(n_blocks, F.bround(F.coalesce(frac_above, F.lit(1.0)) * n_blocks, 0).cast("int"))


def interleaved(pages: DataFrame, images: DataFrame) -> DataFrame:
    """Blocks and pictures of all pages in order: keys, slot, is_block, img_ord, b, image.

    Pictures of one slot go by their own order. ``pages`` has blocks (array); ``images``
    has ord, frac_above and what a plan needs of a picture."""
    n = F.size("blocks")
    blocks = pages.select(*KEY, F.posexplode("blocks").alias("slot", "b")).select(*KEY, "slot", F.lit(1).alias("is_block"), F.lit(-1).alias("img_ord"), "b")
    names = [c for c in images.columns if c not in KEY]
    placed = images.join(pages.select(*KEY, n.alias("__n")), KEY).select(
        *KEY, image_slot(F.col("frac_above"), F.col("__n")).alias("slot"), F.lit(0).alias("is_block"), F.col("ord").alias("img_ord"), F.struct(*names).alias("image")
    )
    return blocks.unionByName(placed, allowMissingColumns=True)


def order_window(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("page_no", "slot", "is_block", "img_ord")


def table_width(b: Column) -> Column:
    """Columns that a table is written with; null for what is no table with rows."""
    rows = F.coalesce(b["rows"], F.array().cast("array<array<string>>"))
    head = F.coalesce(F.size(b["header"]), F.lit(0))
    return F.when((b["kind"] == "table") & (F.size(rows) > 0), F.when(F.coalesce(b["has_header"], F.lit(False)), head).otherwise(F.size(F.get(rows, F.lit(0)))))
