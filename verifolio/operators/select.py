"""Selection: pages, images, scans, trust, and the rows of detected tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# The least size of a picture, in pixels and in points.
MIN_PIXELS = 40
MIN_POINTS = 28


def parse_pages(df: DataFrame, spec: str, count: str) -> DataFrame:
    """One row per selected page (target_ord, page_index from 0): ``all`` or a comma list of
    ``n`` and ``a-b``, 1-based and inclusive. Order and duplicates stay; pages outside go."""
    listed = F.when(F.lower(T.strip(F.col(spec))).isin("all", ""), F.concat(F.lit("1-"), F.col(count).cast("string"))).otherwise(F.col(spec))
    part = F.split(listed, ",")
    bounds = F.transform(part, lambda p: F.split(T.strip(p), "-"))
    first = lambda b: F.get(b, F.lit(0)).try_cast("int")
    pages = F.flatten(
        F.transform(
            F.filter(bounds, lambda b: first(b).isNotNull()),
            lambda b: F.when(first(b) <= F.coalesce(F.get(b, F.lit(1)).try_cast("int"), first(b)), F.sequence(first(b), F.coalesce(F.get(b, F.lit(1)).try_cast("int"), first(b)))).otherwise(
                F.array().cast("array<int>")
            ),
        )
    )
    inside = F.filter(pages, lambda p: (p >= 1) & (p <= F.col(count)))
    return df.select("*", F.posexplode(inside).alias("target_ord", "page_index")).withColumn("page_index", F.col("page_index") - 1)


def is_picture(px_w: Column, px_h: Column, width_pt: Column, height_pt: Column) -> Column:
    """False for spacers, rules and glyphs."""
    return (px_w >= MIN_PIXELS) & (px_h >= MIN_PIXELS) & (width_pt >= MIN_POINTS) & (height_pt >= MIN_POINTS)


def scanned(source_text: Column) -> Column:
    return T.blank(source_text)


def trust(source_text: Column, ocr_text: Column) -> Column:
    """Which text a page is verified against: pdf, ocr or none."""
    return F.when(~T.blank(source_text), "pdf").when(~T.blank(ocr_text), "ocr").otherwise("none")


def route_pages(pages: DataFrame, mode: str = "text") -> DataFrame:
    """Adds scanned, verify_trust, verify_text, image_only and image_use (embed, separate,
    discard) for a scan mode (text, image or both)."""
    if mode not in ("text", "image", "both"):
        raise ValueError("the scan mode is text, image or both")
    scan, kind = scanned(F.col("source_text")), trust(F.col("source_text"), F.col("ocr_text"))
    use = {"text": "discard", "both": "separate", "image": "embed"}[mode]
    return pages.select(
        "*",
        scan.alias("scanned"),
        kind.alias("verify_trust"),
        F.when(kind == "pdf", F.col("source_text")).when(kind == "ocr", F.col("ocr_text")).otherwise("").alias("verify_text"),
        (scan & F.lit(mode == "image")).alias("image_only"),
        F.when(scan, use).otherwise("embed").alias("image_use"),
    )


def real_rows(grid: Column) -> Column:
    """A grid without the blank rows at its end."""
    full = F.transform(grid, lambda r, i: F.when(F.exists(r, lambda c: ~T.blank(c)), i + 1).otherwise(0))
    return F.slice(grid, F.lit(1), F.coalesce(F.array_max(full), F.lit(0)))


def extracted_images(images: DataFrame) -> DataFrame:
    """Pictures of pages (schema ``IMAGES``) that are none of spacers, rules and glyphs, numbered
    anew on their page, with the sha1 of their bytes, their size in inches, and the name of
    the file that they become."""
    size = (F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    kept = images.where(is_picture(F.col("px_w"), F.col("px_h"), *size))
    ord_ = F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy("ord")) - 1
    return kept.withColumns(
        {
            "ord": ord_,
            "sha1": F.sha1("data"),
            "width_in": size[0] / 72.0,
            "height_in": size[1] / 72.0,
        }
    ).withColumn("path", F.format_string("%s/p%03d_img%02d.%s", F.col("doc_id").cast("string"), "page_no", "ord", "ext"))
