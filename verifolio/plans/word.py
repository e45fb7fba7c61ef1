"""Plan of a Word document: what is written, in order, with every size decided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.spatial import dominant
from ..schema import KEY
from .ordered import interleaved, order_window, table_width

# Relative sizes of the labels, and the limits of a written size.
SCALE = {"small": 0.8, "normal": 1.0, "large": 1.6}
LEAST_PT, MOST_TIMES, CAPTION_PT = 8.0, 2.2, 9.0
BODY_PT, COLUMN_IN = 11.0, 6.5


def _base(size: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in SCALE.items() for x in kv)), F.coalesce(size, F.lit("normal")))


def size_anchor(blocks: DataFrame) -> DataFrame:
    """(doc_id, anchor): the size label that most characters of a document's text blocks
    have, of equal ones the first met. What the document mostly is counts as normal."""
    texts = blocks.where("kind <> 'table'")
    return dominant(texts, ["doc_id"], F.coalesce("size", F.lit("normal")), F.length("text"), F.struct("page_no", "block_ord"), "anchor")


def point_size(body: Column, factor: Column) -> Column:
    return F.bround(F.greatest(F.lit(LEAST_PT), F.least(body * factor, body * MOST_TIMES)), 1)


def grid(b: Column, width: Column) -> Column:
    """A table's rows on its grid, with whether each is a divider over the full width."""
    return F.transform(
        b["rows"],
        lambda r: T.let(
            T.padded(r, width),
            lambda c: F.struct(
                c.alias("cells"),
                ((width > 1) & (F.get(c, F.lit(0)) != "") & F.forall(F.slice(c, 2, 1 << 30), T.blank)).alias("divider"),
            ),
        ),
    )


def word_plan(pages: DataFrame, images: DataFrame, layouts: DataFrame | None = None, titles: DataFrame | None = None) -> DataFrame:
    """One row per written thing: doc_id, page_no, seq, op (title, heading, paragraph, caption,
    item, table, image, page_break), text, align, bold, point, header, grid, width_in, ratio
    (height by width of a picture), path.

    ``titles`` (doc_id, title) are written first, unless ``layouts`` are given: a source that is
    matched has no such line. Skipped and reshaped things are in ``write_problems``."""
    b = F.col("b")
    rows = interleaved(pages, images)
    anchor = size_anchor(pages.select(*KEY, F.posexplode("blocks").alias("block_ord", "b")).select(*KEY, "block_ord", "b.kind", "b.size", "b.text"))
    rows = rows.join(anchor, "doc_id", "left")
    if layouts is not None:
        rows = rows.join(layouts.select("doc_id", "width_pt", "left_pt", "right_pt", "body_pt"), "doc_id", "left")
    else:
        rows = rows.withColumns({c: F.lit(None).cast("double") for c in ("width_pt", "left_pt", "right_pt", "body_pt")})
    body = F.coalesce("body_pt", F.lit(BODY_PT))
    factor = _base(b["size"]) / _base(F.col("anchor"))
    heading = b["kind"] == "heading"
    column = F.coalesce((F.col("width_pt") - F.col("left_pt") - F.col("right_pt")) / 72.0, F.lit(COLUMN_IN))
    width = table_width(b)
    text = T.strip(T.unescape(T.strip(b["text"])))
    written = F.when(F.col("is_block") == 0, True).when(b["kind"] == "table", width > 0).otherwise(~T.blank(b["text"]))
    op = (
        F.when(F.col("is_block") == 0, "image")
        .when(b["kind"].isin("table", "heading", "caption"), b["kind"])
        .when(b["kind"] == "list", "item")
        .otherwise("paragraph")
    )
    sized = (factor != 1.0) | (~heading & (b["kind"] != "caption"))
    point = F.when(b["kind"].isin("table", "list"), F.lit(None)).when((b["kind"] == "caption") & (factor == 1.0), CAPTION_PT).when(sized, point_size(body, factor))
    none = F.lit(None)
    planned = rows.where(written).select(
        *KEY,
        "slot",
        "is_block",
        "img_ord",
        op.alias("op"),
        F.when(b["kind"] == "list", T.list_items(T.strip(b["text"]))).when(F.col("is_block") == 1, F.array(F.when(b["kind"] == "table", none).otherwise(text))).otherwise(F.array(none.cast("string"))).alias("texts"),
        F.when((F.col("is_block") == 1) & (b["kind"] != "table") & (b["kind"] != "list"), F.coalesce(b["align"], F.lit("left"))).alias("align"),
        F.coalesce(b["bold"], F.lit(False)).alias("bold"),
        point.cast("double").alias("point"),
        F.when((b["kind"] == "table") & b["has_header"], b["header"]).alias("header"),
        F.when(b["kind"] == "table", grid(b, width)).alias("grid"),
        F.least(F.col("image.width_in"), column).alias("width_in"),
        _ratio(images).alias("ratio"),
        F.col("image.path").alias("path"),
    )
    items = planned.select("*", F.posexplode("texts").alias("part", "text")).drop("texts")
    targets = pages.select(*KEY).distinct()
    last = targets.groupBy("doc_id").agg(F.max("page_no").alias("__last"))
    breaks = targets.join(last, "doc_id").where(F.col("page_no") < F.col("__last")).select(
        *KEY, F.lit(1 << 30).alias("slot"), F.lit(2).alias("is_block"), F.lit(-1).alias("img_ord"), F.lit("page_break").alias("op"), F.lit(0).alias("part")
    )
    every = items.unionByName(breaks, allowMissingColumns=True)
    if titles is not None and layouts is None:
        first = targets.groupBy("doc_id").agg(F.min("page_no").alias("page_no")).join(titles, "doc_id").where(~T.blank(F.col("title")))
        heads = first.select(*KEY, F.lit(-1).alias("slot"), F.lit(0).alias("is_block"), F.lit(-1).alias("img_ord"), F.lit("title").alias("op"), F.lit(0).alias("part"), F.col("title").alias("text"))
        every = every.unionByName(heads, allowMissingColumns=True)
    seq = F.row_number().over(order_window("doc_id").orderBy("page_no", "slot", "is_block", "img_ord", "part"))
    return every.select("doc_id", "page_no", seq.alias("seq"), "op", "text", "align", "bold", "point", "header", "grid", "width_in", "ratio", "path")


def _ratio(images: DataFrame) -> Column:
    """Height by width: of the pixels where they are known, else of the place on the page."""
    known = {"px_w", "px_h", "width_in", "height_in"} & set(images.columns)
    of = lambda a, b: F.when((F.col(f"image.{a}") > 0) & (F.col(f"image.{b}") > 0), F.col(f"image.{b}") / F.col(f"image.{a}")) if {a, b} <= known else F.lit(None)
    return F.coalesce(of("px_w", "px_h"), of("width_in", "height_in")).cast("double")


def scan_plan(pages: DataFrame, images: DataFrame, layouts: DataFrame | None = None) -> DataFrame:
    """The plan of a separate document that holds the scanned pages' pictures and no text, of
    documents that have any; every page of theirs is a page of it."""
    blank = pages.select(*KEY, F.array().cast(pages.schema["blocks"].dataType).alias("blocks"))
    return word_plan(blank.join(images.select("doc_id").distinct(), "doc_id", "left_semi"), images, layouts)


def write_problems(pages: DataFrame) -> DataFrame:
    """What a writer skips or reshapes: tables without rows or columns, ragged rows, blanks."""
    b = F.col("b")
    rows = pages.select(*KEY, F.posexplode("blocks").alias("block_ord", "b"))
    width = table_width(b)
    where = F.concat(F.lit("page "), F.col("page_no").cast("string"), F.lit(" block["), F.col("block_ord").cast("string"), F.lit("]"))
    ragged = F.filter(
        F.transform(
            b["rows"],
            lambda r, i: F.when(
                (width > 0) & (F.size(r) != width),
                F.concat(where, F.lit(" row "), i.cast("string"), F.lit(": "), F.size(r).cast("string"), F.lit(" cells on a grid of "), width.cast("string"), F.when(F.size(r) < width, ", padded").otherwise(", cut")),
            ),
        ),
        lambda x: x.isNotNull(),
    )
    table = b["kind"] == "table"
    found = (
        F.when(table & width.isNull(), F.array(F.concat(where, F.lit(": table without rows, skipped"))))
        .when(table & (width == 0), F.array(F.concat(where, F.lit(": table without columns, skipped"))))
        .when(table, ragged)
        .when(T.blank(b["text"]), F.array(F.concat(where, F.lit(": empty "), b["kind"], F.lit(", skipped"))))
    )
    return rows.select(*KEY, "block_ord", F.explode(found).alias("message"))


def verify_images(expected: DataFrame, written: DataFrame) -> DataFrame:
    """Pictures of a written document against the extracted ones, paired by order.

    ``expected``: doc_id, ord, sha1, text_before, text_after. ``written``: doc_id, ord,
    kind (image or text) in body order, sha1, text. Findings: doc_id, check, message."""
    from pyspark.sql import Window

    body = Window.partitionBy("doc_id").orderBy("ord")
    norm = F.when(F.col("kind") == "text", T.normalize(F.col("text")))
    seen = written.withColumn("before", F.last(norm, True).over(body.rowsBetween(Window.unboundedPreceding, -1))).withColumn(
        "after", F.first(norm, True).over(body.rowsBetween(1, Window.unboundedFollowing))
    )
    shapes = seen.where("kind = 'image'").select("doc_id", F.row_number().over(body).alias("rn"), F.col("sha1").alias("w_sha1"), "before", "after")
    wanted = expected.select("doc_id", F.row_number().over(body).alias("rn"), "sha1", "text_before", "text_after")
    counts = wanted.groupBy("doc_id").agg(F.count(F.lit(1)).alias("e")).join(shapes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("w")), "doc_id", "full")
    e, w = F.coalesce("e", F.lit(0)), F.coalesce("w", F.lit(0))
    count = counts.where(e != w).select("doc_id", F.lit("COUNT").alias("check"), F.concat(e.cast("string"), F.lit(" extracted, "), w.cast("string"), F.lit(" written")).alias("message"))
    both = wanted.join(shapes, ["doc_id", "rn"])
    number = F.concat(F.lit("image "), (F.col("rn") - 1).cast("string"))
    head = lambda c: F.substring(T.normalize(F.col(c)), 1, 40)
    off = lambda want, got: (F.coalesce(F.length(want), F.lit(0)) > 0) & ~F.contains(F.coalesce(got, F.lit("")), head(want))
    other = both.select(
        "doc_id",
        F.explode(
            F.filter(
                F.array(
                    F.when(~F.col("sha1").eqNullSafe(F.col("w_sha1")), F.struct(F.lit("BYTES").alias("check"), F.concat(number, F.lit(" differs")).alias("message"))),
                    F.when(off("text_before", F.col("before")), F.struct(F.lit("POSITION").alias("check"), F.concat(number, F.lit(" should follow "), F.substring("text_before", 1, 40)).alias("message"))),
                    F.when(off("text_after", F.col("after")), F.struct(F.lit("POSITION").alias("check"), F.concat(number, F.lit(" should precede "), F.substring("text_after", 1, 40)).alias("message"))),
                ),
                lambda x: x.isNotNull(),
            )
        ).alias("f"),
    ).select("doc_id", "f.*")
    return count.unionByName(other)
