"""Operators over coordinates: sizes, reading order, neighbours, overlap, layout, look."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import KEY

# Page sizes in inches, portrait.
STANDARD_PAGES = (
    ("Letter", 8.5, 11.0),
    ("Legal", 8.5, 14.0),
    ("A4", 8.27, 11.69),
    ("A3", 11.69, 16.54),
    ("A5", 5.83, 8.27),
    ("Tabloid", 11.0, 17.0),
)
OVERSIZE_IN = 17.5
RATIO_ERROR = 0.02


def line_table(spans: DataFrame) -> DataFrame:
    """Lines of text from spans: concatenated text without outer blanks, largest size, box,
    and whether a bold font is in it. Blank lines go; ``ord`` is the scan order."""
    rows = spans.groupBy(*KEY, "blk", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", "text"))), lambda s: s["text"]), "").alias("text"),
        F.max("size").alias("size"),
        F.min("x0").alias("x0"),
        F.min("y0").alias("y0"),
        F.max("x1").alias("x1"),
        F.max("y1").alias("y1"),
        F.bool_or(F.lower("font").contains("bold")).alias("bold"),
    )
    kept = rows.withColumn("text", T.strip(F.col("text"))).where(F.length("text") > 0)
    return kept.withColumn("ord", F.struct("blk", "line"))


def dominant(df: DataFrame, keys: list[str], value: Column, weight: Column, order: Column, name: str) -> DataFrame:
    """The value with the most weight in each group; of equal ones the first in order."""
    sums = df.groupBy(*keys, value.alias("__v")).agg(F.sum(weight).alias("__w"), F.min(order).alias("__o"))
    best = sums.groupBy(*keys).agg(F.max("__w").alias("__top"))
    top = sums.join(best, keys).where(F.col("__w") == F.col("__top"))
    return top.groupBy(*keys).agg(F.min_by("__v", "__o").alias(name))


def body_size(lines: DataFrame, digits: int = 0) -> DataFrame:
    """The font size that most characters of a page have, rounded half to even."""
    return dominant(lines, KEY, F.bround("size", digits), F.length("text"), F.col("ord"), "body")


def text_above(lines: DataFrame) -> DataFrame:
    """Adds above: characters in lines that begin strictly higher, and total: all of them."""
    page = Window.partitionBy(*KEY)
    upto = page.orderBy("y0").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("text")
    return lines.withColumn("above", F.sum(size).over(upto) - F.sum(size).over(page.partitionBy(*KEY, "y0"))).withColumn("total", F.sum(size).over(page))


def image_places(images: DataFrame, geo: DataFrame) -> DataFrame:
    """Adds to images (ord, y0, y1): frac_above, text_before and text_after.

    Text blocks and pictures of a page are one table, sorted twice: downwards by where blocks
    end and pictures begin, upwards by where blocks begin and pictures end. What stands above
    or below a picture is then a running sum, maximum or minimum: no picture meets every block."""
    picture = F.struct(*images.columns)
    placed = F.struct("y0", "y1", "x0", T.collapse(F.col("text")).alias("t"))
    blocks = geo.where(~T.blank(F.col("text"))).select(
        *KEY, F.col("y1").alias("down"), F.col("y0").alias("up"), F.lit(0).alias("is_image"), F.length("text").alias("n"), placed.alias("g")
    )
    rows = blocks.unionByName(
        images.select(*KEY, F.col("y0").alias("down"), F.col("y1").alias("up"), F.lit(1).alias("is_image"), picture.alias("image")), allowMissingColumns=True
    )
    page = Window.partitionBy(*KEY)
    so_far = (Window.unboundedPreceding, Window.currentRow)
    above = page.orderBy("down", "is_image").rowsBetween(*so_far)
    below = page.orderBy(F.desc("up"), "is_image").rowsBetween(*so_far)
    found = rows.select(
        "*",
        F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n_above"),
        F.max("g").over(above).alias("before"),
        F.min("g").over(below).alias("after"),
        F.coalesce(F.sum("n").over(page), F.lit(0)).alias("total"),
    ).where("is_image = 1")
    return found.select(
        "image.*",
        (F.col("n_above") / F.greatest("total", F.lit(1))).alias("frac_above"),
        F.col("before.t").alias("text_before"),
        F.col("after.t").alias("text_after"),
    )


def overlap(a: tuple[str, str, str, str], b: tuple[str, str, str, str]) -> Column:
    """Share of box a (x0, y0, x1, y1) that box b covers."""
    (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = (map(F.col, x) for x in (a, b))
    wide = F.greatest(F.least(ax1, bx1) - F.greatest(ax0, bx0), F.lit(0.0))
    high = F.greatest(F.least(ay1, by1) - F.greatest(ay0, by0), F.lit(0.0))
    return wide * high / F.greatest((ax1 - ax0) * (ay1 - ay0), F.lit(1.0))


# Fixed value: the share of a line that a table must cover to hold it.
def outside_tables(lines: DataFrame, boxes: DataFrame, share: float = 0.5, how: str = "left_anti") -> DataFrame:
    """Lines that no table box covers by more than the share (or, left_semi, that one does)."""
    names = ("x0", "y0", "x1", "y1")
    other = boxes.select(*(F.col(c).alias(f"t_{c}") for c in (*KEY, *names)))
    on = (F.col("doc_id") == F.col("t_doc_id")) & (F.col("page_no") == F.col("t_page_no"))
    return lines.join(other, on & (overlap(names, tuple(f"t_{c}" for c in names)) > share), how)


def standard_page(width_pt: Column, height_pt: Column) -> Column:
    """The page box (name, width_pt, height_pt) of a page declared in pixels: an oversized
    box whose proportions fit a standard size gets that size; others stay, without a name."""
    w, h = width_pt / 72.0, height_pt / 72.0
    ratio = F.when(h != 0, w / h).otherwise(1.0)
    sizes = [(n, a, b) for n, sw, sh in STANDARD_PAGES for a, b in ((sw, sh), (sh, sw))]
    fits = F.array(
        *(
            F.struct(
                (F.abs(ratio - a / b) / (a / b)).alias("error"),
                F.lit(i).alias("ord"),
                F.lit(n).alias("name"),
                F.lit(a * 72).alias("width_pt"),
                F.lit(b * 72).alias("height_pt"),
            )
            for i, (n, a, b) in enumerate(sizes)
        )
    )
    best = F.array_min(fits)
    fitted = F.struct(best["name"].alias("name"), best["width_pt"].alias("width_pt"), best["height_pt"].alias("height_pt"))
    as_is = F.struct(F.lit(None).cast("string").alias("name"), width_pt.cast("double").alias("width_pt"), height_pt.cast("double").alias("height_pt"))
    return F.when((F.greatest(w, h) > OVERSIZE_IN) & (best["error"] < RATIO_ERROR), fitted).otherwise(as_is)


def page_layout(pages: DataFrame, geo: DataFrame, spans: DataFrame) -> DataFrame:
    """width_pt, height_pt, margins and body_pt of every page. Margins come from where text
    stands, scaled with a corrected box; the bottom mirrors the top; without text all are 72."""
    kept = geo.where(~T.blank(F.col("text")))
    edge = kept.groupBy(*KEY).agg(F.min("x0").alias("low_x"), F.max("x1").alias("high_x"), F.min("y0").alias("low_y"))
    order = F.struct("blk", "line", "span")
    body = dominant(spans, KEY, F.bround("size", 0), F.length("text"), order, "body")
    box = standard_page(F.col("width_pt"), F.col("height_pt"))
    rows = pages.select(*KEY, "width_pt", "height_pt", box.alias("box")).join(edge, KEY, "left").join(body, KEY, "left")
    scale = F.when(F.col("width_pt") != 0, F.col("box.width_pt") / F.col("width_pt")).otherwise(1.0)
    top = F.coalesce(F.col("low_y") * scale, F.lit(72.0))
    return rows.select(
        *KEY,
        F.col("box.width_pt").alias("width_pt"),
        F.col("box.height_pt").alias("height_pt"),
        F.coalesce(F.col("low_x") * scale, F.lit(72.0)).alias("left_pt"),
        F.coalesce((F.col("width_pt") - F.col("high_x")) * scale, F.lit(72.0)).alias("right_pt"),
        top.alias("top_pt"),
        top.alias("bottom_pt"),
        F.coalesce("body", F.lit(11.0)).alias("body_pt"),
    )


def document_layout(layouts: DataFrame, targets: DataFrame) -> DataFrame:
    """The layout of each document's first processed page, by target_ord."""
    names = [c for c in layouts.columns if c not in KEY]
    rows = layouts.join(targets.select(*KEY, "target_ord"), KEY)
    return rows.groupBy("doc_id").agg(F.min_by(F.struct(*names), "target_ord").alias("layout")).select("doc_id", "layout.*")


# Fixed values below: the shares of the body size, and the distances in points, that tell
# headings, captions and alignment.
def kind_of_line(size: Column, body: Column) -> Column:
    return F.when(size >= body * 1.25, "heading").when(size <= body * 0.88, "caption").otherwise("paragraph")


def restored_look(size: Column, body: Column, x0: Column, x1: Column, page_width: Column) -> Column:
    """align and size of a line that comes back from the text layer; never bold."""
    centred = F.abs((x0 + x1) / 2 - page_width / 2) < 20
    return F.struct(
        F.when(centred, "center").otherwise("left").alias("align"),
        F.when(size >= body * 1.25, "large").when(size <= body * 0.88, "small").otherwise("normal").alias("size"),
        F.lit(False).alias("bold"),
    )


def measured_look(size: Column, body: Column, x0: Column, x1: Column, page_width: Column, bold: Column) -> Column:
    """align, size and bold of a block, from the line it begins with."""
    left, right = x0, page_width - x1
    centred = (F.abs((x0 + x1) / 2 - page_width / 2) < 24) & (left > 40) & (right > 40)
    return F.struct(
        F.when(centred, "center").when((left > right * 3) & (left > 100), "right").otherwise("left").alias("align"),
        F.when(size >= body * 1.15, "large").when(size <= body * 0.85, "small").otherwise("normal").alias("size"),
        bold.alias("bold"),
    )


def first_line(blocks: DataFrame, lines: DataFrame, head: int = 20, least: int = 6) -> DataFrame:
    """Blocks with the line they begin with: of the page's lines, in scan order, the first
    that starts with the block's normalised head, else the first that contains it. Blocks
    that are tables, blank, or short of head have none, and are left out."""
    texts = blocks.where((F.col("kind") != "table") & ~T.blank(F.col("text"))).select(*KEY, "block_ord", F.substring(T.normalize(F.col("text")), 1, head).alias("head"))
    texts = texts.where(F.length("head") >= least)
    other = lines.select(*(F.col(k).alias(f"l_{k}") for k in KEY), T.normalize(F.col("text")).alias("l_text"), F.struct("ord", "size", "x0", "x1", "bold").alias("line"))
    on = (F.col("doc_id") == F.col("l_doc_id")) & (F.col("page_no") == F.col("l_page_no"))
    # a head of full length that begins a line equals that line's head: an equality for most
    heads = other.select("l_doc_id", "l_page_no", F.substring("l_text", 1, head).alias("l_head"), "line").where(F.length("l_head") == head)
    heads = heads.groupBy("l_doc_id", "l_page_no", "l_head").agg(F.min_by("line", "line.ord").alias("line"))
    equal = texts.join(heads, on & (F.col("head") == F.col("l_head")), "left").select(*KEY, "block_ord", "head", "line")
    rest = equal.where("line is null").drop("line").join(other, on & F.contains("l_text", F.col("head")))
    prefix = F.startswith("l_text", F.col("head"))
    searched = rest.groupBy(*KEY, "block_ord").agg(F.min_by("line", F.struct(~prefix, F.col("line.ord"))).alias("line"))
    return equal.where("line is not null").select(*KEY, "block_ord", "line").unionByName(searched)


def measure_look(blocks: DataFrame, lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks whose size, weight and alignment are measured where their text is found;
    others keep what they have. Adds measured."""
    body = body_size(lines, 1)
    place = first_line(blocks, lines).join(body, KEY).join(pages.select(*KEY, F.col("width_pt").alias("page_width")), KEY)
    line = F.col("line")
    look = measured_look(line["size"], F.col("body"), line["x0"], line["x1"], F.col("page_width"), line["bold"])
    found = place.select(*KEY, "block_ord", look.alias("look"))
    out = blocks.join(found, [*KEY, "block_ord"], "left")
    new = {c: F.coalesce(F.col(f"look.{c}"), F.col(c)) for c in ("align", "size", "bold")}
    return out.withColumns(new | {"measured": F.col("look").isNotNull()}).drop("look")
