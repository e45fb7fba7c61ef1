"""Repairs: dropped lines and table rows come back from the source.

Insertions move what comes after them, so they are folds over small arrays of one page;
finding what to insert is joins and windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import BLOCK, KEY
from .select import real_rows
from .spatial import kind_of_line, restored_look

_BLOCK_NAMES = [x.split()[0] for x in BLOCK.split(", ")]


def insert_at(items: Column, new: Column, place) -> Column:
    """Items with every new element (an array, in order) put in at ``place(so far, element)``,
    an index from 0 that is cut to the end. ``new`` elements have a field ``item``."""

    def step(acc: Column, x: Column) -> Column:
        at = F.least(place(acc, x), F.size(acc))
        return F.concat(F.slice(acc, F.lit(1), at), F.array(x["item"]), F.slice(acc, at + 1, F.size(acc) - at))

    return F.aggregate(new, items, step)


_LINE = ("ord", "text", "size", "x0", "y0", "x1", "y1")
_BOX = ("x0", "y0", "x1", "y1")


def _covers(line: Column, boxes: Column, share: float = 0.5) -> Column:
    """Whether a box covers more than the share of a line."""

    def over(b: Column) -> Column:
        wide = F.greatest(F.least(line["x1"], b["x1"]) - F.greatest(line["x0"], b["x0"]), F.lit(0.0))
        high = F.greatest(F.least(line["y1"], b["y1"]) - F.greatest(line["y0"], b["y0"]), F.lit(0.0))
        return wide * high / F.greatest((line["x1"] - line["x0"]) * (line["y1"] - line["y0"]), F.lit(1.0)) > share

    return F.exists(boxes, over)


def put_back(pages: DataFrame) -> DataFrame:
    """Pages that carry all they need in their own row: blocks, width_pt, ``lines`` (array of
    ord, text, size, x0, y0, x1, y1, in scan order), ``missing`` (array of texts) and ``boxes``
    (array of x0, y0, x1, y1). Every missing text stands for the first line that normalises
    like it; it is put back where its share of the page's text says, unless a table covers it.
    Adds restored and skipped. Nothing is shuffled."""
    kinds = dict(x.split(" ", 1) for x in BLOCK.split(", "))
    add = lambda items: F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + x)

    def item(l: Column, body: Column) -> Column:
        look = restored_look(l["size"], body, l["x0"], l["x1"], F.col("width_pt"))
        block = {"kind": kind_of_line(l["size"], body), "text": l["text"], "align": look["align"], "size": look["size"], "bold": look["bold"]}
        return F.struct(*(block.get(n, F.lit(None)).cast(kinds[n]).alias(n) for n in _BLOCK_NAMES))

    def result(ls: Column, keys: Column, want: Column) -> Column:
        size = lambda l: F.length(l["text"]).cast("long")
        sizes = F.array_distinct(F.transform(ls, lambda l: F.bround(l["size"], 0)))
        weigh = lambda s, i: F.struct(add(F.transform(F.filter(ls, lambda l: F.bround(l["size"], 0) == s), size)).alias("w"), (-i).alias("o"), s.alias("v"))
        body = F.array_max(F.transform(sizes, weigh))["v"]
        total = F.greatest(add(F.transform(ls, size)), F.lit(1))
        wanted = F.filter(ls, lambda l, i: T.let(F.get(keys, i), lambda k: F.array_contains(want, k) & (F.array_position(keys, k) == i + 1)))
        above = lambda l: add(F.transform(F.filter(ls, lambda m: m["y0"] < l["y0"]), size))
        placed = lambda free, b, t: F.array_sort(F.transform(free, lambda l: F.struct((-above(l) / t).alias("down"), l["ord"].alias("ord"), item(l, b).alias("item"))))

        def parts(found: Column) -> Column:
            free = F.filter(found, lambda l: ~_covers(l, F.col("boxes")))
            new = T.let(body, lambda b: T.let(total, lambda t: placed(free, b, t)))
            return T.let(
                new,
                lambda n: F.struct(
                    insert_at(F.col("blocks"), n, lambda acc, x: F.bround(-x["down"] * F.size(acc), 0).cast("int")).alias("blocks"),
                    F.size(n).alias("restored"),
                    (F.size(found) - F.size(n)).alias("skipped"),
                ),
            )

        return T.let(wanted, parts)

    want = F.array_distinct(F.transform("missing", T.normalize))
    made = F.when(
        F.size("missing") > 0,
        T.let(F.col("lines"), lambda ls: T.let(F.transform(ls, lambda l: T.normalize(l["text"])), lambda keys: T.let(want, lambda w: result(ls, keys, w)))),
    )
    rest = [c for c in pages.columns if c not in ("blocks", "lines", "missing", "boxes")]
    out = pages.select(*pages.columns, made.alias("__made"))
    return out.select(
        *rest,
        F.coalesce("__made.blocks", "blocks").alias("blocks"),
        F.coalesce("__made.restored", F.lit(0)).alias("restored"),
        F.coalesce("__made.skipped", F.lit(0)).alias("skipped"),
    )


def restore_lines(pages: DataFrame, lines: DataFrame, missing: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pages (blocks array, width_pt) with missing lines put back (see ``put_back``), from
    tables: each is gathered once by page."""
    gather = lambda df, name, value: df.groupBy(*KEY).agg(F.array_sort(F.collect_list(value)).alias(name))
    lost = gather(missing, "missing", F.col("line"))
    rows = pages.join(lost, KEY, "left").join(gather(lines, "lines", F.struct(*_LINE)), KEY, "left").join(gather(boxes, "boxes", F.struct(*_BOX)), KEY, "left")
    empty = lambda c: F.array().cast(rows.schema[c].dataType)
    return put_back(rows.withColumns({c: F.coalesce(c, empty(c)) for c in ("missing", "lines", "boxes")}))


def paired_tables(blocks: DataFrame, detected: DataFrame) -> DataFrame:
    """The i-th table of a page's blocks with the i-th detected one from the top; what one
    side has more drops out."""
    page = Window.partitionBy(*KEY)
    model = blocks.where(F.col("kind") == "table").withColumn("rn", F.row_number().over(page.orderBy("block_ord")))
    order = ["y0", "ord"] if "ord" in detected.columns else ["y0", "x0"]
    other = detected.withColumn("rn", F.row_number().over(page.orderBy(*order))).select(*KEY, "rn", "grid", "col_count")
    return model.join(other, [*KEY, "rn"])


def row_key(row: Column) -> Column:
    return T.normalize(F.array_join(row, " "))


def missing_rows(pairs: DataFrame) -> DataFrame:
    """Adds new: rows (pos, item) of the detected table that the extracted one lacks, cut or
    filled up to its columns; pos is where an equal row first stands."""
    grid = F.transform(real_rows(F.col("grid")), lambda r: F.transform(r, lambda c: T.collapse(F.coalesce(c, F.lit("")))))
    data = F.when(F.col("has_header"), F.slice(grid, 2, 1 << 30)).otherwise(grid)
    rows = pairs.withColumn("data", data)
    lack = T.let(
        F.transform("rows", row_key),
        lambda have: F.filter("data", lambda r: T.let(row_key(r), lambda k: (k != "") & ~F.array_contains(have, k))),
    )
    new = F.transform(lack, lambda r: F.struct((F.array_position(F.col("data"), r) - 1).cast("int").alias("pos"), T.padded(r, F.col("n_cols")).alias("item")))
    return rows.withColumn("new", new).drop("data")


def restore_rows(pairs: DataFrame) -> DataFrame:
    """Paired tables with their missing rows put in; n_data_rows follows. Adds restored."""
    rows = missing_rows(pairs)
    put = insert_at(F.col("rows"), F.col("new"), lambda acc, x: x["pos"])
    rows = rows.withColumn("restored", F.size("new")).withColumn("rows", put)
    return rows.withColumn("n_data_rows", F.when(F.col("restored") > 0, F.size("rows")).otherwise(F.col("n_data_rows"))).drop("new")


def repair_policy(pages: DataFrame) -> DataFrame:
    """Adds what a page's trust allows: lines back from a text layer only, rows unless the
    text is OCR's, look unless the page is scanned, and reporting of lines OCR saw."""
    trust = F.col("verify_trust")
    return pages.select(
        "*",
        (trust == "pdf").alias("repair_lines"),
        (trust != "ocr").alias("repair_rows"),
        (~F.col("scanned")).alias("measure_look"),
        (trust == "ocr").alias("report_lines"),
    )
