"""Checks of an extraction against its source, as findings and measures.

Pages carry the text to verify against (``verify_text``) and their blocks as an array, so a
word or a cell is looked up in the text of its own row and nothing is shuffled for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import KEY, as_findings, finding
from .select import real_rows

# Thresholds of the checks.
COVERAGE = 0.95
GROUNDED_WORDS = 0.9
UNGROUNDED_CELLS = 0.8
LEAST_LINE = 8


def _is_table(b: Column) -> Column:
    return b["kind"] == "table"


def _cells(b: Column) -> Column:
    """Header labels and cells of a table, in order."""
    empty = F.array().cast("array<string>")
    return F.concat(F.coalesce(b["header"], empty), F.coalesce(F.flatten(b["rows"]), empty))


def block_label(ordinal: Column, kind: Column) -> Column:
    return F.concat(F.lit("block["), ordinal.cast("string"), F.lit("] kind="), F.coalesce(kind, F.lit("?")))


def structure(parsed: DataFrame) -> DataFrame:
    """Self-consistency findings of parsed pages (n_blocks, blocks). A wrong announcement is
    a note; a table without rows is one problem and nothing else of it is looked at."""
    got = F.size("blocks")
    kinds = F.array_join(F.transform("blocks", lambda b: b["kind"]), ", ")
    notes = as_findings(
        parsed.where("blocks is not null"),
        finding(
            got != F.col("n_blocks"),
            "structure",
            "note",
            F.concat(F.lit("announced "), F.col("n_blocks").cast("string"), F.lit(" blocks, got "), got.cast("string"), F.lit(" ("), kinds, F.lit(")")),
        ),
        keys=KEY,
    ).select(*KEY, F.lit(None).cast("int").alias("block_ord"), "check", "severity", "message")
    b = parsed.select(*KEY, F.posexplode("blocks").alias("block_ord", "b")).select(*KEY, "block_ord", "b.*")
    return notes.unionByName(block_structure(b))


def block_structure(blocks: DataFrame) -> DataFrame:
    """Findings of single blocks (columns of the blocks table)."""
    table, text = F.col("kind") == "table", F.col("kind") != "table"
    full = table & (F.size(F.coalesce("rows", F.array().cast("array<array<string>>"))) > 0)
    n_header = F.size(F.coalesce("header", F.array().cast("array<string>")))
    number = lambda c: c.cast("string")
    ragged = F.filter(F.transform("rows", lambda r, i: F.struct(i.alias("i"), F.size(r).alias("n"))), lambda x: x["n"] != F.col("n_cols"))
    listed = F.array_join(F.transform(ragged, lambda x: F.concat(number(x["i"]), F.lit(":"), number(x["n"]))), ", ")
    label = block_label(F.col("block_ord"), F.col("kind"))
    say = lambda *parts: F.concat(label, F.lit(": "), *(F.lit(p) if isinstance(p, str) else p for p in parts))
    return as_findings(
        blocks,
        finding(table & ~full, "structure", "problem", say("table without rows")),
        finding(full & (F.size("rows") != F.col("n_data_rows")), "structure", "problem", say("claims ", number(F.col("n_data_rows")), " rows, has ", number(F.size("rows")))),
        finding(full & F.col("has_header") & (n_header != F.col("n_cols")), "structure", "problem", say("claims ", number(F.col("n_cols")), " columns, header has ", number(n_header))),
        finding(full & ~F.col("has_header") & (n_header > 0), "structure", "problem", say("claims no header, has ", number(n_header), " labels")),
        finding(full & (F.size(ragged) > 0), "structure", "problem", say("claims ", number(F.col("n_cols")), " columns, rows differ: ", listed)),
        finding(text & T.blank(F.col("text")), "structure", "problem", say("no text")),
    )


def produced_text(blocks: Column) -> Column:
    """All the text of a page's blocks, cells included, joined by blanks."""
    parts = F.transform(blocks, lambda b: F.when(_is_table(b), F.array_join(_cells(b), " ")).otherwise(F.coalesce(b["text"], F.lit(""))))
    return F.array_join(parts, " ")


def source_words(source: Column) -> Column:
    """The distinct words of a text that are long enough to be looked for."""
    return F.array_distinct(T.words(T.normalize(source), T.SHORT))


def absent_words(words: Column, produced: Column) -> Column:
    """Distinct words that the produced text does not contain, in code point order. Most
    are words of it, which a set tells; only the others are searched for in the text."""
    return T.let(
        T.normalize(F.coalesce(produced, F.lit(""))),
        lambda n: T.let(
            F.replace(n, F.lit(" "), F.lit("")),
            lambda q: F.array_sort(F.filter(F.array_except(words, F.split(n, " ")), lambda w: ~F.contains(q, w))),
        ),
    )


def missing_words(source: Column, produced: Column) -> Column:
    """The source's words that the produced text does not contain."""
    return absent_words(source_words(source), produced)


def coverage_share(n_words: Column, n_missing: Column, source: Column) -> Column:
    """Null for a source without text, 1 for one without words."""
    return F.when(T.blank(source), F.lit(None).cast("double")).when(n_words == 0, 1.0).otherwise(1 - n_missing / n_words)


def coverage(pages: DataFrame, source: str, produced: str) -> DataFrame:
    """Adds n_words, missing (array) and coverage."""
    out = pages.withColumn("__words", source_words(F.col(source)))
    out = out.withColumns({"n_words": F.size("__words"), "missing": absent_words(F.col("__words"), F.col(produced))}).drop("__words")
    return out.withColumn("coverage", coverage_share(F.col("n_words"), F.size("missing"), F.col(source)))


def lost_lines(source: Column, produced: Column, split=T.lines) -> Column:
    """Lines of the source that the produced text does not contain, as an array of ord, raw
    and key. Of lines that normalise alike the first is there; lines of under eight characters,
    and sources without words to look for, have none.

    Both texts are normalised once, whole; a line is then a trim and a search."""

    def gone(raws: Column, texts: Column, q: Column) -> Column:
        line = lambda x, i: F.struct(i.alias("ord"), F.trim(x).alias("key"))
        absent = lambda x: (F.length(x["key"]) >= LEAST_LINE) & ~F.contains(q, F.replace(x["key"], F.lit(" "), F.lit("")))
        whole = lambda x: F.struct(x["ord"].alias("ord"), F.get(raws, x["ord"]).alias("raw"), x["key"].alias("key"))
        return F.transform(F.filter(F.transform(texts, line), absent), whole)

    def first(found: Column) -> Column:
        return T.let(F.transform(found, lambda x: x["key"]), lambda keys: F.filter(found, lambda x, i: F.array_position(keys, x["key"]) == i + 1))

    def lost(text: Column) -> Column:
        by_lines = T.let(
            T.squash(F.coalesce(produced, F.lit(""))),
            lambda q: T.let(split(source), lambda raws: T.let(split(text), lambda texts: T.let(gone(raws, texts, q), first))),
        )
        return F.when(F.rlike(text, F.lit(rf"[^\x0A-\x0D\x1C-\x1E\x20\x85\u2028\u2029]{{{T.SHORT + 1}}}")), by_lines)

    return T.let(T.flat(source), lost)


def missing_lines(pages: DataFrame, source: str, produced: str, keys: list[str] | None = None, split=T.lines) -> DataFrame:
    """Source lines that the produced text does not contain: keys, ord, line. They are looked
    up in the row of the text, so that only missing lines become rows and nothing is shuffled."""
    rows = pages.select(*(keys or KEY), F.explode(lost_lines(F.col(source), F.col(produced), split)).alias("g"))
    return rows.select(*(keys or KEY), F.col("g.ord").alias("ord"), T.strip(F.col("g.raw")).alias("line"))


def coverage_findings(pages: DataFrame, source: str, produced: str, threshold: float = COVERAGE) -> DataFrame:
    """Findings of pages that lost words beyond the threshold, or whole lines."""
    rows = coverage(pages.select(*KEY, source, produced), source, produced)
    gone = missing_lines(pages, source, produced).groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]).alias("lines"))
    rows = rows.join(gone, KEY, "left")
    lost = F.size("missing")
    words = F.concat(T.percent(F.col("coverage")), F.lit(" of the words are there, "), lost.cast("string"), F.lit(" missing: "), T.preview(F.col("missing"), 8, ", "))
    lines = F.concat(F.size("lines").cast("string"), F.lit(" line(s) missing: "), T.preview(F.col("lines"), 4, "; ", 50))
    return as_findings(
        rows,
        finding(F.col("coverage") < threshold, "coverage", "problem", words),
        finding(F.size("lines") > 0, "coverage", "problem", lines),
        keys=KEY,
    ).select(*KEY, F.lit(None).cast("int").alias("block_ord"), "check", "severity", "message")


def word_share(normalized: Column, source: Column) -> Column:
    """Share of a normalised text's longer words, duplicates included, that the source contains."""
    words = T.words(normalized, T.SHORT)
    return T.let(words, lambda w: F.when(F.size(w) > 0, F.size(F.filter(w, lambda x: F.contains(source, x))) / F.size(w)).otherwise(0.0))


def grounded_share(text: Column, source: Column, squashed: Column) -> Column:
    """1 for a text that the source holds whole, spacing aside, else the share of its longer
    words there. The text is normalised once."""
    return T.let(
        T.normalize(F.coalesce(text, F.lit(""))),
        lambda t: F.when(F.contains(squashed, F.replace(t, F.lit(" "), F.lit(""))), 1.0).otherwise(word_share(t, source)),
    )


def with_blocks(blocks: DataFrame, pages: DataFrame, *columns: str) -> DataFrame:
    """Pages with their blocks as an array ``bs``, each with its block_ord. Pages that carry
    ``bs`` already need no ``blocks`` table, and then nothing is shuffled."""
    item = F.struct("block_ord", "kind", "text", "header", "rows")
    return pages.select(*KEY, *columns).join(blocks.groupBy(*KEY).agg(F.collect_list(item).alias("bs")), KEY)


def judged_blocks(blocks: DataFrame | None, pages: DataFrame, source: str, judge) -> DataFrame:
    """``judge(block, normalised source, squashed source)``, a struct, for every block.

    The blocks of a page meet its source in one row, where it is normalised once: joined
    to each block it would be copied as often as the page has blocks. Pages without source
    text drop out. ``blocks`` is None where pages carry them (see ``with_blocks``)."""
    rows = (pages if blocks is None else with_blocks(blocks, pages, source)).select(*KEY, F.col(source).alias("s"), "bs")
    judged = T.let(
        T.normalize(F.col("s")),
        lambda n: F.when(n != "", T.let(F.replace(n, F.lit(" "), F.lit("")), lambda q: F.transform("bs", lambda b: judge(b, n, q)))),
    )
    return rows.select(*KEY, F.explode(judged).alias("j")).select(*KEY, "j.*")


def _filled_cells(b: Column) -> Column:
    return F.filter(_cells(b), lambda c: ~T.blank(c))


def grounding(blocks: DataFrame | None, pages: DataFrame, source: str) -> DataFrame:
    """Per block: found, total and a message where something is missing. Pages without
    source text give no rows: nothing can be verified there."""

    def judge(b: Column, n: Column, q: Column) -> Column:
        label = block_label(b["block_ord"], b["kind"])

        def table(cells: Column) -> Column:
            return T.let(
                F.filter(cells, lambda c: ~T.contained(c, q)),
                lambda gone: F.struct(
                    b["block_ord"].alias("block_ord"),
                    (F.size(cells) - F.size(gone)).cast("long").alias("found"),
                    F.size(cells).cast("long").alias("total"),
                    F.when(F.size(gone) > 0, F.concat(label, F.lit(": "), F.size(gone).cast("string"), F.lit(" cell(s) not in the source: "), T.preview(gone, 6, ", "))).alias("message"),
                ),
            )

        def prose(share: Column) -> Column:
            held = share >= GROUNDED_WORDS
            return F.struct(
                b["block_ord"].alias("block_ord"),
                held.cast("long").alias("found"),
                F.lit(1).cast("long").alias("total"),
                F.when(~held, F.concat(label, F.lit(": text not in the source ("), T.percent(share), F.lit(" of its words are)"))).alias("message"),
            )

        return F.when(_is_table(b), T.let(_filled_cells(b), table)).when(~T.blank(b["text"]), T.let(grounded_share(b["text"], n, q), prose))

    return judged_blocks(blocks, pages, source, judge).where("total is not null")


def grounding_share(grounded: DataFrame) -> DataFrame:
    """found and total per page."""
    return grounded.groupBy(*KEY).agg(F.sum("found").alias("found"), F.sum("total").alias("total"))


def ungrounded_text(blocks: DataFrame | None, pages: DataFrame, source: str) -> DataFrame:
    """Keys of text blocks that the source does not hold."""

    def judge(b: Column, n: Column, q: Column) -> Column:
        gone = ~_is_table(b) & ~T.blank(b["text"]) & (grounded_share(b["text"], n, q) < GROUNDED_WORDS)
        return F.struct(b["block_ord"].alias("block_ord"), gone.alias("gone"))

    return judged_blocks(blocks, pages, source, judge).where("gone").select(*KEY, "block_ord")


def cell_grounded(cell: Column, words: Column, squashed: Column) -> Column:
    """A cell whose words are all words of the source, or a longer one that it contains."""

    def held(c: Column) -> Column:
        whole = (F.length(c) > 8) & F.contains(squashed, F.replace(c, F.lit(" "), F.lit("")))
        return whole | T.let(T.words(c), lambda p: (F.size(p) > 0) & (F.size(F.array_except(p, words)) == 0))

    return T.let(T.normalize(cell), held)


def ungrounded_cells(blocks: DataFrame | None, pages: DataFrame, source: str) -> DataFrame:
    """Tables with the number of their filled cells and of those the source lacks."""

    def judge(b: Column, n: Column, q: Column) -> Column:
        gone = lambda cells, words: F.size(F.filter(cells, lambda c: ~cell_grounded(c, words, q)))
        found = T.let(
            F.array_distinct(T.words(n)),
            lambda words: T.let(_filled_cells(b), lambda cells: F.struct(b["block_ord"].alias("block_ord"), F.size(cells).alias("cells"), gone(cells, words).alias("gone"))),
        )
        return F.when(_is_table(b), found)

    return judged_blocks(blocks, pages, source, judge).where("cells > 0")


def ungrounded_tables(blocks: DataFrame, pages: DataFrame, source: str) -> DataFrame:
    """Keys of tables of whose cells four in five or more are not in the source."""
    return ungrounded_cells(blocks, pages, source).where(F.col("gone") / F.col("cells") >= UNGROUNDED_CELLS).select(*KEY, "block_ord")


def drop_hallucinated(blocks: DataFrame, pages: DataFrame, source: str, images: DataFrame) -> DataFrame:
    """Blocks without those that were read off a picture: ungrounded texts and tables, on
    pages that have pictures."""
    bogus = ungrounded_text(blocks, pages, source).unionByName(ungrounded_tables(blocks, pages, source)).distinct()
    return blocks.join(bogus.join(images.select(*KEY).distinct(), KEY), [*KEY, "block_ord"], "left_anti")


def geometry(blocks: DataFrame, detected: DataFrame) -> DataFrame:
    """Notes where the tables of a page differ, in number or shape, from the detected ones;
    both sides are paired by their place on the page."""
    from .repair import paired_tables

    model = blocks.where(F.col("kind") == "table")
    counts = model.groupBy(*KEY).agg(F.count(F.lit(1)).alias("m")).join(detected.groupBy(*KEY).agg(F.count(F.lit(1)).alias("d")), KEY, "full")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    differ = as_findings(
        counts,
        finding(n("m") != n("d"), "geometry", "note", F.concat(F.lit("tables: "), n("m").cast("string"), F.lit(" extracted, "), n("d").cast("string"), F.lit(" detected"))),
        keys=KEY,
    )
    pairs = paired_tables(blocks, detected)
    shapes = table_shapes(pairs)
    text = lambda a, b: F.concat(F.col(a).cast("string"), F.lit("x"), F.col(b).cast("string"))
    shape = as_findings(
        shapes,
        finding(
            (F.col("model_rows") != F.col("real_rows")) | (F.col("model_cols") != F.col("col_count")),
            "geometry",
            "note",
            F.concat(F.lit("table["), (F.col("rn") - 1).cast("string"), F.lit("]: "), text("model_rows", "model_cols"), F.lit(" extracted, "), text("real_rows", "col_count"), F.lit(" detected")),
        ),
    )
    return differ.withColumn("block_ord", F.lit(None).cast("int")).unionByName(shape)


def table_shapes(pairs: DataFrame) -> DataFrame:
    """Adds model_rows, model_cols and real_rows to paired tables."""
    rows = F.size(F.coalesce("rows", F.array().cast("array<array<string>>")))
    return pairs.select(
        "*",
        (rows + F.col("has_header").cast("int")).alias("model_rows"),
        F.when(F.col("has_header"), F.size("header")).otherwise(F.coalesce(F.size(F.get("rows", F.lit(0))), F.lit(0))).alias("model_cols"),
        F.size(real_rows(F.col("grid"))).alias("real_rows"),
    )


def verdicts(pages: DataFrame, shares: DataFrame, covered: DataFrame) -> DataFrame:
    """Per page: grounding and coverage as pass, fail or n/a. Nothing to verify against, and
    nothing that could be verified, is no failure. ``pages`` has verify_trust, ``shares``
    found and total, ``covered`` coverage."""
    rows = pages.select(*KEY, "verify_trust").join(shares, KEY, "left").join(covered.select(*KEY, "coverage"), KEY, "left")
    total, found = F.coalesce("total", F.lit(0)), F.coalesce("found", F.lit(0))
    return rows.select(
        *KEY,
        F.when((total == 0) & (F.col("verify_trust") == "none"), "n/a").when(found == total, "pass").otherwise("fail").alias("grounding"),
        F.when(F.col("coverage").isNull(), "n/a").when(F.col("coverage") >= COVERAGE, "pass").otherwise("fail").alias("coverage"),
    )


def readback(pages: DataFrame, source: str, read: str) -> DataFrame:
    """Words of the sources that a written file, read back, still holds: n_words, missing, coverage."""
    return coverage(pages, source, read)


# Fixed value: the coverage that a converted file needs.
CONVERTED = 0.99


def converted(src: DataFrame, out: DataFrame, key: str = "doc_id") -> DataFrame:
    """A Word file against the PDF made from it. ``src``: text, paragraphs, tables (rows,
    cols, cells), images. ``out``: text, tables, images. One row per file: coverage, kept
    and total cells and paragraphs, and findings (array of severity and message)."""
    s = src.select(key, *(F.col(c).alias(f"s_{c}") for c in ("text", "paragraphs", "tables", "images")))
    o = out.select(key, *(F.col(c).alias(f"o_{c}") for c in ("text", "tables", "images")))
    both = s.join(o, key).withColumn("sought", source_words(F.col("s_text")))
    away = lambda q: F.filter("s_paragraphs", lambda p: T.let(T.normalize(p), lambda n: (F.length(n) >= LEAST_LINE) & ~F.contains(q, F.replace(n, F.lit(" "), F.lit("")))))
    missing_cells = lambda q: lambda t: F.struct(t["rows"].alias("rows"), t["cols"].alias("cols"), F.size(t["cells"]).alias("n"), F.filter(t["cells"], lambda c: ~T.contained(c, q)).alias("gone"))
    found = T.let(T.squash(F.col("o_text")), lambda q: F.struct(away(q).alias("gone"), F.transform("s_tables", missing_cells(q)).alias("t")))
    rows = both.select("*", F.size("sought").alias("n_words"), absent_words(F.col("sought"), F.col("o_text")).alias("lost"), found.alias("found"))
    rows = rows.select("*", "found.*").drop("found")
    rows = rows.withColumn("coverage", F.when(F.col("n_words") == 0, 1.0).otherwise(1 - F.size("lost") / F.col("n_words")))
    add = lambda values: F.aggregate(values, F.lit(0), lambda a, x: a + x)
    cells, missing = add(F.transform("t", lambda t: t["n"])), add(F.transform("t", lambda t: F.size(t["gone"])))
    item = lambda severity, message: F.struct(F.lit(severity).alias("severity"), message.alias("message"))
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    number = lambda c: c.cast("string")
    by_table = F.filter(
        F.transform(
            "t",
            lambda t, i: F.when(
                F.size(t["gone"]) > 0,
                item("problem", say("table ", number(i), " (", number(t["rows"]), "x", number(t["cols"]), "): ", number(F.size(t["gone"])), " cell(s) missing: ", T.preview(t["gone"], 4, ", ", 22))),
            ),
        ),
        lambda x: x.isNotNull(),
    )
    single = F.array(
        F.when(F.col("coverage") < CONVERTED, item("problem", say("words: ", T.percent(F.col("coverage")), " there, ", number(F.size("lost")), " missing: ", T.preview(F.col("lost"), 8, ", ")))),
        F.when(F.size("gone") > 0, item("problem", say("paragraphs: ", number(F.size("gone")), " missing: ", T.preview(F.col("gone"), 4, "; ", 45)))),
        F.when(F.size("s_tables") != F.size("o_tables"), item("note", say("tables: ", number(F.size("s_tables")), " in the source, ", number(F.size("o_tables")), " detected"))),
        F.when(F.col("o_images") < F.col("s_images"), item("problem", say("images: ", number(F.col("s_images")), " in the source, ", number(F.col("o_images")), " found"))),
        F.when(F.col("o_images") > F.col("s_images"), item("note", say("images: ", number(F.col("s_images")), " in the source, ", number(F.col("o_images")), " found"))),
    )
    return rows.select(
        key,
        "coverage",
        (cells - missing).cast("long").alias("kept_cells"),
        cells.cast("long").alias("cells"),
        (F.size("s_paragraphs") - F.size("gone")).cast("long").alias("kept_paragraphs"),
        F.size("s_paragraphs").cast("long").alias("paragraphs"),
        F.concat(F.filter(single, lambda x: x.isNotNull()), by_table).alias("findings"),
    )


def tally(verified: DataFrame) -> DataFrame:
    """How many files of a batch passed and failed (a file with a problem fails)."""
    bad = F.exists("findings", lambda x: x["severity"] == "problem")
    return verified.agg(F.count_if(~bad).alias("ok"), F.count_if(bad).alias("failed"))
