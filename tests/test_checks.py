"""The known cases of checks and repairs."""

import json
import random

from pyspark.sql import functions as F

from verifolio import schema
from verifolio.operators import checks, repair, select, spatial
from verifolio.schema import KEY

NONE = (None,) * 5


def text(order, value, kind="paragraph", size="normal", doc="d"):
    return (doc, 1, order, kind, value, "left", size, False, *NONE)


def table(order, rows, header=(), n_rows=None, n_cols=None, has_header=None, doc="d"):
    head = bool(header) if has_header is None else has_header
    width = n_cols if n_cols is not None else len(header or rows[0])
    return (doc, 1, order, "table", None, None, None, None, head, len(rows) if n_rows is None else n_rows, width, list(header), rows)


def blocks(spark, *rows):
    return spark.createDataFrame(list(rows), schema.BLOCKS)


def pages(spark, source, doc="d"):
    return spark.createDataFrame([(doc, 1, source)], "doc_id string, page_no int, s string")


def grounded(spark, source, *rows):
    return {r.block_ord: (r.found, r.total) for r in checks.grounding(blocks(spark, *rows), pages(spark, source), "s").collect()}


def test_quotes_and_spacing_ground(spark):
    found = grounded(spark, 'Harbour\'s {"depth","tides"} port.quay._open_lock_gates', text(0, "Harbour\u2019s"), text(1, '{"depth", "tides"}'), text(2, "port.quay_open_lock_gates"))
    assert found == {0: (1, 1), 1: (1, 1), 2: (0, 1)}


def test_reflowed_text_grounds_by_words(spark):
    words = "alpha bravo charlie delta foxtrot golfing hotels indigo juliet kilos".split()
    source = " ".join(words)
    nine = " ".join([*reversed(words[1:]), "unseen"])
    eight = " ".join([*reversed(words[2:]), "unseen", "unknown"])
    assert grounded(spark, source, text(0, nine), text(1, eight), text(2, "a b c")) == {0: (1, 1), 1: (0, 1), 2: (0, 1)}


def test_empty_source_verifies_nothing(spark):
    assert grounded(spark, " \n", text(0, "x")) == {}
    covered = checks.coverage(spark.createDataFrame([("", "x"), ("a bb ccc", ""), ("word", "")], "s string, p string"), "s", "p").collect()
    assert [r.coverage for r in covered] == [None, 1.0, 0.0]


def test_chart_read_as_table_is_flagged(spark):
    chart = table(0, [["120", "150", "135", "180", "210"]], ["Jan", "Feb", "Mar", "Apr", "May"])
    for source in ("In January, March and April, and in May the line rose", "In January, March, April and May. the line rose"):
        assert checks.ungrounded_tables(blocks(spark, chart), pages(spark, source), "s").count() == 1
    cells = [[f"c{r}x{c}" for c in range(7)] for r in range(7)]
    source = " ".join(c for row in cells for c in row).replace("c3x3", "other")
    found = checks.ungrounded_cells(blocks(spark, table(0, cells)), pages(spark, source), "s").first()
    assert (found.cells, found.gone) == (49, 1)


def test_lost_heading_shows_as_a_line(spark):
    source = "Employee Onboarding Summary\nThe employee follows the onboarding steps " + " ".join(f"wording{i}" for i in range(38))
    df = pages(spark, source).withColumn("p", F.lit(source.split("\n")[1]))
    row = checks.coverage(df, "s", "p").first()
    assert row.missing == ["summary"] and row.coverage > 0.97
    assert [r.line for r in checks.missing_lines(df, "s", "p").collect()] == ["Employee Onboarding Summary"]
    assert checks.coverage_findings(df, "s", "p").count() == 1


def test_first_of_equal_lines_is_reported(spark):
    df = pages(spark, "  The Same  Line \nthe same line\nshort\nanother line").withColumn("p", F.lit("x"))
    assert sorted((r.ord, r.line) for r in checks.missing_lines(df, "s", "p").collect()) == [(0, "The Same  Line"), (3, "another line")]


def test_structure(spark):
    found = checks.block_structure(
        blocks(
            spark,
            table(0, [], ["a"], n_rows=5, n_cols=9),
            table(1, [["1", "2"]], ["a", "b", "c"], n_rows=2, n_cols=2),
            table(2, [["1"]], ["a"], has_header=False),
            text(3, " \n"),
            text(4, "fine"),
            table(5, [["1", "2"], ["3"]], ["a", "b"]),
        )
    ).collect()
    assert sorted(r.block_ord for r in found) == [0, 1, 1, 2, 3, 5]


def test_answers_parse_leniently(spark):
    good = {"analysis": {"n_blocks": "3", "table_column_counts": [2]}, "blocks": [{"kind": "paragraph", "text": "x", "align": "left", "size": "normal", "bold": "true"}]}
    bad = {"analysis": {"n_blocks": 1}, "blocks": [{"kind": "poem", "text": None}, {"kind": "heading", "text": "h", "align": "up", "size": "normal", "bold": False}]}
    rows = [("a", 1, json.dumps(good)), ("b", 1, json.dumps(bad)), ("c", 1, '{"analysis": {"n_b'), ("d", 1, None)]
    parsed = schema.parse_model_pages(spark.createDataFrame(rows, schema.MODEL_PAGES))
    by = {r.doc_id: r for r in parsed.collect()}
    assert by["a"].n_blocks == 3 and by["a"].blocks[0].bold is True
    assert [by[k].status for k in "abcd"] == ["ok", "ok", "failed", "failed"]
    assert checks.structure(parsed).where("severity = 'note'").count() == 2
    found = {(r.doc_id, r.message) for r in schema.validate(schema.explode_blocks(parsed)).collect()}
    assert found == {("b", "block[0]: kind is unknown"), ("b", "block[1]: align is unknown")}


def test_page_spec(spark):
    rows = [(1, "1-3,2", 2), (2, "all", 2), (3, "", 1), (4, "3, 1", 3), (5, "9", 3), (6, "3-1", 3)]
    found = select.parse_pages(spark.createDataFrame(rows, "k int, spec string, n int"), "spec", "n").collect()
    by = {}
    for r in sorted(found, key=lambda r: (r.k, r.target_ord)):
        by.setdefault(r.k, []).append(r.page_index)
    assert by == {1: [0, 1, 1], 2: [0, 1], 3: [0], 4: [2, 0]}


def test_phantom_rows_are_trimmed(spark):
    grid = [[["a", ""], ["", "b"], ["", " "], [None, ""]], [["", ""]], []]
    rows = spark.createDataFrame([(i, g) for i, g in enumerate(grid)], "i int, g array<array<string>>").select("i", F.size(select.real_rows(F.col("g"))).alias("n"))
    assert {r.i: r.n for r in rows.collect()} == {0: 2, 1: 0, 2: 0}


def test_page_boxes(spark):
    rows = spark.createDataFrame([(1700.0, 2200.0), (2200.0, 1700.0), (612.0, 792.0), (1191.0, 1684.0), (3000.0, 100.0)], "w double, h double")
    found = [(r.b.name, round(r.b.width_pt), round(r.b.height_pt)) for r in rows.select(spatial.standard_page(F.col("w"), F.col("h")).alias("b")).collect()]
    assert found == [("Letter", 612, 792), ("Letter", 792, 612), (None, 612, 792), ("A4", 595, 842), (None, 3000, 100)]


def test_dominant_takes_the_first_of_equals(spark):
    rows = [("d", 1, 9.0, "aaaa", 3), ("d", 1, 12.0, "bb", 0), ("d", 1, 12.0, "cc", 5), ("e", 1, 7.0, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id string, page_no int, size double, text string, ord int")
    assert {r.doc_id: r.body for r in spatial.body_size(df).collect()} == {"d": 12.0, "e": 7.0}


def test_lines_inserted_like_a_list(spark):
    """The fold against Python's list.insert, on random pages."""
    rng = random.Random(4)
    expected, page_rows, span_rows, gone_rows = {}, [], [], []
    for d in range(25):
        n = rng.randint(1, 14)
        lines = [f"line number {d} {i} {'x' * rng.randint(1, 20)}" for i in range(n)]
        lost = sorted(rng.sample(range(n), rng.randint(0, n)))
        for i, t in enumerate(lines):
            span_rows.append((str(d), 1, 0, i, 0, t, 10.0, "f", 72.0, 12.0 * i, 300.0, 12.0 * i + 10))
        kept = [lines[i] for i in range(n) if i not in lost]
        gone_rows += [(str(d), 1, lines[i]) for i in lost]
        page_rows.append((str(d), 1, 612.0, [("paragraph", t, "left", "normal", False, *NONE) for t in kept]))
        total = sum(map(len, lines)) or 1
        new = sorted(((sum(len(x) for x in lines[:i]) / total, i) for i in lost), key=lambda x: -x[0])
        out = list(kept)
        for frac, i in new:
            out.insert(min(len(out), round(frac * len(out))), lines[i])
        expected[str(d)] = out
    page = spark.createDataFrame(page_rows, f"doc_id string, page_no int, width_pt double, blocks array<struct<{', '.join(x.replace(' ', ': ', 1) for x in schema.BLOCK.split(', '))}>>")
    lines = spatial.line_table(spark.createDataFrame(span_rows, schema.SPANS))
    gone = spark.createDataFrame(gone_rows, "doc_id string, page_no int, line string")
    boxes = spark.createDataFrame([], schema.DETECTED)
    found = repair.restore_lines(page, lines, gone, boxes).collect()
    assert {r.doc_id: [b.text for b in r.blocks] for r in found} == expected


def test_rows_come_back_where_they_were(spark):
    grid = [["Name", "Q1"], ["East", "5"], ["Sales", "9"], ["East", "5"], ["West", "1"], ["", ""]]
    model = table(0, [["East", "5"]], ["Name", "Q1"])
    detected = spark.createDataFrame([("d", 1, 0.0, 5.0, 9.0, 9.0, 2, grid)], schema.DETECTED)
    fixed = repair.restore_rows(repair.paired_tables(blocks(spark, model), detected)).first()
    assert fixed.rows == [["East", "5"], ["Sales", "9"], ["West", "1"]] and fixed.n_data_rows == 3 and fixed.restored == 2
    notes = checks.geometry(blocks(spark, model), detected).collect()
    assert [r.message for r in notes] == ["table[0]: 2x2 extracted, 5x2 detected"]


def test_converted_files(spark):
    tables = "array<struct<rows:int,cols:int,cells:array<string>>>"
    src = spark.createDataFrame(
        [("a", "first paragraph here\nsecond one there", ["first paragraph here", "second one there", "x"], [(1, 2, ["left", "right"])], 2)], f"doc_id string, text string, paragraphs array<string>, tables {tables}, images int"
    )
    out = spark.createDataFrame([("a", "first  paragraph here left", [], 1)], f"doc_id string, text string, tables {tables}, images int")
    row = checks.converted(src, out).first()
    assert (row.kept_cells, row.cells, row.kept_paragraphs, row.paragraphs) == (1, 2, 2, 3)
    assert [f.severity for f in row.findings] == ["problem", "problem", "note", "problem", "problem"]
    assert checks.tally(checks.converted(src, out)).first().asDict() == {"ok": 0, "failed": 1}


def test_overlap_and_keys(spark):
    lines = spark.createDataFrame([("d", 1, i, 0.0, 10.0 * i, 100.0, 10.0 * i + 10) for i in range(4)], "doc_id string, page_no int, i int, x0 double, y0 double, x1 double, y1 double")
    boxes = spark.createDataFrame([("d", 1, 0.0, 4.0, 100.0, 25.0)], "doc_id string, page_no int, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.i for r in spatial.outside_tables(lines, boxes).collect()) == [2, 3]
    assert sorted(r.i for r in spatial.outside_tables(lines, boxes, how="left_semi").collect()) == [0, 1]
    assert KEY == ["doc_id", "page_no"]
