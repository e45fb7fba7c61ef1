"""Plans, the files made from them, and what is read back."""

import io
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from verifolio import schema
from verifolio.operators import checks
from verifolio.plans import markdown, sheet, word
from verifolio.sinks import office as sinks
from verifolio.sources import history, office

NONE = (None,) * 5
BLOCKS = f"array<struct<{', '.join(x.replace(' ', ': ', 1) for x in schema.BLOCK.split(', '))}>>"
PAGES = f"doc_id string, page_no int, blocks {BLOCKS}"
IMAGES = "doc_id string, page_no int, ord int, frac_above double, width_in double, height_in double, px_w int, px_h int, path string"


def text(value, kind="paragraph", size="normal", bold=False):
    return (kind, value, "left", size, bold, *NONE)


def table(rows, header=()):
    return ("table", None, None, None, None, bool(header), len(rows), len(header or rows[0]) if rows or header else 0, list(header), rows)


def sample(spark):
    first = [
        text("Report", "heading", "large"),
        text("Address\\nline two"),
        table([["Q1", "", ""], ["a", "-5%", "=N/A"], ["b", "c"]], ["k", "v", "w"]),
        text("• one\n• two", "list"),
        text("  "),
        text("Figure 1", "caption", "small"),
    ]
    return spark.createDataFrame([("d", 1, first), ("d", 2, [text("Last page"), table([], ["x"])])], PAGES)


def pictures(spark):
    return spark.createDataFrame([("d", 1, 0, 0.5, 7.0, 3.0, 100, 50, "p0"), ("d", 1, 1, 0.5, 2.0, 0.0, 100, 50, "p1"), ("d", 2, 0, 1.0, 1.0, 1.0, 9, 9, "p2")], IMAGES)


def test_markdown_goldens(spark):
    rows = [
        text("Action Items", "heading"),
        text("Two lines\n\n - of a list", "list"),
        text("seen here", "caption"),
        table([["Send it", "Ann"]], ["Item", "Owner"]),
        table([["1", "2"], ["3"]]),
        table([]),
    ]
    found = spark.createDataFrame([("d", 1, rows)], PAGES).select(F.explode("blocks").alias("b")).select(markdown.render_block(F.col("b")).alias("m")).collect()
    assert [r.m for r in found] == [
        "## Action Items",
        "- Two lines\n- - of a list",
        "*seen here*",
        "| Item | Owner |\n|---|---|\n| Send it | Ann |",
        "|  |  |\n|---|---|\n| 1 | 2 |\n| 3 |",
        "|  |\n|---|",
    ]
    pages = spark.createDataFrame([("d", 2, [text("b")]), ("d", 1, [text("a")]), ("d", 3, None)], PAGES)
    assert markdown.render_documents(pages).first().markdown == "# d\n\n\n---\n\n*(page 1)*\n\na\n\n---\n\n*(page 2)*\n\nb"


def test_word_plan(spark):
    plan = word.word_plan(sample(spark), pictures(spark)).orderBy("seq").collect()
    assert [r.op for r in plan] == ["heading", "paragraph", "table", "image", "image", "item", "item", "caption", "page_break", "paragraph", "image"]
    assert [r.text for r in plan if r.op in ("paragraph", "item")] == ["Address\nline two", "one", "two", "Last page"]
    grid = plan[2].grid
    assert [g.divider for g in grid] == [True, False, False] and grid[2].cells == ["b", "c", ""]
    assert plan[0].point == 17.6 and plan[1].point == 11.0 and plan[7].point == 8.8
    assert plan[3].width_in == 6.5 and plan[4].width_in == 2.0
    said = sorted(r.message for r in word.write_problems(sample(spark)).collect())
    assert said == ["page 1 block[2] row 2: 2 cells on a grid of 3, padded", "page 1 block[4]: empty paragraph, skipped", "page 2 block[1]: table without rows, skipped"]


def test_skewed_labels_are_anchored(spark):
    rows = spark.createDataFrame([("d", 1, [text("tiny but most of the text", size="small"), text("Head", "heading", "large")])], PAGES)
    plan = word.word_plan(rows, pictures(spark).where("false")).orderBy("seq").collect()
    assert [r.point for r in plan] == [11.0, 22.0]


def test_word_file_round_trip(spark, tmp_path):
    plan = word.word_plan(sample(spark), pictures(spark))
    data = spark.createDataFrame([("p0", b"\x89PNG0", "png"), ("p1", b"\x89PNG1", "png"), ("p2", b"\x89PNG2", "png")], "path string, data binary, ext string")
    sinks.save_files(sinks.word_files(plan, data), str(tmp_path))
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    body = office.word_body(office.files(spark, str(tmp_path), "*.docx")).cache()
    good = body.where("error is null")
    kinds = [r.kind for r in good.orderBy("ord").collect()]
    assert kinds == ["text", "text", "table", "image", "image", "text", "text", "text", "text", "text", "image"]
    assert body.where("error is not null").count() == 1
    summary = office.word_summary(body).first()
    assert summary.images == 3 and summary.paragraphs == ["Report", "Address\nline two", "one", "two", "Figure 1", "Last page"]
    assert (summary.tables[0].rows, summary.tables[0].cols) == (4, 3)
    cover = checks.readback(spark.createDataFrame([("report address figure page lost", summary.text)], "s string, r string"), "s", "r").first()
    assert cover.missing == ["lost"]
    expected = spark.createDataFrame(
        [("d", 0, "8" * 40, "-5%", "one"), ("d", 1, "8" * 40, "nowhere", None)], "doc_id string, ord int, sha1 string, text_before string, text_after string"
    )
    written = good.select(F.lit("d").alias("doc_id"), "ord", F.when(F.col("kind") == "image", "image").otherwise("text").alias("kind"), "sha1", F.coalesce("text", F.array_join(F.flatten("cells"), " ")).alias("text"))
    found = sorted((r.check, r.message) for r in word.verify_images(expected, written).collect())
    assert [c for c, _ in found] == ["BYTES", "BYTES", "COUNT", "POSITION"]
    assert office.describe_body(good).where("kind = 'table'").first().line == "table 4x3"


def test_sheet_rows_and_file(spark, tmp_path):
    items = sheet.sheet_items(sample(spark), pictures(spark)).cache()
    cells = sheet.sheet_cells(items)
    at = {(r.row, r.col): (r.value, r.bold, r.quote) for r in cells.collect()}
    # heading 1, text 3, table 5-8 and a blank row, two pictures of three rows each
    assert at[1, 1] == ("Report", True, False) and at[3, 1][0] == "Address\\nline two" and at[5, 1] == ("k", True, False)
    assert at[7, 2] == ("-5%", False, True) and at[8, 3] == ("", False, False) and at[16, 1][0] == "• one\n• two"
    assert sorted(r.row for r in sheet.sheet_pictures(items).collect()) == [11, 14, 24]
    widths = {r.col: r.width for r in sheet.column_widths(cells).collect()}
    assert widths == {1: 19, 2: 5, 3: 6}
    sinks.save_files(sinks.sheet_files(cells, sheet.column_widths(cells)), str(tmp_path))
    read = {(r.row, r.col): r.value for r in office.sheet_cells(office.files(spark, str(tmp_path), "*.xlsx")).collect()}
    assert read == {k: v[0] for k, v in at.items()}


def xml(content, name):
    return zipfile.ZipFile(io.BytesIO(content)).read(name).decode()


def test_layout_title_and_proportions_reach_the_file(spark):
    pages = sample(spark)
    layout = spark.createDataFrame([("d", 500.0, 700.0, 50.0, 40.0, 30.0, 20.0, 9.0)], "doc_id string, width_pt double, height_pt double, left_pt double, right_pt double, top_pt double, bottom_pt double, body_pt double")
    data = spark.createDataFrame([("p0", b"\x89PNG0", "png"), ("p1", b"\x89PNG1", "png"), ("p2", b"\x89PNG2", "png")], "path string, data binary, ext string")
    titles = spark.createDataFrame([("d", "A & B")], "doc_id string, title string")
    matched = sinks.word_files(word.word_plan(pages, pictures(spark), layout, titles), data, layout).first().content
    document = xml(matched, "word/document.xml")
    assert '<w:pgSz w:w="10000" w:h="14000"/>' in document and '<w:pgMar w:top="600" w:right="800" w:bottom="400" w:left="1000"/>' in document
    assert "A &amp; B" not in document and '<w:sz w:val="18"/>' in xml(matched, "word/styles.xml")
    # 410 points of column bound the first picture; heights follow from 100 x 50 pixels
    wide = round(410 / 72 * 914400)
    assert f'<wp:extent cx="{wide}" cy="{round(wide / 2)}"/>' in document and f'<wp:extent cx="{2 * 914400}" cy="914400"/>' in document
    plain = xml(sinks.word_files(word.word_plan(pages, pictures(spark), None, titles), data).first().content, "word/document.xml")
    assert "A &amp; B" in plain and 'w:val="Title"' in plain and "<w:sectPr></w:sectPr>" in plain


def test_pictures_in_sheets(spark):
    items = sheet.sheet_items(sample(spark), pictures(spark))
    cells = sheet.sheet_cells(items)
    data = spark.createDataFrame([("p0", b"\x89PNG0", "png"), ("p1", b"\x89PNG1", "png"), ("p2", b"\x89PNG2", "png")], "path string, data binary, ext string")
    made = sinks.sheet_files(cells, sheet.column_widths(cells), sheet.sheet_pictures(items), data).first().content
    drawing, page = xml(made, "xl/drawings/drawing1.xml"), xml(made, "xl/worksheets/sheet1.xml")
    assert re.findall(r"<xdr:row>(\d+)</xdr:row>", drawing) == ["10", "13", "23"]
    assert f'<xdr:ext cx="{round(6.5 * 96 * 9525)}" cy="{3 * 96 * 9525}"/>' in drawing and f'<xdr:ext cx="{2 * 96 * 9525}" cy="{96 * 9525}"/>' in drawing
    assert '<row r="11" ht="216" customHeight="1">' in page and '<col min="1" max="1" width="89.1429" customWidth="1"/>' in page and '<drawing r:id="rId1"/>' in page
    assert zipfile.ZipFile(io.BytesIO(made)).read("xl/media/image2.png") == b"\x89PNG1"
    read = office.sheet_cells(spark.createDataFrame([("x", bytearray(made))], "path string, content binary"))
    assert read.where("error is not null").count() == 0 and read.count() == cells.count()


def test_scan_document(spark):
    pages = sample(spark)
    scans = pictures(spark).where("path <> 'p1'")
    data = spark.createDataFrame([("p0", b"\x89PNG0", "png"), ("p2", b"\x89PNG2", "png")], "path string, data binary, ext string")
    made = sinks.scan_files(word.scan_plan(pages, scans), data)
    assert made.first().path == "d_scan.docx"
    kinds = [r.kind for r in office.word_body(made).orderBy("ord").collect()]
    assert kinds == ["image", "text", "image"]
    assert word.scan_plan(pages, scans.where("false")).count() == 0


def test_missing_paths_can_be_skipped(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(b"x")
    there, gone = str(tmp_path / "a.docx"), str(tmp_path / "none.docx")
    assert office.files(spark, [there, gone], missing="skip").count() == 1
    assert office.files(spark, gone, missing="skip").count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        office.files(spark, [there, gone]).count()


def test_changed_content(spark):
    runs = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 4), ("b", 1, 9)], "label string, run int, blocks int")
    found = {(r.label, r.run): r.warning for r in history.changed_content(runs, "run", ["label"]).collect()}
    assert found == {("a", 1): None, ("a", 2): None, ("a", 3): "blocks changed from 5 to 4", ("b", 1): None}


def test_picture_frames(spark):
    rows = spark.createDataFrame([(6.13, 4.0, 10, 10), (9.0, 9.0, 10, 10), (4.0, 0.0, 100, 50), (0.0, 4.0, 100, 50), (0.0, 0.0, 0, 0)], "w double, h double, a int, b int")
    found = [(round(r.f.px_w / 96, 2), round(r.f.px_h / 96, 2)) for r in rows.select(sheet.picture_frame(F.col("w"), F.col("h"), F.col("a"), F.col("b")).alias("f")).collect()]
    assert found == [(6.13, 4.0), (6.5, 8.0), (4.0, 2.0), (8.0, 4.0), (2.0, 2.0)]


def test_history(spark, tmp_path):
    runs = spark.createDataFrame([("a", "2024-01-01 10:00", 10.0, 5), ("a", "2024-01-02 10:00", 12.0, 0), ("a", "2024-01-03 10:00", 6.0, 3)], "label string, when string, wall_s double, blocks int")
    history.append_runs(runs.limit(2), str(tmp_path / "runs"))
    history.append_runs(runs.where("blocks = 3"), str(tmp_path / "runs"))
    read = spark.read.schema(history.RUNS).json(str(tmp_path / "runs"))
    found = history.deltas(read, "when", ["wall_s", "blocks"], ["label"]).orderBy("when").collect()
    assert [r.wall_s_pct for r in found] == [None, 20.0, -50.0] and [r.blocks_pct for r in found] == [None, -100.0, None]
    row = spark.range(1).select(history.processor(F.lit("NAME ID\nm1 x 100% GPU\nm2 y 41%/59% CPU/GPU"), F.lit("m2")).alias("p"), history.rate(F.lit(9), F.lit(0.0)).alias("r")).first()
    assert (row.p, row.r) == ("41%/59% CPU/GPU", 0.0)
