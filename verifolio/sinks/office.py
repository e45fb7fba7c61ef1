"""Word and Excel files from plans, one document a task at a time.

A plan's rows of one document become the bytes of its file, so that a table of
(doc_id, content) can be written wherever, or read back and verified.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
_RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_PICTURES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif"}


def _clean(text: str) -> str:
    """Text without the characters that XML has no way to hold."""
    return "".join(c for c in text if c in "\t\n\r" or c >= " ")


def _zip(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))  # equal plans give equal bytes
            info.compress_type = zipfile.ZIP_DEFLATED
            z.writestr(info, data)
    return out.getvalue()


def _rels(links: list[tuple[str, str, str]]) -> str:
    rows = "".join(f'<Relationship Id="{i}" Type="{_OFFICE}/{kind}" Target="{target}"/>' for i, kind, target in links)
    return f'{_HEAD}<Relationships xmlns="{_RELS}">{rows}</Relationships>'


def _types(overrides: list[tuple[str, str]], defaults: dict[str, str]) -> str:
    known = {"rels": "application/vnd.openxmlformats-package.relationships+xml", "xml": "application/xml"} | defaults
    return (
        f'{_HEAD}<Types xmlns="{_TYPES}">'
        + "".join(f'<Default Extension="{k}" ContentType="{v}"/>' for k, v in known.items())
        + "".join(f'<Override PartName="{k}" ContentType="{v}"/>' for k, v in overrides)
        + "</Types>"
    )


def _run(text: str, bold: bool = False, italic: bool = False, point: float | None = None) -> str:
    look = ("<w:b/>" if bold else "") + ("<w:i/>" if italic else "") + (f'<w:sz w:val="{round(point * 2)}"/>' if point else "")
    lines = _clean(text).split("\n")
    body = "<w:br/>".join(f'<w:t xml:space="preserve">{escape(x)}</w:t>' for x in lines)
    return f"<w:r><w:rPr>{look}</w:rPr>{body}</w:r>"


def _paragraph(runs: str, style: str | None = None, align: str | None = None) -> str:
    look = (f"<w:pStyle w:val={quoteattr(style)}/>" if style else "") + (f'<w:jc w:val="{align}"/>' if align and align != "left" else "")
    return f"<w:p><w:pPr>{look}</w:pPr>{runs}</w:p>"


def _table(header, grid) -> str:
    rows = [(list(header), True, False)] if header is not None else []
    rows += [(list(r["cells"]), False, bool(r["divider"])) for r in (grid if grid is not None else [])]
    width = max((len(r) for r, _, _ in rows), default=1)
    out = ["<w:tbl><w:tblPr><w:tblStyle w:val=\"TableGrid\"/></w:tblPr><w:tblGrid>", "<w:gridCol/>" * width, "</w:tblGrid>"]
    for cells, bold, divider in rows:
        shown = cells[:1] if divider else cells
        span = f'<w:tcPr><w:gridSpan w:val="{width}"/></w:tcPr>' if divider else ""
        out.append("<w:tr>" + "".join(f"<w:tc>{span}{_paragraph(_run(c or '', bold or divider))}</w:tc>" for c in shown) + "</w:tr>")
    return "".join(out) + "</w:tbl>"


def _drawing(number: int, link: str, width_in: float, ratio: float) -> str:
    cx = round(width_in * 914400)
    cy = round(cx * ratio)
    a, pic = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/drawingml/2006/picture"
    wp = "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"
    return (
        f'<w:r><w:drawing><wp:inline xmlns:wp="{wp}"><wp:extent cx="{cx}" cy="{cy}"/><wp:docPr id="{number}" name="picture {number}"/>'
        f'<a:graphic xmlns:a="{a}"><a:graphicData uri="{pic}"><pic:pic xmlns:pic="{pic}"><pic:nvPicPr><pic:cNvPr id="{number}" name="p"/><pic:cNvPicPr/></pic:nvPicPr>'
        f'<pic:blipFill><a:blip r:embed="{link}"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill><pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="{cx}" cy="{cy}"/></a:xfrm>'
        f'<a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr></pic:pic></a:graphicData></a:graphic></wp:inline></w:drawing></w:r>'
    )


def word_bytes(ops: list[dict], layout: dict | None = None) -> bytes:
    """A Word file of a plan's rows, in their order. A row of op image has data and ext."""
    body, links, media = [], [("rId1", "styles", "styles.xml")], {}
    for op in ops:
        kind = op["op"]
        if kind == "table":
            body.append(_table(op["header"], op["grid"]))
        elif kind == "image":
            data, ext = op.get("data"), (op.get("ext") or "png").lower()
            if data is None:
                continue
            number = len(media) + 1
            media[f"word/media/image{number}.{ext}"] = bytes(data)
            links.append((f"rId{number + 1}", "image", f"media/image{number}.{ext}"))
            body.append(_paragraph(_drawing(number, f"rId{number + 1}", op["width_in"] or 2.0, op.get("ratio") or 1.0)))
        elif kind == "page_break":
            body.append('<w:p><w:r><w:br w:type="page"/></w:r></w:p>')
        else:
            style = {"title": "Title", "heading": "Heading2", "item": "ListBullet"}.get(kind)
            body.append(_paragraph(_run(op["text"] or "", bool(op["bold"]), kind == "caption", op["point"]), style, op["align"]))
    size = ""
    if layout:
        twips = {k: round(v * 20) for k, v in layout.items() if k.endswith("_pt") and v is not None}
        size = (
            f'<w:pgSz w:w="{twips["width_pt"]}" w:h="{twips["height_pt"]}"/>'
            f'<w:pgMar w:top="{twips["top_pt"]}" w:right="{twips["right_pt"]}" w:bottom="{twips["bottom_pt"]}" w:left="{twips["left_pt"]}"/>'
        )
    base = round((layout or {}).get("body_pt") or 11) * 2
    style = lambda key, name, extra="": f'<w:style w:type="paragraph" w:styleId="{key}"><w:name w:val="{name}"/>{extra}</w:style>'
    styles = (
        f'{_HEAD}<w:styles xmlns:w="{_W}"><w:docDefaults><w:rPrDefault><w:rPr><w:sz w:val="{base}"/></w:rPr></w:rPrDefault>'
        '<w:pPrDefault><w:pPr><w:spacing w:after="40" w:line="240" w:lineRule="auto"/></w:pPr></w:pPrDefault></w:docDefaults>'
        + style("Normal", "Normal")
        + style("Heading2", "heading 2", '<w:pPr><w:spacing w:before="120" w:after="40"/></w:pPr><w:rPr><w:b/></w:rPr>')
        + style("Title", "Title", '<w:pPr><w:spacing w:before="120" w:after="40"/></w:pPr><w:rPr><w:sz w:val="56"/></w:rPr>')
        + style("ListBullet", "List Bullet")
        + '<w:style w:type="table" w:styleId="TableGrid"><w:name w:val="Table Grid"/></w:style></w:styles>'
    )
    main = "application/vnd.openxmlformats-officedocument.wordprocessingml"
    parts: dict[str, str | bytes] = {
        "[Content_Types].xml": _types([("/word/document.xml", f"{main}.document.main+xml"), ("/word/styles.xml", f"{main}.styles+xml")], _PICTURES),
        "_rels/.rels": _rels([("rId1", "officeDocument", "word/document.xml")]),
        "word/_rels/document.xml.rels": _rels(links),
        "word/styles.xml": styles,
        "word/document.xml": f'{_HEAD}<w:document xmlns:w="{_W}" xmlns:r="{_OFFICE}"><w:body>{"".join(body)}<w:sectPr>{size}</w:sectPr></w:body></w:document>',
    }
    return _zip(parts | media)


def _column(number: int) -> str:
    out = ""
    while number:
        number, rest = divmod(number - 1, 26)
        out = chr(65 + rest) + out
    return out


def _anchor(number: int, row: int, width_px: float, height_px: float) -> str:
    """A picture in the first column of a row (from 1); a pixel is 9525 units."""
    a = "http://schemas.openxmlformats.org/drawingml/2006/main"
    return (
        f'<xdr:oneCellAnchor><xdr:from><xdr:col>0</xdr:col><xdr:colOff>0</xdr:colOff><xdr:row>{row - 1}</xdr:row><xdr:rowOff>0</xdr:rowOff></xdr:from>'
        f'<xdr:ext cx="{round(width_px * 9525)}" cy="{round(height_px * 9525)}"/><xdr:pic><xdr:nvPicPr><xdr:cNvPr id="{number}" name="picture {number}"/><xdr:cNvPicPr/></xdr:nvPicPr>'
        f'<xdr:blipFill><a:blip xmlns:a="{a}" r:embed="rId{number}"/><a:stretch xmlns:a="{a}"><a:fillRect/></a:stretch></xdr:blipFill>'
        f'<xdr:spPr><a:prstGeom xmlns:a="{a}" prst="rect"><a:avLst/></a:prstGeom></xdr:spPr></xdr:pic><xdr:clientData/></xdr:oneCellAnchor>'
    )


def sheet_bytes(cells: list[dict], widths: dict[int, int] | None = None, name: str = "Sheet1", pictures: list[dict] | None = None) -> bytes:
    """An Excel file of cells (row, col, value, bold, quote) and pictures (row, frame, data,
    ext). All values are text. A picture has its row to itself, which is as high as it is, and
    widens the first column to its own width."""
    pictures = [p for p in pictures or [] if p.get("data") is not None]
    widths, heights = dict(widths or {}), {}
    for p in pictures:
        widths[1] = max(widths.get(1, 0), p["frame"]["chars"])
        heights[int(p["row"])] = p["frame"]["points"]
    by_row: dict[int, list[dict]] = {r: [] for r in heights}
    for c in sorted(cells, key=lambda c: (c["row"], c["col"])):
        by_row.setdefault(int(c["row"]), []).append(c)
    look = lambda c: (1 if c["bold"] else 0) + (2 if c["quote"] else 0)
    cell = lambda c: f'<c r="{_column(int(c["col"]))}{int(c["row"])}" s="{look(c)}" t="inlineStr"><is><t xml:space="preserve">{escape(_clean(c["value"]))}</t></is></c>'
    high = lambda r: f' ht="{heights[r]:g}" customHeight="1"' if r in heights else ""
    rows = "".join(f'<row r="{r}"{high(r)}>{"".join(map(cell, by_row[r]))}</row>' for r in sorted(by_row))
    cols = "".join(f'<col min="{c}" max="{c}" width="{w:g}" customWidth="1"/>' for c, w in sorted(widths.items()))
    main = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    formats = "".join(f'<xf fontId="{i % 2}"{" quotePrefix=\"1\"" if i > 1 else ""}/>' for i in range(4))
    overrides = [("/xl/workbook.xml", f"{main}.sheet.main+xml"), ("/xl/styles.xml", f"{main}.styles+xml"), ("/xl/worksheets/sheet1.xml", f"{main}.worksheet+xml")]
    drawn: dict[str, str | bytes] = {}
    if pictures:
        overrides.append(("/xl/drawings/drawing1.xml", "application/vnd.openxmlformats-officedocument.drawing+xml"))
        names = [f"image{i}.{(p.get('ext') or 'png').lower()}" for i, p in enumerate(pictures, 1)]
        xdr = "http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing"
        anchors = "".join(_anchor(i, int(p["row"]), p["frame"]["px_w"], p["frame"]["px_h"]) for i, p in enumerate(pictures, 1))
        drawn = {
            "xl/worksheets/_rels/sheet1.xml.rels": _rels([("rId1", "drawing", "../drawings/drawing1.xml")]),
            "xl/drawings/drawing1.xml": f'{_HEAD}<xdr:wsDr xmlns:xdr="{xdr}" xmlns:r="{_OFFICE}">{anchors}</xdr:wsDr>',
            "xl/drawings/_rels/drawing1.xml.rels": _rels([(f"rId{i}", "image", f"../media/{n}") for i, n in enumerate(names, 1)]),
        } | {f"xl/media/{n}": bytes(p["data"]) for n, p in zip(names, pictures)}
    return _zip(
        {
            "[Content_Types].xml": _types(overrides, _PICTURES if pictures else {}),
            "_rels/.rels": _rels([("rId1", "officeDocument", "xl/workbook.xml")]),
            "xl/_rels/workbook.xml.rels": _rels([("rId1", "worksheet", "worksheets/sheet1.xml"), ("rId2", "styles", "styles.xml")]),
            "xl/workbook.xml": f'{_HEAD}<workbook xmlns="{_S}" xmlns:r="{_OFFICE}"><sheets><sheet name={quoteattr(name[:31])} sheetId="1" r:id="rId1"/></sheets></workbook>',
            "xl/styles.xml": f'{_HEAD}<styleSheet xmlns="{_S}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="4">{formats}</cellXfs></styleSheet>',
            "xl/worksheets/sheet1.xml": f'{_HEAD}<worksheet xmlns="{_S}" xmlns:r="{_OFFICE}">{f"<cols>{cols}</cols>" if cols else ""}<sheetData>{rows}</sheetData>{"<drawing r:id=\"rId1\"/>" if pictures else ""}</worksheet>',
        }
        | drawn
    )


#: Files that a worker hands on at once.
_FILES = 64


def _by_document(rows: DataFrame, names: tuple[str, ...], build: Callable[[list[dict]], bytes], ending: str) -> DataFrame:
    """(path, content): what ``build`` makes of the rows of each document, in any order. A file
    is made whole, so a document's rows meet in one task."""
    gathered = rows.groupBy("doc_id").agg(F.collect_list(F.struct(*names)).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, _FILES):
                part = batch.slice(i, _FILES)
                paths = [f"{k}{ending}" for k in part.column(0).to_pylist()]
                made = [build(x.as_py()) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(made, pa.binary())], ["path", "content"])

    return gathered.mapInArrow(run, "path string, content binary")


_LAYOUT = ("width_pt", "height_pt", "left_pt", "right_pt", "top_pt", "bottom_pt", "body_pt")


def word_files(plan: DataFrame, pictures: DataFrame | None = None, layouts: DataFrame | None = None, suffix: str = "") -> DataFrame:
    """(path, content) of a plan: a Word file per document. ``pictures``: path, data, ext;
    ``layouts``: doc_id with the page's size, margins and body size, which the file gets."""
    rows = plan
    if pictures is not None:
        rows = rows.join(pictures.select("path", "data", "ext"), "path", "left")
    else:
        rows = rows.withColumn("data", F.lit(None).cast("binary")).withColumn("ext", F.lit(None).cast("string"))
    if layouts is not None:
        # beside the document's first row only
        page = F.struct(*_LAYOUT).alias("layout")
        rows = rows.join(layouts.select(F.col("doc_id").alias("l_doc"), page), (F.col("doc_id") == F.col("l_doc")) & (F.col("seq") == 1), "left").drop("l_doc")
    else:
        rows = rows.withColumn("layout", F.lit(None).cast(f"struct<{','.join(f'{c}:double' for c in _LAYOUT)}>"))

    names = ("seq", "op", "text", "align", "bold", "point", "header", "grid", "width_in", "ratio", "data", "ext", "layout")

    def build(ops: list[dict]) -> bytes:
        ops.sort(key=lambda op: op["seq"])
        return word_bytes(ops, ops[0]["layout"])

    return _by_document(rows, names, build, f"{suffix}.docx")


def scan_files(plan: DataFrame, pictures: DataFrame, layouts: DataFrame | None = None) -> DataFrame:
    """(path, content) of a scan document's plan, named apart from the text document."""
    return word_files(plan, pictures, layouts, "_scan")


def sheet_files(cells: DataFrame, widths: DataFrame, placed: DataFrame | None = None, pictures: DataFrame | None = None) -> DataFrame:
    """(path, content): an Excel file per document. ``placed``: doc_id, row, path and frame of
    its pictures (``plans.sheet.sheet_pictures``); ``pictures``: path, data, ext."""
    frame = "struct<px_w:double,px_h:double,chars:double,points:double>"
    # one table of all that a file is made of; a kind tells the rows apart
    parts = cells.select("doc_id", F.lit("cell").alias("kind"), F.col("row"), F.col("col"), "value", "bold", "quote")
    parts = parts.unionByName(widths.select("doc_id", F.lit("width").alias("kind"), F.col("col"), F.col("width").cast("double").alias("width")), allowMissingColumns=True)
    if placed is not None and pictures is not None:
        drawn = placed.join(pictures.select("path", "data", "ext"), "path").select("doc_id", F.lit("picture").alias("kind"), "row", F.col("frame").cast(frame).alias("frame"), "data", "ext")
        parts = parts.unionByName(drawn, allowMissingColumns=True)

    else:
        parts = parts.withColumns({"frame": F.lit(None).cast(frame), "data": F.lit(None).cast("binary"), "ext": F.lit(None).cast("string")})

    def build(rows: list[dict]) -> bytes:
        of = lambda kind: [r for r in rows if r["kind"] == kind]
        return sheet_bytes(of("cell"), {int(w["col"]): w["width"] for w in of("width")}, pictures=sorted(of("picture"), key=lambda p: p["row"]))

    return _by_document(parts, ("kind", "row", "col", "value", "bold", "quote", "width", "frame", "data", "ext"), build, ".xlsx")


def image_files(images: DataFrame) -> DataFrame:
    """(path, content) of extracted images (path, data), for ``save_files``."""
    return images.where("data is not null").select("path", F.col("data").alias("content"))


def save_files(made: DataFrame, folder: str) -> None:
    """Write (path, content) rows as files into a folder that all executors share: a mounted
    one, as the files are made with the system's calls."""

    def put(rows) -> None:
        from pathlib import Path

        for row in rows:
            target = Path(folder, row.path)
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_bytes(bytes(row.content))

    made.foreachPartition(put)
