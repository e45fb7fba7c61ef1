"""Word and Excel files as tables, read from Spark's binary file source.

A file is one row; its parts are read with the standard library inside Arrow batches, so
files are spread over the executors and any path that Spark reads will do.
"""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"

BODY = (
    "path string, ord int, kind string, style string, align string, text string, sha1 string, n_rows int, n_cols int, "
    "cells array<array<string>>, merged array<array<int>>, error string"
)
CELLS = "path string, sheet string, row long, col long, value string, error string"


def files(spark: SparkSession, path: str | list[str], pattern: str | None = None, missing: str = "raise") -> DataFrame:
    """path, length and content of files; ``pattern`` is a glob on their names. Paths that do
    not exist raise, or, with ``missing="skip"``, are left out."""
    paths = [path] if isinstance(path, str) else list(path)
    if missing == "skip":
        there = []
        for p in paths:
            target = spark._jvm.org.apache.hadoop.fs.Path(p)
            if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target):
                there.append(p)
        if not there:
            return spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
        paths = there
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(paths)


def _text(element) -> str:
    out = []
    for node in element.iter():
        if node.tag == f"{_W}t":
            out.append(node.text or "")
        elif node.tag == f"{_W}tab":
            out.append("\t")
        elif node.tag in (f"{_W}br", f"{_W}cr"):
            out.append("\n")
    return "".join(out)


def _value(element, path: str, default: str | None = None) -> str | None:
    found = element.find(path)
    return default if found is None else found.get(f"{_W}val", default)


def body_of(content: bytes) -> list[dict]:
    """Paragraphs, tables and pictures of a Word file in the order of its body."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        links = {}
        if "word/_rels/document.xml.rels" in z.namelist():
            links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("word/_rels/document.xml.rels"))}
        out = []
        for child in body:
            if child.tag == f"{_W}p":
                drawn = [b.get(f"{_R}embed") for b in child.iter(f"{_A}blip")]
                if child.find(f".//{_W}drawing") is not None:
                    name = links.get(drawn[0]) if drawn else None
                    data = z.read(f"word/{name}") if name and f"word/{name}" in z.namelist() else None
                    out.append({"kind": "image", "sha1": hashlib.sha1(data).hexdigest() if data is not None else None})
                else:
                    out.append({"kind": "text", "text": _text(child), "style": _value(child, f"{_W}pPr/{_W}pStyle"), "align": _value(child, f"{_W}pPr/{_W}jc")})
            elif child.tag == f"{_W}tbl":
                rows = [[tc for tc in tr.findall(f"{_W}tc")] for tr in child.findall(f"{_W}tr")]
                spans = [[int(_value(tc, f"{_W}tcPr/{_W}gridSpan", "1")) for tc in r] for r in rows]
                grid = child.findall(f"{_W}tblGrid/{_W}gridCol")
                cells = [["\n".join(_text(p) for p in tc.findall(f"{_W}p")) for tc in r] for r in rows]
                out.append({"kind": "table", "cells": cells, "merged": spans, "n_rows": len(rows), "n_cols": len(grid) or max(map(sum, spans), default=0)})
        return out


def cells_of(content: bytes) -> list[dict]:
    """All cells with a value, of all sheets, as text."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            target = links[sheet.get(f"{_R}id")].lstrip("/")
            tree = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            for c in tree.iter(f"{_S}c"):
                letters = "".join(x for x in c.get("r") if x.isalpha())
                col = 0
                for x in letters:
                    col = col * 26 + ord(x) - 64
                if c.get("t") == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                else:
                    v = c.find(f"{_S}v")
                    if v is None:
                        continue
                    value = shared[int(v.text)] if c.get("t") == "s" else v.text
                out.append({"sheet": sheet.get("name"), "row": int(c.get("r")[len(letters) :]), "col": col, "value": value})
        return out


#: Rows that a worker hands on at once, if no file has more.
_ROWS = 2048


def _parsed(found: DataFrame, columns: str, parse) -> DataFrame:
    """The rows that ``parse`` makes of each file's content, with their path and place."""
    schema = to_arrow_schema(_parse_datatype_string(columns))
    names = set(schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                try:
                    rows = [{**r, "ord": i} for i, r in enumerate(parse(content.as_py()))]
                except (KeyError, ValueError, zipfile.BadZipFile, ElementTree.ParseError, AttributeError) as error:
                    rows = [{"error": f"{type(error).__name__}: {error}"}]
                held += [{**{k: v for k, v in r.items() if k in names}, "path": path.as_py()} for r in rows]
                if len(held) >= _ROWS:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return found.select("path", "content").mapInArrow(run, columns)


def word_body(found: DataFrame) -> DataFrame:
    """Body elements of Word files in order; a damaged file is one row with its error."""
    return _parsed(found, BODY, body_of)


def sheet_cells(found: DataFrame) -> DataFrame:
    """Cells of Excel files; a damaged file is one row with its error."""
    return _parsed(found, CELLS, cells_of)


def word_summary(body: DataFrame) -> DataFrame:
    """Per file: text, paragraphs, tables (rows, cols, cells), images."""
    from ..functions import text as T

    ordered = body.where("error is null").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ord", "kind", "text", "n_rows", "n_cols", "cells"))).alias("b"))
    of = lambda kind: F.filter("b", lambda x: x["kind"] == kind)
    full = lambda xs: F.filter(F.transform(xs, T.strip), lambda x: x != "")
    tables = F.transform(of("table"), lambda t: F.struct(t["n_rows"].alias("rows"), t["n_cols"].alias("cols"), full(F.flatten(t["cells"])).alias("cells")))
    rows = ordered.select("path", full(F.transform(of("text"), lambda x: x["text"])).alias("paragraphs"), tables.alias("tables"), F.size(of("image")).alias("images"))
    text = F.array_join(F.concat("paragraphs", F.flatten(F.transform("tables", lambda t: t["cells"]))), "\n")
    return rows.withColumn("text", text)


def describe_body(body: DataFrame) -> DataFrame:
    """A line per body element, and its kind, for reading a file's order off."""
    size = F.concat(F.lit("table "), F.col("n_rows").cast("string"), F.lit("x"), F.col("n_cols").cast("string"))
    line = F.when(F.col("kind") == "table", size).when(F.col("kind") == "image", "image").otherwise(F.substring("text", 1, 88))
    return body.select("path", "ord", "kind", "style", line.alias("line"))


def body_counts(body: DataFrame) -> DataFrame:
    return body.where("error is null").groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"))
