"""External engines behind one small protocol: PDF reading, rendering, OCR, vision models
and office conversion.

A provider maps a file's bytes to rows; ``provided`` runs it inside batches on the
executors, one file at a time, and turns an exception into an ``error`` column, so one bad
file fails alone. None of the engines is a dependency: a provider says if it is available
and what to install. ``FakePdf`` and ``FakeModel`` are deterministic stand-ins for tests;
the fake's file format is the JSON of the rows themselves.
"""

from __future__ import annotations

import json
import shutil
import subprocess
import tempfile
from collections.abc import Iterator
from pathlib import Path
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import _parse_datatype_string

PDF_PAGES = (
    "page_no int, width_pt double, height_pt double, source_text string, "
    "spans array<struct<blk:int,line:int,span:int,text:string,size:double,font:string,x0:double,y0:double,x1:double,y1:double>>, "
    "geo array<struct<ord:int,x0:double,y0:double,x1:double,y1:double,text:string>>, "
    "tables array<struct<ord:int,x0:double,y0:double,x1:double,y1:double,col_count:int,grid:array<array<string>>>>, "
    "images array<struct<ord:int,x0:double,y0:double,x1:double,y1:double,px_w:int,px_h:int,ext:string,data:binary>>"
)


class Provider(Protocol):
    #: DDL of the rows it makes.
    columns: str

    def available(self) -> bool: ...

    def hint(self) -> str:
        """What to install where it is not available."""
        ...

    def rows(self, content: bytes) -> Iterator[dict]: ...


_providers: dict[str, Provider] = {}


def register(role: str, provider: Provider) -> None:
    """Roles: pdf, render, ocr, model, office."""
    _providers[role] = provider


def provider(role: str) -> Provider:
    found = _providers.get(role)
    if found is None:
        raise LookupError(f"no provider is registered for {role}")
    if not found.available():
        raise LookupError(f"{role}: {found.hint()}")
    return found


def provided(files: DataFrame, made_by: Provider, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """The kept columns, the provider's, and error, for every row that it makes of content."""
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in files.select(*keep).schema.fields), made_by.columns, "error string"])
    names = files.select(*keep).columns
    columns = [*names, *(f.name for f in _parse_datatype_string(made_by.columns).fields), "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for values in batch.to_dict("records"):
                content = values.pop("content")
                try:
                    rows = list(made_by.rows(content))
                except Exception as error:  # any engine, any fault: the row says which
                    rows = [{"error": f"{type(error).__name__}: {error}"}]
                if rows:
                    frame = pd.DataFrame([{**dict.fromkeys(columns), **r, **values} for r in rows], columns=columns)
                    yield frame.astype(object).where(frame.notna(), None)

    return files.select(*keep, "content").mapInPandas(run, schema)


class FakePdf:
    """Reads a JSON list of pages with the fields of ``PDF_PAGES``."""

    columns = PDF_PAGES

    def available(self) -> bool:
        return True

    def hint(self) -> str:
        return ""

    def rows(self, content: bytes) -> Iterator[dict]:
        yield from json.loads(content)


class FakeModel:
    """Answers for a page image with the text that the image's bytes are."""

    columns = "json string"

    def available(self) -> bool:
        return True

    def hint(self) -> str:
        return ""

    def rows(self, content: bytes) -> Iterator[dict]:
        yield {"json": content.decode()}


class FakeRender:
    """Renders a page of the fake format as the bytes of its text, at a resolution."""

    columns = "page_no int, dpi int, image binary"

    def __init__(self, dpi: int = 125):
        self.dpi = dpi

    def available(self) -> bool:
        return True

    def hint(self) -> str:
        return ""

    def rows(self, content: bytes) -> Iterator[dict]:
        for page in json.loads(content):
            yield {"page_no": page["page_no"], "dpi": self.dpi, "image": (page.get("source_text") or "").encode()}


class Tesseract:
    """OCR of a page image by the ``tesseract`` program; empty text on any of its errors."""

    columns = "ocr_text string"

    def __init__(self, lang: str = "eng", timeout: int = 60):
        self.lang, self.timeout = lang, timeout

    def available(self) -> bool:
        return shutil.which("tesseract") is not None

    def hint(self) -> str:
        return "install the tesseract program and its language data"

    def rows(self, content: bytes) -> Iterator[dict]:
        try:
            done = subprocess.run(["tesseract", "stdin", "stdout", "-l", self.lang], input=content, capture_output=True, timeout=self.timeout)
            yield {"ocr_text": done.stdout.decode("utf-8", "replace") if done.returncode == 0 else ""}
        except (OSError, subprocess.SubprocessError):
            yield {"ocr_text": ""}


class Office:
    """A Word file as PDF, by LibreOffice with a profile of its own for every run."""

    columns = "pdf binary"

    def __init__(self, timeout: int = 180):
        self.timeout = timeout

    def program(self) -> str | None:
        return shutil.which("soffice") or shutil.which("libreoffice")

    def available(self) -> bool:
        return self.program() is not None

    def hint(self) -> str:
        return "install LibreOffice"

    def rows(self, content: bytes) -> Iterator[dict]:
        with tempfile.TemporaryDirectory() as folder:
            source = Path(folder, "in.docx")
            source.write_bytes(content)
            command = [self.program(), f"-env:UserInstallation=file://{folder}/profile", "--headless", "--convert-to", "pdf", "--outdir", folder, str(source)]
            subprocess.run(command, capture_output=True, timeout=self.timeout, check=True)
            yield {"pdf": Path(folder, "in.pdf").read_bytes()}
