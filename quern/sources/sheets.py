"""Sheets of .xlsx workbooks as rows of text, with the standard library alone.

A workbook can't be split, so one task reads it; the rows leave it in batches.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quern.operators.ingest import IngestError

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Numbers of the built-in formats of dates and times.
DATE_FORMATS = frozenset([*range(14, 23), 27, 30, 36, *range(45, 48), 50, 57])
_ROWS = 2_000


def _texts(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def _number_text(value: str, dated: bool, origin: datetime) -> str:
    number = float(value)
    if dated:
        at = origin + timedelta(days=number)
        at = (at + timedelta(microseconds=500)).replace(microsecond=0)
        return at.isoformat()
    return str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)


class Workbook:
    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        self.sheets = [(s.get("name"), links[s.get(_REL)]) for s in book.iter(f"{_MAIN}sheet")]
        pr = book.find(f"{_MAIN}workbookPr")
        self.origin = datetime(1904, 1, 1) if pr is not None and pr.get("date1904") in ("1", "true") else datetime(1899, 12, 30)
        names = self.zip.namelist()
        self.shared = [_texts(si) for si in ElementTree.fromstring(self.zip.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")] if "xl/sharedStrings.xml" in names else []
        self.dated: list[bool] = []
        if "xl/styles.xml" in names:
            styles = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
            own = {f.get("numFmtId"): f.get("formatCode", "") for f in styles.iter(f"{_MAIN}numFmt")}
            xfs = styles.find(f"{_MAIN}cellXfs")
            for xf in xfs if xfs is not None else []:
                code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own.get(xf.get("numFmtId"), ""))
                self.dated.append(int(xf.get("numFmtId") or 0) in DATE_FORMATS or bool(re.search("[ymdhs]", code, re.I)))

    def rows(self, sheet: int | str) -> Iterator[tuple[int, list[str]]]:
        """(number, cells) of the rows of a sheet, by its place from 0 or its name."""
        if isinstance(sheet, int):
            if not 0 <= sheet < len(self.sheets):
                raise IngestError(f"no sheet {sheet}")
            target = self.sheets[sheet][1]
        else:
            found = [t for n, t in self.sheets if n == sheet]
            if not found:
                raise IngestError(f"no sheet {sheet!r}")
            target = found[0]
        path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        number = 0
        with self.zip.open(path) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_MAIN}row":
                    continue
                number = int(row.get("r") or number + 1)
                cells: list[str] = []
                for c in row.iter(f"{_MAIN}c"):
                    at = len(cells)
                    if m := re.match("[A-Z]+", c.get("r") or ""):
                        at = 0
                        for letter in m.group():
                            at = at * 26 + ord(letter) - 64
                        at -= 1
                    cells += [""] * (at + 1 - len(cells))
                    cells[at] = self._cell(c)
                yield number, cells
                row.clear()

    def _cell(self, c: ElementTree.Element) -> str:
        kind, v = c.get("t"), c.find(f"{_MAIN}v")
        if kind == "inlineStr":
            return _texts(c)
        if v is None or v.text is None:
            return ""
        if kind == "s":
            return self.shared[int(v.text)]
        if kind == "b":
            return "True" if v.text == "1" else "False"
        if kind in ("str", "e", "d"):
            return v.text
        style = int(c.get("s") or 0)
        return _number_text(v.text, style < len(self.dated) and self.dated[style], self.origin)


def sheet_rows(spark: SparkSession, path: str, sheet: int | str = 0) -> DataFrame:
    """``position, cells`` of a sheet, whose header row is 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple[int, list[str]]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.int64()), pa.array([c for _, c in rows], pa.list_(pa.string()))], names=["position", "cells"])

        for b in batches:
            for content in b.column("content"):
                held: list[tuple[int, list[str]]] = []
                for row in Workbook(content.as_py()).rows(sheet):
                    held.append(row)
                    if len(held) == _ROWS:
                        yield batch(held)
                        held = []
                yield batch(held)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "position bigint, cells array<string>")
