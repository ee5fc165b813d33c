"""Workbooks (Office Open XML) as rows: values only, one file per task, read with the standard library's archive and XML readers.

Defined results: numbers stay as written, booleans are 'true' and 'false', formulas give their stored value, empty cells have no row;
a file that is no workbook gives one row with problem set and everything else null; phonetic hints are no part of a text.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CELLS = "name string, position int, sheet string, n_row int, n_column int, value string, problem string"
_SCHEMA = pa.schema([("name", pa.string()), ("position", pa.int32()), ("sheet", pa.string()), ("n_row", pa.int32()), ("n_column", pa.int32()), ("value", pa.string()), ("problem", pa.string())])
_BATCH = 50_000


def _tag(element: ElementTree.Element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _text(element: ElementTree.Element) -> str:
    """The text runs below an element, without phonetic ones."""
    return "".join((e.text or "") if _tag(e) == "t" else _text(e) for e in element if _tag(e) != "rPh")


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    with book.open("xl/sharedStrings.xml") as part:
        return [_text(e) for _, e in ElementTree.iterparse(part) if _tag(e) == "si"]


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of the sheets in order."""
    targets = {e.get("Id"): e.get("Target", "") for e in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter():
        if _tag(e) == "sheet":
            target = next((targets[v] for k, v in e.attrib.items() if k.endswith("}id") and v in targets), "")
            out.append((e.get("name", ""), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return out


def _column(reference: str) -> int:
    n = 0
    for letter in re.match("[A-Z]*", reference)[0]:
        n = 26 * n + ord(letter) - 64
    return n


def _value(cell: ElementTree.Element, shared: list[str]) -> str | None:
    kind, stored, inline = cell.get("t", "n"), None, None
    for e in cell:
        if _tag(e) == "v":
            stored = e.text
        elif _tag(e) == "is":
            inline = _text(e)
    if kind == "inlineStr":
        return inline
    if stored is None:
        return None
    if kind == "s":
        return shared[int(stored)]
    return {"1": "true", "0": "false"}.get(stored, stored) if kind == "b" else stored


def read_cells(content: bytes) -> Iterator[tuple[int, str, int, int, str]]:
    """(position, sheet, row, column, value) of a workbook's filled cells; positions, rows and columns count from 1."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = _shared(book)
        for position, (sheet, part) in enumerate(_sheets(book), 1):
            row = 0
            with book.open(part) as data:
                for _, e in ElementTree.iterparse(data):
                    if _tag(e) != "row":
                        continue
                    row, column = int(e.get("r", row + 1)), 0
                    for cell in e:
                        column = _column(cell.get("r", "")) or column + 1
                        value = _value(cell, shared)
                        if value is not None:
                            yield position, sheet, row, column, value
                    e.clear()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)

    for files in batches:
        for path, content in zip(files.column(0).to_pylist(), files.column(1).to_pylist()):
            name, rows = path.rsplit("/", 1)[-1], []
            try:
                for found in read_cells(content):
                    rows.append((name, *found, None))
                    if len(rows) >= _BATCH:
                        yield batch(rows)
                        rows = []
            except (zipfile.BadZipFile, KeyError, IndexError, ValueError, ElementTree.ParseError) as e:
                rows.append((name, None, None, None, None, None, type(e).__name__))
            if rows:
                yield batch(rows)


def cells(spark: SparkSession, path: str) -> DataFrame:
    """name, position, sheet, n_row, n_column, value, problem of the workbooks at a path."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_read, _CELLS)


def sheet_names(found: DataFrame) -> DataFrame:
    """name, position, sheet of the sheets that hold anything."""
    return found.where("problem is null").select("name", "position", "sheet").distinct()


def rows(found: DataFrame, sheet: str, columns: list[str]) -> DataFrame:
    """name, n_row and the named columns, from the first on, of one sheet's rows that hold anything."""
    wide = [F.max(F.when(F.col("n_column") == i, F.col("value"))).alias(c) for i, c in enumerate(columns, 1)]
    return found.where(F.col("sheet") == sheet).groupBy("name", "n_row").agg(*wide)
