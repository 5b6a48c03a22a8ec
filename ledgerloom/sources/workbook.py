"""Spreadsheet cells as a data source: one row per sheet row, read with the standard library's zip and XML readers."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
_SCHEMA = "file string, sheet_no int, sheet string, row_no int, cells array<string>, error string"
#: A workbook that unpacks to more than this is not read.
MAX_UNPACKED = 200 * 1024 * 1024


def _column(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]*", reference)[0]:
        number = number * 26 + ord(letter) - 64
    return max(number - 1, 0)


def workbook_rows(content: bytes) -> list[tuple[int, str, int, list[str]]]:
    """(number of the sheet from 0, sheet, row number from 1, cells) of an .xlsx file; blank rows in between are kept. Raises ValueError with a code."""
    try:
        book = zipfile.ZipFile(io.BytesIO(content))
        names = set(book.namelist())
        if sum(i.file_size for i in book.infolist()) > MAX_UNPACKED:
            raise ValueError("FILE_TOO_LARGE")
        if any(n.lower().endswith("vbaproject.bin") for n in names):
            raise ValueError("MACRO_NOT_ALLOWED")
        strings: list[str] = []
        if "xl/sharedStrings.xml" in names:
            strings = ["".join(t.text or "" for t in item.iter(f"{{{_NS['m']}}}t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for at_sheet, sheet in enumerate(ElementTree.fromstring(book.read("xl/workbook.xml")).find("m:sheets", _NS)):
            target = targets[sheet.get(f"{{{_NS['r']}}}id")].lstrip("/")
            tree = ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}"))
            last = 0
            for row in tree.iter(f"{{{_NS['m']}}}row"):
                number = int(row.get("r") or last + 1)
                out += [(at_sheet, sheet.get("name"), blank, []) for blank in range(last + 1, number)]
                cells: list[str] = []
                for cell in row.findall("m:c", _NS):
                    at = _column(cell.get("r") or "") if cell.get("r") else len(cells)
                    cells += [""] * (at + 1 - len(cells))
                    value, kind = cell.find("m:v", _NS), cell.get("t")
                    if kind == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in cell.iter(f"{{{_NS['m']}}}t"))
                    elif value is not None:
                        cells[at] = strings[int(value.text)] if kind == "s" else value.text or ""
                out.append((at_sheet, sheet.get("name"), number, cells))
                last = number
        return out
    except ValueError:
        raise
    except Exception as problem:
        raise ValueError("CORRUPTED_FILE") from problem


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Cells of all .xlsx files under a path that Spark can read: file, sheet_no, sheet, row_no, cells, error.

    A file that cannot be read gives one row with an error code. Files are the unit of parallelism.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "sheet_no", "sheet", "row_no", "cells", "error"]
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    rows = [(name, *row, None) for row in workbook_rows(content)]
                except ValueError as problem:
                    rows = [(name, None, None, None, None, str(problem))]
                if rows:
                    kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return files.mapInArrow(read, _SCHEMA)
