"""Readers of office files: word-processor, slide and spreadsheet packages (zip archives of XML), as Arrow-batched table operators.

Spark reads the files (``binaryFile``), so any store it knows will do; a file is one row, and a broken one gives
its error in place of text.
"""

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Bytes that one part of an archive may unpack to.
PART_BYTES = 256 << 20
PARTS_SCHEMA = "path string, part int, text string, error string"
CELLS_SCHEMA = "path string, sheet string, row int, cells array<string>, error string"


def _tag(node) -> str:
    return node.tag.rsplit("}", 1)[-1]


def _xml(archive: zipfile.ZipFile, name: str):
    if archive.getinfo(name).file_size > PART_BYTES:
        raise ValueError(f"{name} is larger than {PART_BYTES} bytes")
    data = archive.read(name)
    if b"<!DOCTYPE" in data[:4096]:
        raise ValueError(f"{name} declares a document type")
    return ElementTree.fromstring(data)


def _paragraphs(root) -> list[str]:
    """The text of each paragraph, tabs and line breaks kept."""
    out = []
    for p in root.iter():
        if _tag(p) == "p":
            marks = {"t": lambda n: n.text or "", "tab": lambda n: "\t", "br": lambda n: "\n"}
            text = "".join(marks[_tag(n)](n) for n in p.iter() if _tag(n) in marks).strip()
            if text:
                out.append(text)
    return out


def _numbered(archive: zipfile.ZipFile, pattern: str) -> list[str]:
    """Names of the archive that match, by their number."""
    found = [(int(m[1]), m[0]) for name in archive.namelist() if (m := re.fullmatch(pattern, name))]
    return [name for _, name in sorted(found)]


def document_parts(data: bytes) -> list[str]:
    """The text of a word-processor file (one part) or of each slide of a presentation."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        if "word/document.xml" in archive.namelist():
            return ["\n".join(_paragraphs(_xml(archive, "word/document.xml")))]
        slides = _numbered(archive, r"ppt/slides/slide(\d+)\.xml")
        if not slides:
            raise ValueError("neither a text document nor a presentation")
        return ["\n".join(_paragraphs(_xml(archive, name))) for name in slides]


def _column(reference: str) -> int:
    n = 0
    for letter in re.match(r"[A-Z]*", reference)[0]:
        n = 26 * n + ord(letter) - 64
    return n - 1


def sheet_rows(data: bytes) -> list[tuple[str, int, list]]:
    """(sheet, row, cells) of a workbook; empty cells between others are null, shared and inline strings are resolved."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = archive.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter() if _tag(t) == "t") for si in _xml(archive, "xl/sharedStrings.xml") if _tag(si) == "si"]
        sheets = [n for n in _xml(archive, "xl/workbook.xml").iter() if _tag(n) == "sheet"]
        out = []
        for at, name in enumerate(_numbered(archive, r"xl/worksheets/sheet(\d+)\.xml")):
            title = sheets[at].get("name") if at < len(sheets) else name
            for row in (n for n in _xml(archive, name).iter() if _tag(n) == "row"):
                cells: list = []
                for cell in row:
                    place = _column(cell.get("r") or "") if cell.get("r") else len(cells)
                    cells += [None] * (place - len(cells))
                    value = next((n.text for n in cell.iter() if _tag(n) == "v"), None)
                    if cell.get("t") == "s" and value is not None:
                        value = shared[int(value)]
                    elif cell.get("t") == "inlineStr":
                        value = "".join(n.text or "" for n in cell.iter() if _tag(n) == "t")
                    cells.append(value)
                out.append((title, int(row.get("r") or len(out) + 1), cells))
        return out


def _binary(spark: SparkSession, path: str, names: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", names).option("recursiveFileLookup", "true").load(path).select("path", "content")


BROKEN = (ValueError, KeyError, IndexError, zipfile.BadZipFile, ElementTree.ParseError)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, part, text, error) of all text documents and presentations below a path."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows = [(name, n, text, None) for n, text in enumerate(document_parts(data))]
                except BROKEN as error:
                    rows = [(name, 0, None, str(error))]
                yield pd.DataFrame(rows, columns=["path", "part", "text", "error"])

    return _binary(spark, path, "*.{docx,pptx}").mapInPandas(run, PARTS_SCHEMA)


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, cells, error) of all workbooks below a path."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows = [(name, *row, None) for row in sheet_rows(data)]
                except BROKEN as error:
                    rows = [(name, None, 0, None, str(error))]
                yield pd.DataFrame(rows, columns=["path", "sheet", "row", "cells", "error"])

    return _binary(spark, path, "*.xlsx").mapInPandas(run, CELLS_SCHEMA)
