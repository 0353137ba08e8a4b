"""Texts of office files, read by Spark as binary files: word processor and spreadsheet archives of XML."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

MOST_BYTES = 10 * 1024 * 1024
PARTS = {"docx": r"word/document\.xml$", "hwpx": r"Contents/section\d+\.xml$", "xlsx": r"xl/worksheets/sheet\d+\.xml$"}


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def paragraphs(tree: ElementTree.Element) -> list[str]:
    """Texts of the paragraphs of a document part."""
    return [t for p in tree.iter() if _local(p.tag) == "p" if (t := "".join(x.text or "" for x in p.iter() if _local(x.tag) == "t").strip())]


def sheet_rows(tree: ElementTree.Element, shared: list[str]) -> list[str]:
    """Rows of a sheet part, their cells separated by tabs."""
    rows = []
    for row in (r for r in tree.iter() if _local(r.tag) == "row"):
        cells = []
        for cell in (c for c in row if _local(c.tag) == "c"):
            text = "".join(x.text or "" for x in cell.iter() if _local(x.tag) in ("v", "t"))
            cells.append(shared[int(text)] if cell.get("t") == "s" and text.isdigit() and int(text) < len(shared) else text)
        if any(cells):
            rows.append("\t".join(cells))
    return rows


def lines_of(path: str, content: bytes) -> tuple[list[str], str | None]:
    """Lines of one file, or none and why."""
    kind = path.rpartition(".")[2].lower()
    if kind not in PARTS:
        return [], "unsupported_type"
    if len(content) > MOST_BYTES:
        return [], "too_large"
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            names = sorted((n for n in archive.namelist() if re.search(PARTS[kind], n)), key=lambda n: (len(n), n))
            if sum(archive.getinfo(n).file_size for n in archive.namelist()) > 20 * MOST_BYTES:
                return [], "too_large"
            if kind != "xlsx":
                return [line for n in names for line in paragraphs(ElementTree.fromstring(archive.read(n)))], None
            shared: list[str] = []
            if "xl/sharedStrings.xml" in archive.namelist():
                strings = ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))
                shared = ["".join(t.text or "" for t in s.iter() if _local(t.tag) == "t") for s in strings if _local(s.tag) == "si"]
            return [line for n in names for line in sheet_rows(ElementTree.fromstring(archive.read(n)), shared)], None
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, RuntimeError):
        return [], "unreadable"


def read_office(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no, line and error for the files below ``path``: their lines, or one row with an error."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch.path, batch.content, strict=True):
                found, error = lines_of(file, content)
                numbers = range(1, len(found) + 1) if found else [0]
                yield pd.DataFrame({"path": file, "line_no": list(numbers), "line": found or [None], "error": error})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(lines, "path string, line_no int, line string, error string")
