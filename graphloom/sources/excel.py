"""Workbooks (.xlsx): the first sheet's cells as text rows. Each file is one row of binaryFile, so files spread over executors; a sheet is parsed as a stream."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def _sheet(book: zipfile.ZipFile) -> str:
    """The first sheet's part, as the workbook lists it."""
    first = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{_NS}sheets/{_NS}sheet").get(_REL)
    rels = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(r.get("Target") for r in rels if r.get("Id") == first)
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def rows_of(content: bytes):
    """(row number from 0, cells) of the first sheet. Text, numbers and booleans become text, all else is empty."""
    book = zipfile.ZipFile(io.BytesIO(content))
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_NS}t"))
    shared = [text(si) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in book.namelist() else []
    with book.open(_sheet(book)) as part:
        k = 0
        for _, e in ElementTree.iterparse(part):
            if e.tag != f"{_NS}row":
                continue
            cells: list[str] = []
            for c in e.iter(f"{_NS}c"):
                at = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [""] * (at + 1 - len(cells))
                value, kind = c.findtext(f"{_NS}v"), c.get("t", "n")
                if kind == "s" and value is not None:
                    cells[at] = shared[int(value)]
                elif kind == "inlineStr":
                    cells[at] = text(c)
                elif kind == "b" and value is not None:
                    cells[at] = "true" if value == "1" else "false"
                elif kind in ("n", "str") and value is not None:
                    cells[at] = value
            yield k, cells
            k += 1
            e.clear()


def read(spark: SparkSession, path: str) -> DataFrame:
    """file, row, cells of all workbooks under a path."""

    def parse(batches):
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                out = []
                for k, cells in rows_of(bytes(content)):
                    out.append((name, k, cells))
                    if len(out) == 10_000:
                        yield pd.DataFrame(out, columns=["file", "row", "cells"])
                        out = []
                yield pd.DataFrame(out, columns=["file", "row", "cells"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(parse, "file string, row long, cells array<string>")


def table(rows: DataFrame, file: str) -> DataFrame:
    """One workbook with its first row as header, repaired; short rows are filled. Only the header and the greatest width go to the driver."""
    from graphloom.sources.tabular import repaired

    mine = rows.where(F.col("file").endswith(file))
    head, width = mine.agg(F.min_by("cells", "row"), F.max(F.size("cells"))).first()
    names = repaired(list(head or []), width or 0)
    return mine.where("row > 0").select(*(F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)))
