"""Workbooks (.xlsx, .xls) read with the standard library: cells with merged ranges filled, and sheets as lines of CSV.

A workbook is one zip file and so one task's; sheets are parsed as streams and rows are given on in batches.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import legacy

_BATCH = 20_000
#: Numbers of the built-in date formats.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_SHEETS = "xl/workbook.xml"


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _tree(book: zipfile.ZipFile, part: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(book.read(part)) if part in book.namelist() else None


def _each(tree: ElementTree.Element | None, name: str) -> list[ElementTree.Element]:
    return [] if tree is None else [e for e in tree.iter() if _name(e.tag) == name]


def _attribute(e: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if _name(k) == name), None)


def _text(e: ElementTree.Element) -> str:
    """A string of plain or rich text, readings of characters left out."""
    out = []
    for child in e:
        if _name(child.tag) == "t":
            out.append(child.text or "")
        elif _name(child.tag) == "r":
            out += [t.text or "" for t in child if _name(t.tag) == "t"]
    return "".join(out)


def _place(ref: str) -> tuple[int, int]:
    """Row and column from 1 of a reference such as B3."""
    column, row = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", ref).groups()
    n = 0
    for c in column:
        n = 26 * n + ord(c) - 64
    return int(row), n


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    tree = _tree(book, "xl/styles.xml")
    own = {int(e.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", e.get("formatCode", "")) for e in _each(tree, "numFmt")}
    dates = DATE_FORMATS | {k for k, code in own.items() if re.search("[ymdhs]", code.lower())}
    formats = [x for table in _each(tree, "cellXfs") for x in table]
    return {i for i, x in enumerate(formats) if int(x.get("numFmtId", 0)) in dates}


def _shown(cell: ElementTree.Element, shared: list[str], dates: set[int], start: datetime) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return next((_text(e) for e in cell if _name(e.tag) == "is"), None)
    raw = next((e.text for e in cell if _name(e.tag) == "v"), None)
    if raw is None:
        return None
    if kind == "s":
        return shared[int(raw)]
    if kind == "b":
        return "True" if raw == "1" else "False"
    if kind in ("str", "e", "d"):
        return raw
    value = int(raw) if re.fullmatch(r"[+-]?\d+", raw) else float(raw)
    if int(cell.get("s", 0)) in dates:
        return str(start + timedelta(days=value)) if value % 1 else str((start + timedelta(days=value)).date())
    return str(value)


def sheets(raw: bytes) -> Iterator[tuple[str, Iterator[tuple[int, int, str]], list[tuple[int, int, int, int]]]]:
    """(name, cells, merged ranges) of each sheet; cells are (row, column, text) from 1, without empty ones."""
    with zipfile.ZipFile(io.BytesIO(raw)) as book:
        shared = [_text(e) for e in _each(_tree(book, "xl/sharedStrings.xml"), "si")]
        targets = {e.get("Id"): e.get("Target") for e in _each(_tree(book, "xl/_rels/workbook.xml.rels"), "Relationship")}
        head, dates = _tree(book, _SHEETS), _date_styles(book)
        late = any(e.get("date1904") in ("1", "true") for e in _each(head, "workbookPr"))
        start = datetime(1904, 1, 1) if late else datetime(1899, 12, 30)
        for sheet in _each(head, "sheet"):
            part = posixpath.normpath(posixpath.join("/xl", targets[_attribute(sheet, "id")])).lstrip("/")
            ranges = []
            with book.open(part) as f:  # ranges stand behind the cells, so a first pass finds them
                for _, e in ElementTree.iterparse(f):
                    if _name(e.tag) == "mergeCell":
                        a, _, b = e.get("ref").partition(":")
                        ranges.append((*_place(a), *_place(b or a)))
                    elif _name(e.tag) == "row":
                        e.clear()

            def cells(part=part) -> Iterator[tuple[int, int, str]]:
                row_no = 0
                with book.open(part) as f:
                    for _, e in ElementTree.iterparse(f):
                        if _name(e.tag) != "row":
                            continue
                        row_no, column = int(e.get("r", row_no + 1)), 0
                        for c in e:
                            column = _place(c.get("r"))[1] if c.get("r") else column + 1
                            if (shown := _shown(c, shared, dates, start)) is not None:
                                yield row_no, column, shown
                        e.clear()

            yield sheet.get("name"), cells(), ranges


def _batches(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == _BATCH:
            yield pd.DataFrame(held, columns=columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns)


def _filled(cells: Iterator[tuple[int, int, str]], ranges: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, int, str]]:
    """Cells and, for each merged range, its first cell's text at all its places."""
    first = {(r0, c0): (r1, c1) for r0, c0, r1, c1 in ranges}
    inside = lambda r, c: any(r0 <= r <= r1 and c0 <= c <= c1 and (r, c) != (r0, c0) for r0, c0, r1, c1 in ranges)
    for r, c, text in cells:
        if (r, c) in first:
            r1, c1 = first[r, c]
            yield from ((i, j, text) for i in range(r, r1 + 1) for j in range(c, c1 + 1))
        elif not inside(r, c):
            yield r, c, text


def workbook_cells(files: DataFrame) -> DataFrame:
    """(path, sheet, row_no, col_no, value) of files (path, content binary). A file that is no workbook, and a null one, has no cells."""
    names = ["path", "sheet", "row_no", "col_no", "value"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, raw in zip(batch["path"], batch["content"]):
                held = bytes(raw or b"")
                read = legacy.sheets if legacy.is_legacy(held) else sheets if zipfile.is_zipfile(io.BytesIO(held)) else None
                if read:
                    yield from _batches(((path, name, *cell) for name, cells, ranges in read(held) for cell in _filled(cells, ranges)), names)

    return files.select("path", "content").mapInPandas(run, "path string, sheet string, row_no int, col_no int, value string")


def workbook_lines(files: DataFrame) -> DataFrame:
    """(path, table, line_no, content): each sheet's rows as CSV, without empty rows and columns.

    table is the file's name, with `::sheet` where a workbook has several. Texts with commas, quotes or line ends are quoted.
    """
    cells = workbook_cells(files).where("trim(value) != ''")
    # Places among the columns in use: rows pad to the widest column of their sheet.
    used = cells.select("path", "sheet", "col_no").distinct().groupBy("path", "sheet").agg(F.array_sort(F.collect_list("col_no")).alias("used"))
    many = cells.select("path", "sheet").distinct().groupBy("path").agg(F.count("*").alias("sheets"))
    quoted = F.when(F.col("value").rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace("value", F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col("value"))
    rows = cells.groupBy("path", "sheet", "row_no").agg(F.map_from_entries(F.collect_list(F.struct("col_no", quoted.alias("v")))).alias("m")).join(used, ["path", "sheet"]).join(many, "path")
    line = F.array_join(F.transform("used", lambda c: F.coalesce(F.try_element_at("m", c), F.lit(""))), ",")
    name = F.element_at(F.split("path", "/"), -1)
    ranked = rows.select("path", F.when(F.col("sheets") > 1, F.concat(name, F.lit("::"), F.col("sheet"))).otherwise(name).alias("table"), "row_no", line.alias("content"))
    return ranked.select("path", "table", F.row_number().over(Window.partitionBy("path", "table").orderBy("row_no")).alias("line_no"), "content")


def read_workbooks(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the workbooks below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{xlsx,xls}").load(folder).select("path", "content")
