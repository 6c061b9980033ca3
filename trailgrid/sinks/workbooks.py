"""Workbooks (.xlsx) written with the standard library, one file of several sheets."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from itertools import groupby
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
#: The most rows of a sheet, and characters that XML cannot hold.
MOST_ROWS = 1_048_576
_BARRED = dict.fromkeys([*range(9), 11, 12, *range(14, 32)])


def workbook(tables: Iterator[tuple[str, Iterator[list[str | None]]]]) -> bytes:
    """The bytes of a workbook with a sheet for each (name, rows); a sheet is streamed into the file."""
    out, names = io.BytesIO(), []
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, rows in tables:
            names.append(name)
            with book.open(f"xl/worksheets/sheet{len(names)}.xml", "w", force_zip64=True) as f:
                f.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
                for k, row in enumerate(rows):
                    if k == MOST_ROWS:
                        raise ValueError(f"sheet {name} has more than {MOST_ROWS} rows")
                    cells = "".join("<c/>" if v is None else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v).translate(_BARRED))}</t></is></c>' for v in row)
                    f.write(f"<row>{cells}</row>".encode())
                f.write(b"</sheetData></worksheet>")
        ids = range(1, len(names) + 1)
        listed = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="r{i}"/>' for i, n in zip(ids, names))
        book.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in ids)
        book.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">{links}</Relationships>')
        book.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in ids)
        types = f'<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}'
        book.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types">{types}</Types>')
    return out.getvalue()


def workbooks(rows: DataFrame) -> DataFrame:
    """(path, content binary) of rows (path, sheet, row_no, cells array<string>): one workbook a path, its sheets by name.

    A workbook is one file and made by one task, from sorted rows that stream through it; only its compressed bytes
    are held. A sheet of more rows than the format allows is an error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flat = (row for batch in batches for row in zip(batch["path"], batch["sheet"], batch["cells"]))
        for path, of_book in groupby(flat, key=lambda r: r[0]):
            made = workbook((name, (list(r[2]) for r in of_sheet)) for name, of_sheet in groupby(of_book, key=lambda r: r[1]))
            yield pd.DataFrame({"path": [path], "content": [made]})

    dealt = rows.select("path", "sheet", "row_no", "cells").where("path is not null and sheet is not null and cells is not null").repartition("path").sortWithinPartitions("path", "sheet", "row_no")
    return dealt.mapInPandas(run, "path string, content binary")
