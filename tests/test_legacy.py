"""Older workbooks, written here record by record."""

import struct

from trailgrid.sources import legacy, workbooks


def record(kind, body):
    return struct.pack("<HH", kind, len(body)) + body


def text(s, width=2, wide=None):
    wide = any(ord(c) > 255 for c in s) if wide is None else wide
    return len(s).to_bytes(width, "little") + bytes([int(wide)]) + s.encode("utf-16-le" if wide else "latin-1")


def book(sheets, shared, formats=(), styles=(0,), late=False, cut=None):
    """The stream of a workbook; `cut`: where the shared texts are continued."""
    body = b"".join(text(s) for s in shared)
    sst = struct.pack("<II", len(shared), len(shared)) + body
    parts = record(legacy.SST, sst) if cut is None else record(legacy.SST, sst[:cut]) + record(legacy.CONTINUE, b"\x01" + sst[cut:])
    head = record(0x809, struct.pack("<HH", 0x600, 5) + bytes(12)) + record(legacy.DATEMODE, struct.pack("<H", late))
    head += b"".join(record(legacy.FORMAT, struct.pack("<H", n) + text(code)) for n, code in formats) + b"".join(record(legacy.XF, struct.pack("<HH", 0, f) + bytes(16)) for f in styles)
    bounds = lambda at: b"".join(record(legacy.BOUNDSHEET, struct.pack("<IBB", a, 0, 0) + text(name, 1)) for a, (name, _) in zip(at, sheets))
    first = len(head) + len(bounds([0] * len(sheets))) + len(parts) + 4
    places, n = [], first
    for _, rows in sheets:
        places.append(n)
        n += len(rows) + 20 + 4
    out = head + bounds(places) + parts + record(legacy.EOF, b"")
    for _, rows in sheets:
        out += record(0x809, struct.pack("<HH", 0x600, 0x10) + bytes(12)) + rows + record(legacy.EOF, b"")
    return out


def compound(data, cutoff=4096):
    """A compound document with one stream, in sectors or, if it is short, in small sectors."""
    size, short = 512, len(data) < cutoff
    pad = lambda b, n: b + bytes(-len(b) % n)
    stored = pad(data, 64) if short else data
    sectors = [pad(stored, size)[i : i + size] for i in range(0, len(pad(stored, size)), size)]
    links = [i + 1 for i in range(len(sectors) - 1)] + [0xFFFFFFFE]
    small = b""
    if short:
        n = len(stored) // 64
        small = pad(struct.pack(f"<{n}I", *range(1, n), 0xFFFFFFFE), size)
    entry = lambda name, kind, start, n: pad((name + "\0").encode("utf-16-le"), 64)[:64] + struct.pack("<HBB3I", 2 * len(name) + 2, kind, 1, *[0xFFFFFFFF] * 3) + bytes(36) + struct.pack("<III", start, n, 0)
    directory = len(sectors)
    entries = (entry("Root Entry", 5, 0, len(stored)) if short else entry("Root Entry", 5, 0xFFFFFFFE, 0)) + entry("Workbook", 2, 0, len(data)) + bytes(256)
    sectors.append(entries)
    links.append(0xFFFFFFFE)
    small_at = 0xFFFFFFFE
    if short:
        small_at = len(sectors)
        for i in range(0, len(small), size):
            sectors.append(small[i : i + size])
            links.append(len(sectors) if i + size < len(small) else 0xFFFFFFFE)
    tables = -(-(len(links) + 8) // 128)
    at = len(sectors)
    links += [0xFFFFFFFD] * tables
    table = struct.pack(f"<{tables * 128}I", *links, *[0xFFFFFFFF] * (tables * 128 - len(links)))
    head = legacy.MARK + bytes(16) + struct.pack("<5H", 0x3E, 3, 0xFFFE, 9, 6) + bytes(10) + struct.pack("<I", tables) + struct.pack("<7I", directory, 0, cutoff, small_at, len(small) // size, 0xFFFFFFFE, 0)
    head += struct.pack("<109I", *range(at, at + tables), *[0xFFFFFFFF] * (109 - tables))
    return head + b"".join(sectors) + table


def cell(kind, row, column, style, body):
    return record(kind, struct.pack("<3H", row, column, style) + body)


ROWS = (
    cell(legacy.LABELSST, 0, 0, 0, struct.pack("<I", 1)) + cell(legacy.LABELSST, 0, 1, 0, struct.pack("<I", 0)) + cell(legacy.NUMBER, 1, 0, 0, struct.pack("<d", 2.5)) + cell(legacy.NUMBER, 1, 1, 1, struct.pack("<d", 45000.25))
    + cell(legacy.RK, 2, 0, 0, struct.pack("<I", (7 << 2) | 2)) + cell(legacy.RK, 2, 1, 0, struct.pack("<I", (-150 << 2 & 0xFFFFFFFF) | 3)) + record(legacy.MULRK, struct.pack("<2H", 3, 0) + struct.pack("<HI", 0, (1 << 2) | 2) + struct.pack("<HI", 2, (366 << 2) | 2) + struct.pack("<H", 1))
    + cell(legacy.FORMULA, 4, 0, 0, struct.pack("<d", 1e20) + bytes(8)) + cell(legacy.FORMULA, 4, 1, 0, b"\x00" * 6 + b"\xff\xff" + bytes(8)) + record(legacy.STRING, text("made 价")) + cell(legacy.BOOLERR, 5, 0, 0, b"\x01\x00") + cell(legacy.BOOLERR, 5, 1, 0, b"\x07\x01")
    + cell(legacy.LABEL, 6, 0, 0, text("old")) + record(legacy.MERGED, struct.pack("<H4H", 1, 6, 7, 0, 1))
)
WANT = [(1, 1, "价格 é"), (1, 2, "plain"), (2, 1, "2.5"), (2, 2, "2023-03-15"), (3, 1, "7"), (3, 2, "-1.5"), (4, 1, "1"), (4, 2, "1900-12-31"), (5, 1, "1e+20"), (5, 2, "made 价"), (6, 1, "True"), (6, 2, "#DIV/0!"), (7, 1, "old")]


def made(**k):
    return book([("first", ROWS), ("zweite é", cell(legacy.NUMBER, 0, 0, 0, struct.pack("<d", 3.0)))], ["plain", "价格 é", "x" * 9000], [(200, 'yy"x"-mm')], (0, 14, 200), **k)


def test_records_become_cells():
    for data in (made(), made(cut=8 + 3 + 5 + 3 + 4)):
        for raw in (compound(data), compound(data, cutoff=1)):
            got = [(name, list(cells), ranges) for name, cells, ranges in legacy.sheets(raw)]
            assert got == [("first", WANT, [(7, 1, 8, 2)]), ("zweite é", [(1, 1, "3")], [])]
    short = book([("s", ROWS)], ["plain", "价格 é"], [(200, "yy")], (0, 14, 200), late=True)
    assert len(short) < 4096
    [(name, cells, _)] = legacy.sheets(compound(short))
    assert (2, 2, "2027-03-16") in list(cells)


def test_as_cells_of_files_with_merged_ranges(spark):
    files = spark.createDataFrame([("d/a.xls", bytearray(compound(made()))), ("d/b.xls", bytearray(legacy.MARK + bytes(600))), ("d/c.xls", bytearray(b"text")), ("d/d.xls", None)], "path string, content binary")
    rows = workbooks.workbook_cells(files).collect()
    assert {r.path for r in rows} == {"d/a.xls"}
    assert sorted((r.row_no, r.col_no, r.value) for r in rows if r.sheet == "first" and r.row_no > 6) == [(7, 1, "old"), (7, 2, "old"), (8, 1, "old"), (8, 2, "old")]
    assert [r.content for r in workbooks.workbook_lines(files).where("table = 'a.xls::first'").orderBy("line_no").collect()][:2] == ["价格 é,plain", "2.5,2023-03-15"]
