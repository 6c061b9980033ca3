"""Older workbooks (.xls, the binary format of 1997 to 2003) read with the standard library.

The file is a compound document of sectors, in which a stream `Workbook` (or `Book`) holds records: global ones
(shared texts, formats, where sheets begin), then those of each sheet. Dates become year-month-day. A file is one task's.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from datetime import datetime, timedelta

#: The mark of a compound document, and ends of sector chains.
MARK = bytes.fromhex("D0CF11E0A1B11AE1")
_LAST = 0xFFFFFFFA
#: Numbers of records.
BOUNDSHEET, SST, CONTINUE, DATEMODE, FORMAT, XF, MERGED, LABELSST, LABEL, NUMBER, RK, MULRK, FORMULA, STRING, BOOLERR, EOF = 0x85, 0xFC, 0x3C, 0x22, 0x41E, 0xE0, 0xE5, 0xFD, 0x204, 0x203, 0x27E, 0xBD, 0x06, 0x207, 0x205, 0x0A
#: Numbers of the built-in date formats.
DATES = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
#: Errors by their code.
ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}


def is_legacy(raw: bytes) -> bool:
    return raw[:8] == MARK


def stream(raw: bytes, *names: str) -> bytes:
    """The bytes of the first of the named streams that a compound document holds; empty if it holds none or is broken."""
    try:
        return _stream(raw, *names)
    except (struct.error, IndexError, KeyError):
        return b""


def _stream(raw: bytes, *names: str) -> bytes:
    size, small = 1 << struct.unpack_from("<H", raw, 30)[0], 1 << struct.unpack_from("<H", raw, 32)[0]
    directory, _, cutoff, small_at, _, more, _ = struct.unpack_from("<7I", raw, 48)
    sector = lambda n: raw[(n + 1) * size : (n + 2) * size]
    numbers = lambda b: struct.unpack(f"<{len(b) // 4}I", b)
    table_at = [n for n in struct.unpack_from("<109I", raw, 76) if n < _LAST]
    while more < _LAST:
        held = numbers(sector(more))
        table_at += [n for n in held[:-1] if n < _LAST]
        more = held[-1]
    table = [n for at in table_at for n in numbers(sector(at))]

    def chain(n: int, links: list[int], part) -> bytes:
        out, seen = [], set()
        while n < _LAST and n < len(links) and n not in seen:
            seen.add(n)
            out.append(part(n))
            n = links[n]
        return b"".join(out)

    entries = chain(directory, table, sector)
    found: dict[str, tuple[int, int]] = {}
    for at in range(0, len(entries) - 127, 128):
        length = struct.unpack_from("<H", entries, at + 64)[0]
        name = entries[at : at + max(0, length - 2)].decode("utf-16-le", "replace")
        found["" if entries[at + 66] == 5 else name] = struct.unpack_from("<II", entries, at + 116)
    for name in names:
        if name in found:
            start, n = found[name]
            if n >= cutoff:
                return chain(start, table, sector)[:n]
            inner = chain(found[""][0], table, sector)
            links = list(numbers(chain(small_at, table, sector)))
            return chain(start, links, lambda i: inner[i * small : (i + 1) * small])[:n]
    return b""


def records(data: bytes, at: int = 0) -> Iterator[tuple[int, list[bytes]]]:
    """(number, parts) of records from a place on; parts after the first are continuations."""
    held: tuple[int, list[bytes]] | None = None
    while at + 4 <= len(data):
        kind, length = struct.unpack_from("<HH", data, at)
        part = data[at + 4 : at + 4 + length]
        at += 4 + length
        if kind == CONTINUE and held:
            held[1].append(part)
            continue
        if held:
            yield held
        held = (kind, [part])
    if held:
        yield held


class Texts:
    """Reads texts that may run from one part of a record into the next."""

    def __init__(self, parts: list[bytes], at: int = 0):
        self.parts, self.part, self.at = parts, 0, at

    def take(self, n: int) -> bytes:
        out = b""
        while n and self.part < len(self.parts):
            now = self.parts[self.part][self.at : self.at + n]
            out, n, self.at = out + now, n - len(now), self.at + len(now)
            if n:
                self.part, self.at = self.part + 1, 0
        return out

    def text(self, width: int = 2) -> str:
        """A text after its length (of `width` bytes) and flags; a continuation within the characters starts with flags of its own."""
        n, flags = int.from_bytes(self.take(width), "little"), self.take(1)[0]
        runs = int.from_bytes(self.take(2), "little") if flags & 8 else 0
        extra = int.from_bytes(self.take(4), "little") if flags & 4 else 0
        out, wide = [], flags & 1
        while n and self.part < len(self.parts):
            if self.at >= len(self.parts[self.part]):
                self.part, self.at = self.part + 1, 0
                if self.part < len(self.parts):
                    wide = self.take(1)[0] & 1
                continue
            count = min(n, (len(self.parts[self.part]) - self.at) // (2 if wide else 1))
            raw = self.take(count * (2 if wide else 1))
            out.append(raw.decode("utf-16-le" if wide else "latin-1", "replace"))
            n -= count
            if not count:
                break
        self.take(4 * runs + extra)
        return "".join(out)


def packed(value: int) -> float:
    """A number of 30 bits: an integer or the upper bits of a double, perhaps of a hundredth."""
    number = float(struct.unpack("<i", struct.pack("<I", value))[0] >> 2) if value & 2 else struct.unpack("<d", struct.pack("<Q", (value & 0xFFFFFFFC) << 32))[0]
    return number / 100 if value & 1 else number


def sheets(raw: bytes) -> Iterator[tuple[str, Iterator[tuple[int, int, str]], list[tuple[int, int, int, int]]]]:
    """(name, cells, merged ranges) of each sheet; cells are (row, column, text) from 1, without empty ones."""
    data = stream(raw, "Workbook", "Book")
    shared: list[str] = []
    formats, styles, places, start = {}, [], [], datetime(1899, 12, 30)
    for kind, parts in records(data):
        body = parts[0]
        if kind == EOF:
            break
        if kind == BOUNDSHEET and body[5] == 0:
            places.append((struct.unpack_from("<I", body)[0], Texts([body], 6).text(1)))
        elif kind == SST:
            reader = Texts(parts, 8)
            shared = [reader.text() for _ in range(struct.unpack_from("<I", body, 4)[0])]
        elif kind == DATEMODE and body[:2] == b"\x01\x00":
            start = datetime(1904, 1, 1)
        elif kind == FORMAT:
            formats[struct.unpack_from("<H", body)[0]] = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", Texts([body], 2).text())
        elif kind == XF:
            styles.append(struct.unpack_from("<H", body, 2)[0])
    dates = {i for i, f in enumerate(styles) if f in DATES or re.search("[ymdhs]", formats.get(f, "").lower())}

    def shown(value: float, style: int) -> str:
        if style in dates:
            return (start + timedelta(days=value)).strftime("%Y-%m-%d")
        return str(int(value)) if value == int(value) and abs(value) < 1e16 else repr(value)

    def cells(at: int) -> Iterator[tuple[int, int, str]]:
        waiting = None
        for kind, parts in records(data, at):
            body = parts[0]
            if kind == EOF:
                return
            if kind == STRING and waiting:
                yield (*waiting, Texts(parts).text())
                waiting = None
            if kind not in (LABELSST, LABEL, NUMBER, RK, MULRK, FORMULA, BOOLERR):
                continue
            row, column, style = struct.unpack_from("<3H", body)
            place = (row + 1, column + 1)
            if kind == LABELSST:
                yield (*place, shared[struct.unpack_from("<I", body, 6)[0]])
            elif kind == LABEL:
                yield (*place, Texts(parts, 6).text())
            elif kind == NUMBER:
                yield (*place, shown(struct.unpack_from("<d", body, 6)[0], style))
            elif kind == RK:
                yield (*place, shown(packed(struct.unpack_from("<I", body, 6)[0]), style))
            elif kind == MULRK:
                for k in range((len(body) - 6) // 6):
                    own, value = struct.unpack_from("<HI", body, 4 + 6 * k)
                    yield row + 1, column + 1 + k, shown(packed(value), own)
            elif kind == BOOLERR:
                yield (*place, ERRORS.get(body[6], "#N/A") if body[7] else "True" if body[6] else "False")
            elif body[12:14] != b"\xff\xff":
                yield (*place, shown(struct.unpack_from("<d", body, 6)[0], style))
            elif body[6] == 0:
                waiting = place
            elif body[6] == 1:
                yield (*place, "True" if body[8] else "False")
            elif body[6] == 2:
                yield (*place, ERRORS.get(body[8], "#N/A"))

    for at, name in places:
        ranges = []
        for kind, parts in records(data, at):
            if kind == EOF:
                break
            if kind == MERGED:
                for k in range(struct.unpack_from("<H", parts[0])[0]):
                    r0, r1, c0, c1 = struct.unpack_from("<4H", parts[0], 2 + 8 * k)
                    ranges.append((r0 + 1, c0 + 1, r1 + 1, c1 + 1))
        yield name, cells(at), ranges
