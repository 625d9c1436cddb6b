"""Cells of old .xls workbooks: the compound file's Workbook stream and its BIFF8 records; and which numbers are dates.

Fixed values of both formats (record numbers, offsets, date formats) stand where
they are used, as the published specifications of the two have them.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from datetime import datetime, timedelta

MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
END, FREE = 0xFFFFFFFE, 0xFFFFFFFF
#: Built-in number formats that show dates or times.
DATE_FORMATS = {*range(14, 23), *range(27, 37), 45, 46, 47, *range(50, 59)}
ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}


def shows_date(code: str) -> bool:
    """Whether a number format's code shows a date or time: a letter of one outside quotes, brackets and escapes."""
    return bool(re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|[\\_*].', "", code.partition(";")[0]), re.I)) and code.lower() != "general"


def as_date(number: float, from_1904: bool) -> datetime:
    """A day number as a time, to the millisecond. The years from 1900 count a 29th of February that wasn't."""
    first = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30) if number >= 60 else datetime(1899, 12, 31)
    return first + timedelta(milliseconds=round(number * 86_400_000))


def workbook_stream(raw: bytes) -> bytes:
    """The stream Workbook (or Book) of a compound file."""
    if raw[:8] != MAGIC:
        raise ValueError("not a compound file")
    sector, small = 1 << struct.unpack_from("<H", raw, 30)[0], 1 << struct.unpack_from("<H", raw, 32)[0]
    first_dir, _, cutoff, first_small, _, more, _ = struct.unpack_from("<7I", raw, 48)
    at = lambda n: raw[(n + 1) * sector : (n + 2) * sector]
    tables = list(struct.unpack_from("<109I", raw, 76))
    seen = 0
    while more not in (END, FREE) and seen < len(raw) // sector:  # tables of a file above 7 MB
        numbers = struct.unpack(f"<{sector // 4}I", at(more))
        tables += numbers[:-1]
        more, seen = numbers[-1], seen + 1
    following = [n for t in tables if t != FREE for n in struct.unpack(f"<{sector // 4}I", at(t).ljust(sector, b"\xff"))]

    def chain(start: int, follow: list[int]) -> Iterator[int]:
        steps = 0
        while start < len(follow) and steps <= len(follow):
            yield start
            start, steps = follow[start], steps + 1

    read = lambda start: b"".join(map(at, chain(start, following)))
    entries, found, root = read(first_dir), None, None
    for i in range(0, len(entries) - 127, 128):
        size = struct.unpack_from("<H", entries, i + 64)[0]
        name = entries[i : i + max(size - 2, 0)].decode("utf-16-le", "replace")
        start, length = struct.unpack_from("<IQ", entries, i + 116)
        if entries[i + 66] == 5:
            root = start
        if name in ("Workbook", "Book") and (found is None or name == "Workbook"):
            found = start, length & 0xFFFFFFFF
    if found is None:
        raise ValueError("the file holds no workbook")
    start, length = found
    if length >= cutoff:
        return read(start)[:length]
    held, table = read(root), read(first_small)
    follow = list(struct.unpack(f"<{len(table) // 4}I", table))
    return b"".join(held[n * small : (n + 1) * small] for n in chain(start, follow))[:length]


def records(stream: bytes, at: int = 0) -> Iterator[tuple[int, list[bytes]]]:
    """(kind, parts) of each record; parts beyond the first are what CONTINUE records add."""
    held: tuple[int, list[bytes]] | None = None
    while at + 4 <= len(stream):
        kind, size = struct.unpack_from("<HH", stream, at)
        body, at = stream[at + 4 : at + 4 + size], at + 4 + size
        if kind == 0x3C and held:
            held[1].append(body)
            continue
        if held:
            yield held
        held = kind, [body]
    if held:
        yield held


class _Parts:
    """Reads on through a record's parts."""

    def __init__(self, parts: list[bytes], at: int = 0):
        self.parts, self.part, self.at = parts, 0, at

    def take(self, n: int) -> bytes:
        out = b""
        while n and self.part < len(self.parts):
            some = self.parts[self.part][self.at : self.at + n]
            out, n, self.at = out + some, n - len(some), self.at + len(some)
            if n:
                self.part, self.at = self.part + 1, 0
        return out

    def text(self, wide_size: bool = True) -> str:
        """A string with its size, flags and what follows them; a part that it goes on in begins with flags of its own."""
        left = struct.unpack("<H", self.take(2))[0] if wide_size else self.take(1)[0]
        flags = self.take(1)[0]
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out = []
        while left:
            width = 2 if flags & 1 else 1
            some = self.parts[self.part][self.at : self.at + left * width]
            out.append(some.decode("utf-16-le" if width == 2 else "latin-1", "replace"))
            left, self.at = left - len(some) // width, self.at + len(some)
            if left:
                self.part, self.at = self.part + 1, 1
                if self.part >= len(self.parts):
                    break
                flags = self.parts[self.part][0]
        self.take(4 * runs + extra)
        return "".join(out)


def _rk(raw: int) -> float:
    value = float(raw >> 2 if raw < 1 << 31 else (raw >> 2) - (1 << 30)) if raw & 2 else struct.unpack("<d", struct.pack("<Q", (raw & 0xFFFFFFFC) << 32))[0]
    return value / 100 if raw & 1 else value


def xls_sheets(raw: bytes) -> list[tuple[str, list[dict[int, object]]]]:
    """(name, rows) of each sheet; a row is its cells by column, as text, number, truth or time."""
    stream, sheets, shared, formats, kinds, from_1904 = workbook_stream(raw), [], [], {}, [], False
    for kind, parts in records(stream):
        body = parts[0]
        if kind == 0x809 and body[:2] != b"\x00\x06":
            raise ValueError("a workbook older than BIFF8")
        if kind == 0x2F:
            raise ValueError("the workbook is encrypted")
        if kind == 0x22:
            from_1904 = body[:1] == b"\x01"
        elif kind == 0x85 and body[5] == 0:
            sheets.append((_Parts([body], 6).text(False), struct.unpack_from("<I", body)[0]))
        elif kind == 0xFC:
            reader = _Parts(parts, 8)
            shared = [reader.text() for _ in range(struct.unpack_from("<I", body, 4)[0])]
        elif kind == 0x41E:
            formats[struct.unpack_from("<H", body)[0]] = shows_date(_Parts(parts, 2).text())
        elif kind == 0xE0:
            kinds.append(struct.unpack_from("<H", body, 2)[0])
        elif kind == 0x0A:
            break
    dated = [formats.get(k, k in DATE_FORMATS) for k in kinds]

    def number(value: float, style: int) -> object:
        if style < len(dated) and dated[style]:
            return as_date(value, from_1904)
        return int(value) if value.is_integer() else value

    out = []
    for name, at in sheets:
        cells: dict[int, dict[int, object]] = {}
        waits = None
        for kind, parts in records(stream, at):
            body = parts[0]
            if kind == 0x0A:
                break
            if kind == 0x207 and waits:
                cells.setdefault(waits[0], {})[waits[1]] = _Parts(parts).text()
            if kind not in (0xFD, 0x203, 0x27E, 0xBD, 0x06, 0x205, 0x204):
                continue
            row, column, style = struct.unpack_from("<3H", body)
            here = cells.setdefault(row, {})
            if kind == 0xFD:
                here[column] = shared[struct.unpack_from("<I", body, 6)[0]]
            elif kind == 0x203:
                here[column] = number(struct.unpack_from("<d", body, 6)[0], style)
            elif kind == 0x27E:
                here[column] = number(_rk(struct.unpack_from("<I", body, 6)[0]), style)
            elif kind == 0xBD:
                for i in range((len(body) - 6) // 6):
                    style, value = struct.unpack_from("<HI", body, 4 + 6 * i)
                    here[column + i] = number(_rk(value), style)
            elif kind == 0x204:
                here[column] = _Parts(parts, 6).text()
            elif kind == 0x205:
                here[column] = ERRORS.get(body[6], "#N/A") if body[7] else body[6] == 1
            elif body[12:14] != b"\xff\xff":
                here[column] = number(struct.unpack_from("<d", body, 6)[0], style)
            elif body[6] == 0:
                waits = row, column  # its text is the next STRING record
            elif body[6] in (1, 2):
                here[column] = body[8] == 1 if body[6] == 1 else ERRORS.get(body[8], "#N/A")
        height = max((r for r, c in cells.items() if c), default=-1) + 1
        out.append((name, [cells.get(r, {}) for r in range(height)]))
    return out
