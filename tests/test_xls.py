"""Old workbooks made here, byte by byte, read as the same sheets in the new format are."""

from __future__ import annotations

import io
import struct
import zipfile
from datetime import datetime

import pytest

from tidemark.sources import loaders, xls


def record(kind: int, body: bytes) -> bytes:
    return struct.pack("<HH", kind, len(body)) + body


def text(s: str, size: str = "<H", wide: bool | None = None) -> bytes:
    wide = any(ord(c) > 255 for c in s) if wide is None else wide
    return struct.pack(size, len(s)) + bytes([wide]) + s.encode("utf-16-le" if wide else "latin-1")


def rk(value: float) -> int:
    if value == int(value) and abs(value) < 1 << 29:
        return (int(value) << 2 | 2) & 0xFFFFFFFF
    return (struct.unpack("<Q", struct.pack("<d", value))[0] >> 32) & 0xFFFFFFFC


def stream(sheets: dict[str, list[bytes]], strings: list[bytes], from_1904: bool = False) -> bytes:
    """A workbook's stream; styles: 0 plain, 1 a built-in date, 2 an own date format, 3 an own number format. strings are parts of the table of strings."""
    head = record(0x809, b"\x00\x06\x05\x00" + bytes(12)) + record(0x22, bytes([from_1904, 0]))
    head += record(0x41E, struct.pack("<H", 164) + text('yyyy\\-mm\\-dd "at" hh:mm')) + record(0x41E, struct.pack("<H", 165) + text('0.00" days"[Red]'))
    head += b"".join(record(0xE0, struct.pack("<HH", 0, f) + bytes(16)) for f in (0, 14, 164, 165))
    table = record(0xFC, strings[0]) + b"".join(record(0x3C, s) for s in strings[1:]) + record(0x0A, b"")
    bodies = [record(0x809, b"\x00\x06\x10\x00" + bytes(12)) + b"".join(cells) + record(0x0A, b"") for cells in sheets.values()]
    named = sum(len(record(0x85, bytes(6) + text(n, "<B"))) for n in sheets)
    at, bounds = len(head) + named + len(table), b""
    for name, body in zip(sheets, bodies):
        bounds += record(0x85, struct.pack("<IBB", at, 0, 0) + text(name, "<B"))
        at += len(body)
    return head + bounds + table + b"".join(bodies)


def compound(data: bytes, cutoff: int = 4096, name: str = "Workbook") -> bytes:
    """A compound file of one stream, in small sectors if it is shorter than cutoff."""
    small = len(data) < cutoff
    padded = data + bytes(-len(data) % 512)
    n, per = len(padded) // 512, 128
    fats = -(-(n + 3) // (per - 1))
    entry = lambda name, kind, start, size: (name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBB", 2 * len(name) + 2, kind, 1) + bytes(48) + struct.pack("<IQ", start, size))
    # sectors: allocation tables, directory, the small sectors' table, the data
    directory, small_table, first = fats, fats + 1, fats + 2
    fat = [0xFFFFFFFD] * fats + [xls.END, xls.END] + [first + i + 1 for i in range(n - 1)] + [xls.END]
    fat += [xls.FREE] * (fats * per - len(fat))
    pieces = -(-len(data) // 64)
    follow = ([i + 1 for i in range(pieces - 1)] + [xls.END] if small else []) + [xls.FREE] * per
    root = entry("Root Entry", 5, first if small else xls.END, len(padded) if small else 0)
    held = entry(name, 2, 0 if small else first, len(data))
    header = xls.MAGIC + bytes(16) + struct.pack("<5H", 62, 3, 0xFFFE, 9, 6) + bytes(10) + struct.pack("<I", fats)
    header += struct.pack("<7I", directory, 0, cutoff, small_table if small else xls.END, int(small), xls.END, 0)
    header += struct.pack("<109I", *range(fats), *[xls.FREE] * (109 - fats))
    table = struct.pack(f"<{per}I", *follow[:per])
    return header + struct.pack(f"<{len(fat)}I", *fat) + (root + held).ljust(512, b"\0") + table + padded


def cell(row, column, style=0):
    return struct.pack("<3H", row, column, style)


ONE = [
    *(record(0xFD, cell(0, i) + struct.pack("<I", i)) for i in range(3)),
    record(0x203, cell(0, 3) + struct.pack("<d", 7.0)),
    record(0xFD, cell(1, 0) + struct.pack("<I", 3)),
    record(0xBD, struct.pack("<HHHIHIH", 1, 1, 0, rk(5), 1, rk(45000), 2)),
    record(0x27E, cell(1, 3, 3) + struct.pack("<I", rk(2.5))),
    record(0x06, cell(2, 0) + b"\x00" + bytes(5) + b"\xff\xff" + bytes(6)), record(0x207, text("made", wide=True)),
    record(0x27E, cell(2, 1) + struct.pack("<I", (-1234 << 2 | 3) & 0xFFFFFFFF)),
    record(0x203, cell(2, 2, 2) + struct.pack("<d", 45000.75)),
    record(0x06, cell(2, 3) + struct.pack("<d", 0.125) + bytes(6)),
]
TWO = [record(0x204, cell(0, 0) + text("x")), record(0x205, cell(1, 0) + b"\x01\x00"), record(0x205, cell(2, 0) + b"\x07\x01"), record(0x201, cell(3, 0))]
#: Four strings; the second goes on in a part of its own in wide letters, the third has formatting runs.
STRINGS = [
    struct.pack("<II", 4, 4) + text("name") + struct.pack("<H", 6) + b"\x00" + b"n u",
    b"\x01" + "m漢é".encode("utf-16-le") + struct.pack("<HBH", 4, 8, 2) + b"when" + bytes(3),
    bytes(5) + text("line\nbreak", wide=True),
]
CELLS = [
    ["name", "n um漢é", "when", 7], ["line\nbreak", 5, datetime(2023, 3, 15), 2.5], ["made", -12.34, datetime(2023, 3, 15, 18), 0.125],
]


def xlsx(sheets: dict[str, list[list]]) -> bytes:
    out = io.BytesIO()
    main = "xmlns='urn:m' xmlns:r='urn:r'"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {main}><sheets>" + "".join(f"<sheet name='{n}' r:id='r{i}'/>" for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<R xmlns='urn:p'>" + "".join(f"<Relationship Id='r{i}' Target='worksheets/{i}.xml'/>" for i in range(len(sheets))) + "</R>")
        z.writestr("xl/styles.xml", f"<styleSheet {main}><numFmts><numFmt numFmtId='164' formatCode='dd/mm/yy hh:mm'/></numFmts><cellXfs><xf numFmtId='0'/><xf numFmtId='14'/><xf numFmtId='164'/></cellXfs></styleSheet>")
        for i, rows in enumerate(sheets.values()):
            lines = []
            for y, row in enumerate(rows, 1):
                cells = ""
                for x, v in enumerate(row):
                    at = f"{'ABCD'[x]}{y}"
                    if isinstance(v, datetime):
                        days = (v - datetime(1899, 12, 30)).total_seconds() / 86400
                        cells += f"<c r='{at}' s='{1 if days == int(days) else 2}'><v>{days}</v></c>"
                    elif isinstance(v, bool):
                        cells += f"<c r='{at}' t='b'><v>{int(v)}</v></c>"
                    elif isinstance(v, str):
                        cells += f"<c r='{at}' t='{'e' if v[0] == '#' else 'inlineStr'}'>" + (f"<v>{v}</v>" if v[0] == "#" else f"<is><t>{v}</t></is>") + "</c>"
                    else:
                        cells += f"<c r='{at}'><v>{v}</v></c>"
                lines.append(f"<row r='{y}'>{cells}</row>")
            z.writestr(f"xl/worksheets/{i}.xml", f"<worksheet {main}><sheetData>{''.join(lines)}</sheetData></worksheet>")
    return out.getvalue()


@pytest.mark.parametrize("cutoff", [4096, 0])
def test_equal_sheets_give_equal_text(cutoff):
    old = compound(stream({"One": ONE, "Zwei é": TWO}, STRINGS), cutoff)
    new = xlsx({"One": CELLS, "Zwei é": [["x"], [True], ["#DIV/0!"]]})
    assert loaders.parse_file("a.xls", old) == [(n.replace(".xlsx", ".xls"), t) for n, t in loaders.parse_file("a.xlsx", new)]
    assert [r for r in xls.xls_sheets(old)[0][1]] == [dict(enumerate(r)) for r in CELLS]
    assert "2023-03-15 18:00:00" in loaders.parse_file("a.xls", old)[0][1]


def test_long_streams_dates_and_damage():
    many = [record(0x203, cell(r, 0) + struct.pack("<d", r / 2)) for r in range(60_000)]
    sheet = xls.xls_sheets(compound(stream({"S": many}, [struct.pack("<II", 0, 0)])))[0][1]
    assert len(sheet) == 60_000 and sheet[59_999] == {0: 29999.5}
    assert xls.as_date(1, True) == datetime(1904, 1, 2) and xls.as_date(1, False) == datetime(1900, 1, 1) and xls.as_date(60.5, False).hour == 12
    dates = {"yyyy-mm-dd": True, "h:mm": True, "General": False, "0.00": False, '0" days"': False, "[Red]0": False, "#,##0_d": False, "[$-409]d": True}
    assert {k: xls.shows_date(k) for k in dates} == dates
    whole = compound(stream({"One": ONE}, STRINGS))
    for bad in (b"", whole[:600], whole.replace(b"W\0o\0r\0k", b"X\0o\0r\0k"), compound(record(0x809, b"\x00\x05" + bytes(6))), compound(stream({"One": [record(0x2F, b"")]}, STRINGS).replace(record(0x22, b"\0\0"), record(0x2F, b"\0\0")))):
        with pytest.raises((ValueError, struct.error)):
            loaders.parse_file("a.xls", bad)


def test_folder_with_old_workbooks(spark, tmp_path):
    (tmp_path / "a.XLS").write_bytes(compound(stream({"One": ONE, "Two": TWO}, STRINGS)))
    (tmp_path / "b.xls").write_bytes(b"not a workbook")
    rows = loaders.parsed_files(spark, str(tmp_path)).collect()
    assert sorted(r.filename for r in rows if r.error is None) == ["a.XLS::One", "a.XLS::Two"] and [r.filename for r in rows if r.error] == ["b.xls"]
