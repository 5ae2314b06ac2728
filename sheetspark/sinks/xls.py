"""Writing legacy workbooks: BIFF8 records in a compound file."""

from __future__ import annotations

import datetime as dt
import math
import struct
from decimal import Decimal

from ..sources.xls import BOF, BOOLERR, BOUNDSHEET, CONTINUE, DATEMODE, EOF, FORMAT, LABELSST, MERGED, NUMBER, SST, XF
from ..sources.xlsx import Unsupported
from .xlsx import MAX_EXACT, serial

MAX_ROWS, MAX_COLUMNS, MAX_TEXT = 65536, 256, 32767
_LIMIT = 8224  # bytes of a record's body


def _record(kind: int, body: bytes = b"") -> bytes:
    return struct.pack("<HH", kind, len(body)) + body


def _string(text: str, wide_count: bool = True) -> bytes:
    """A string with its length and how it is stored: a byte a character where that will do."""
    narrow = all(ord(c) < 256 for c in text)
    raw = text.encode("latin-1" if narrow else "utf-16-le", "surrogatepass")
    return struct.pack("<H" if wide_count else "<B", len(raw) // (1 if narrow else 2)) + bytes([0 if narrow else 1]) + raw


class Sheet:
    """A worksheet of a legacy workbook."""

    def __init__(self, book: "Book", name: str):
        self.book, self.name, self.rows, self.merges, self.widths = book, name, [], [], {}

    @property
    def next_row(self) -> int:
        return self.rows[-1][0] + 1 if self.rows else 0

    def write_row(self, values: list, formats: list[str | None] | None = None, row: int | None = None) -> int:
        """A row of values, with number formats by column."""
        at = self.next_row if row is None else row
        if at >= MAX_ROWS or len(values) > MAX_COLUMNS:
            raise ValueError("beyond the limits of a legacy sheet")
        self.rows.append((at, list(values), list(formats or [None] * len(values))))
        return at

    def merge(self, first_row: int, last_row: int, first_col: int, last_col: int) -> None:
        self.merges.append((first_row, last_row, first_col, last_col))

    def body(self) -> bytes:
        out = [_record(BOF, struct.pack("<HHHHII", 0x600, 0x10, 0xDBB, 0x7CC, 0, 0x600))]
        last = max((len(v) for _, v, _ in self.rows), default=0)
        out.append(_record(0x200, struct.pack("<IIHHH", 0, self.next_row, 0, last, 0)))
        out += [_record(0x7D, struct.pack("<HHHHHH", c, c, int(w * 256), 15, 0, 0)) for c, w in sorted(self.widths.items())]
        for at, values, formats in self.rows:
            for col, (value, code) in enumerate(zip(values, formats)):
                if isinstance(value, (dt.date, dt.datetime)):
                    code = code or ("yyyy-mm-dd hh:mm:ss" if isinstance(value, dt.datetime) else "yyyy-mm-dd")
                    value = serial(value, self.book.use_1904)
                head = struct.pack("<HHH", at, col, self.book.style(code))
                if isinstance(value, int) and not isinstance(value, bool) and abs(value) > MAX_EXACT:
                    value = str(value)
                if value is None:
                    continue
                if isinstance(value, bool):
                    out.append(_record(BOOLERR, head + bytes([value, 0])))
                elif isinstance(value, (int, float, Decimal)) and math.isfinite(value):
                    out.append(_record(NUMBER, head + struct.pack("<d", float(value))))
                elif isinstance(value, float):
                    out.append(_record(BOOLERR, head + bytes([0x24, 1])))
                else:
                    out.append(_record(LABELSST, head + struct.pack("<I", self.book.shared(str(value)))))
        out.append(_record(0x23E, struct.pack("<HHHHHHI", 0x6B6, 0, 0, 64, 0, 0, 0)[:18]))
        for i in range(0, len(self.merges), 1000):
            some = self.merges[i : i + 1000]
            out.append(_record(MERGED, struct.pack("<H", len(some)) + b"".join(struct.pack("<HHHH", *m) for m in some)))
        return b"".join([*out, _record(EOF)])


class Book:
    """A legacy workbook under construction; a password is refused."""

    def __init__(self, use_1904: bool = False, password: str | None = None):
        if password:
            raise Unsupported("encrypted workbooks")
        self.use_1904, self.sheets = use_1904, []
        self.strings: dict[str, int] = {}
        self.uses = 0
        self.codes: dict[str, int] = {}

    def sheet(self, name: str) -> Sheet:
        for s in self.sheets:
            if s.name == name:
                return s
        self.sheets.append(Sheet(self, name))
        return self.sheets[-1]

    def shared(self, text: str) -> int:
        if len(text.encode("utf-16-le", "surrogatepass")) > 2 * MAX_TEXT:
            raise ValueError("a text beyond the limits of a legacy sheet")
        self.uses += 1
        return self.strings.setdefault(text, len(self.strings))

    def style(self, code: str | None) -> int:
        """The cell style of a number format: 15 is the default one."""
        return 15 if not code or code == "General" else 16 + self.codes.setdefault(code, len(self.codes))

    def _sst(self) -> bytes:
        """The shared strings, cut at the records' limit: between strings, or inside one with its storage said again."""
        bodies, now = [], bytearray(struct.pack("<II", self.uses, len(self.strings)))
        for text in self.strings:
            raw = _string(text)
            if len(now) + min(len(raw), 64) > _LIMIT:
                bodies.append(bytes(now))
                now = bytearray()
            step = 2 if raw[2] else 1
            room = _LIMIT - len(now)
            if len(raw) > room:
                room -= (room - 3) % step
            now += raw[:room]
            rest = raw[room:]
            while rest:
                bodies.append(bytes(now))
                take = _LIMIT - 1 - (_LIMIT - 1) % step
                now = bytearray(raw[2:3] + rest[:take])
                rest = rest[take:]
        bodies.append(bytes(now))
        return b"".join(_record(SST if i == 0 else CONTINUE, b) for i, b in enumerate(bodies))

    def stream(self) -> bytes:
        sheets = self.sheets or [self.sheet("Sheet1")]
        parts = [s.body() for s in sheets]
        font = struct.pack("<HHHHHBBBB", 220, 0, 0x7FFF, 400, 0, 0, 0, 0, 0) + _string("Calibri", False)
        head = [_record(BOF, struct.pack("<HHHHII", 0x600, 5, 0xDBB, 0x7CC, 0, 0x600)), _record(0x42, struct.pack("<H", 1200)), _record(DATEMODE, struct.pack("<H", self.use_1904)), _record(0x3D, struct.pack("<HHHHHHHHH", 0, 0, 0x4000, 0x2000, 0x38, 0, 0, 1, 600))]
        head += [_record(0x31, font)] * 4
        head += [_record(FORMAT, struct.pack("<H", 164 + i) + _string(code)) for code, i in self.codes.items()]
        # fifteen styles of the cell styles' own, the default one, and one for each format
        for i in range(16 + len(self.codes)):
            number = 164 + i - 16 if i > 15 else 0
            head.append(_record(XF, struct.pack("<HHHBBBBIIH", 0, number, 0xFFF5 if i < 15 else 1, 0x20, 0, 0, 0, 0, 0, 0x20C0)))
        head.append(_record(0x293, struct.pack("<HBB", 0x8000, 0, 0xFF)))
        tail = self._sst() + _record(EOF)
        size = sum(map(len, head)) + sum(len(_record(BOUNDSHEET, b"\0" * 6 + _string(s.name, False))) for s in sheets) + len(tail)
        bounds = []
        for s, part in zip(sheets, parts):
            bounds.append(_record(BOUNDSHEET, struct.pack("<IBB", size, 0, 0) + _string(s.name, False)))
            size += len(part)
        return b"".join([*head, *bounds, tail, *parts])

    def finish(self) -> bytes:
        return compound(self.stream())


def compound(stream: bytes, name: str = "Workbook") -> bytes:
    """A compound file with one stream."""
    stream = stream.ljust(4096, b"\0")
    n = -(-len(stream) // 512)
    fat_sectors, difat_sectors = 1, 0
    while True:
        need = -(-(n + 1 + fat_sectors + difat_sectors) // 128)
        more = max(0, -(-(need - 109) // 127))
        if (need, more) == (fat_sectors, difat_sectors):
            break
        fat_sectors, difat_sectors = need, more
    first_fat, first_difat = n + 1, n + 1 + fat_sectors
    fat = [*range(1, n), 0xFFFFFFFE, 0xFFFFFFFE, *[0xFFFFFFFD] * fat_sectors, *[0xFFFFFFFC] * difat_sectors]
    fat += [0xFFFFFFFF] * (fat_sectors * 128 - len(fat))
    places = list(range(first_fat, first_fat + fat_sectors))
    in_head, rest = places[:109], places[109:]
    difat = b""
    for k in range(difat_sectors):
        some = rest[k * 127 : (k + 1) * 127]
        some += [0xFFFFFFFF] * (127 - len(some)) + [first_difat + k + 1 if k + 1 < difat_sectors else 0xFFFFFFFE]
        difat += struct.pack("<128I", *some)

    def entry(title: str, kind: int, child: int, start: int, size: int) -> bytes:
        raw = title.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw) if title else 0, kind, 1, 0xFFFFFFFF, 0xFFFFFFFF, child) + b"\0" * 36 + struct.pack("<IQ", start, size)

    directory = entry("Root Entry", 5, 1, 0xFFFFFFFE, 0) + entry(name, 2, 0xFFFFFFFF, 0, len(stream)) + entry("", 0, 0xFFFFFFFF, 0, 0) * 2
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6
    head += struct.pack("<IIIIIIIII", 0, fat_sectors, n, 0, 4096, 0xFFFFFFFE, 0, first_difat if difat_sectors else 0xFFFFFFFE, difat_sectors)
    head += struct.pack("<109I", *in_head, *[0xFFFFFFFF] * (109 - len(in_head)))
    return head + stream.ljust(n * 512, b"\0") + directory + struct.pack(f"<{len(fat)}I", *fat) + difat


def append(source: bytes, rows, sheet: int | str = 0) -> bytes:
    """A legacy workbook's values, number formats and merges, with rows behind those of a sheet."""
    from ..sources.xls import Book as Reader

    old = Reader(source)
    new = Book(old.date1904)
    for n, name in enumerate(old.names):
        target = new.sheet(name)
        for row, cells in old.rows(n):
            values: list = [None] * (cells[-1].col + 1)
            codes: list = [None] * len(values)
            for c in cells:
                values[c.col] = c.raw == "1" if c.kind == "B" else float(c.raw) if c.kind == "N" else c.raw
                codes[c.col] = old.formats[c.style] if c.style < len(old.formats) else None
            target.write_row(values, codes, row)
        target.merges += old.merges(n)
        if sheet in (n, name):
            for r in rows:
                target.write_row(list(r))
    return new.finish()
