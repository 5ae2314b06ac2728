"""Legacy workbooks: compound files and their BIFF8 records."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from .xlsx import BUILT_IN, Cell, FormatError, Unsupported

_END, _FREE = 0xFFFFFFFE, 0xFFFFFFFF
#: Numbers of BIFF8 records and codes of cell errors.
EOF, CONTINUE, FILEPASS, DATEMODE, FORMAT, XF, BOUNDSHEET, SST, BOF = 0x0A, 0x3C, 0x2F, 0x22, 0x41E, 0xE0, 0x85, 0xFC, 0x809
LABELSST, LABEL, NUMBER, RK, MULRK, BOOLERR, FORMULA, STRING, MERGED = 0xFD, 0x204, 0x203, 0x27E, 0xBD, 0x205, 0x06, 0x207, 0xE5
ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}


def compound_streams(data: bytes) -> dict[str, bytes]:
    """The streams of a compound file by name."""
    if data[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" or len(data) < 512:
        raise FormatError("not a compound file")
    shift, mini_shift = struct.unpack_from("<HH", data, 30)
    first_dir, = struct.unpack_from("<I", data, 48)
    cutoff, first_mini, _, first_difat, n_difat = struct.unpack_from("<IIIII", data, 56)
    size = 1 << shift
    sector = lambda i: data[(i + 1) << shift : (i + 2) << shift]
    difat = list(struct.unpack_from("<109I", data, 76))
    for _ in range(n_difat):
        if first_difat >= _END:
            break
        entries = struct.unpack(f"<{size // 4}I", sector(first_difat))
        difat += entries[:-1]
        first_difat = entries[-1]
    fat: list[int] = []
    for i in difat:
        if i < _END:
            part = sector(i)
            fat += struct.unpack(f"<{len(part) // 4}I", part)

    def chain(i: int, table: list[int]) -> Iterator[int]:
        seen = 0
        while i < _END:
            if i >= len(table) or seen > len(table):
                raise FormatError("a broken chain of sectors")
            yield i
            i, seen = table[i], seen + 1

    read = lambda i: b"".join(map(sector, chain(i, fat)))
    directory = read(first_dir)
    mini_raw = read(first_mini) if first_mini < _END else b""
    mini_fat = list(struct.unpack(f"<{len(mini_raw) // 4}I", mini_raw))
    out, mini = {}, b""
    for at in range(0, len(directory) - 127, 128):
        length, kind = struct.unpack_from("<HB", directory, at + 64)
        start, stream_size = struct.unpack_from("<II", directory, at + 116)
        name = directory[at : at + max(0, length - 2)].decode("utf-16-le", "replace")
        if kind == 5:
            mini = read(start) if start < _END else b""
        elif kind == 2:
            if stream_size < cutoff:
                raw = b"".join(mini[i << mini_shift : (i + 1) << mini_shift] for i in chain(start, mini_fat))
            else:
                raw = read(start)
            out[name] = raw[:stream_size]
    return out


def records(stream: bytes, at: int = 0) -> Iterator[tuple[int, int, list[bytes]]]:
    """(place, record, its body and those of the CONTINUE records behind it)."""
    while at + 4 <= len(stream):
        kind, size = struct.unpack_from("<HH", stream, at)
        begin, bodies = at, [stream[at + 4 : at + 4 + size]]
        at += 4 + size
        while at + 4 <= len(stream) and struct.unpack_from("<H", stream, at)[0] == CONTINUE:
            size, = struct.unpack_from("<H", stream, at + 2)
            bodies.append(stream[at + 4 : at + 4 + size])
            at += 4 + size
        yield begin, kind, bodies


class _Strings:
    """Reads strings that may go on in CONTINUE records, each of which says again how its characters are stored."""

    def __init__(self, bodies: list[bytes]):
        self.bodies, self.part, self.at = bodies, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while n:
            body = self.bodies[self.part]
            got = body[self.at : self.at + n]
            out += got
            self.at += len(got)
            n -= len(got)
            if n:
                self.part, self.at = self.part + 1, 0
                if self.part >= len(self.bodies):
                    raise FormatError("a string ends early")
        return out

    def string(self) -> str:
        count, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        wide, out = flags & 1, []
        while count:
            if self.at >= len(self.bodies[self.part]):
                self.part, self.at = self.part + 1, 0
                if self.part >= len(self.bodies):
                    raise FormatError("a string ends early")
                wide = self.take(1)[0] & 1
            room = (len(self.bodies[self.part]) - self.at) // (2 if wide else 1)
            n = min(count, room)
            out.append(self.take(n * 2).decode("utf-16-le", "surrogatepass") if wide else self.take(n).decode("latin-1"))
            count -= n
            if not room and count:
                raise FormatError("a broken string")
        self.take(4 * runs + extra)
        return "".join(out)


def rk(value: int) -> float:
    """A packed number: an integer or the upper bits of a double, perhaps by a hundred."""
    number = (value >> 2 if value < 1 << 31 else (value >> 2) - (1 << 30)) if value & 2 else struct.unpack("<d", struct.pack("<Q", (value & 0xFFFFFFFC) << 32))[0]
    return number / 100 if value & 1 else number


def _text(number: float) -> str:
    return str(int(number)) if number == int(number) and abs(number) < 1e15 else repr(float(f"{number:.15g}"))


def _short(body: bytes, at: int, wide_count: bool) -> str:
    count = struct.unpack_from("<H", body, at)[0] if wide_count else body[at]
    at += 2 if wide_count else 1
    wide = body[at] & 1
    return body[at + 1 : at + 1 + count * (2 if wide else 1)].decode("utf-16-le" if wide else "latin-1", "replace")


class Book:
    """A BIFF8 workbook: names, number formats, and each sheet's rows."""

    def __init__(self, data: bytes):
        streams = compound_streams(data)
        self.stream = streams.get("Workbook") or streams.get("Book")
        if self.stream is None:
            if "EncryptedPackage" in streams:
                raise Unsupported("encrypted workbooks")
            raise FormatError("no workbook in the file")
        self.names, self.starts, self.strings, self.formats, self.date1904 = [], [], [], [], False
        custom, ids = dict(BUILT_IN), []
        sheets = []
        for _, kind, bodies in records(self.stream):
            body = bodies[0]
            if kind == EOF:
                break
            if kind == FILEPASS:
                raise Unsupported("encrypted workbooks")
            if kind == BOUNDSHEET and body[5] == 0:
                sheets.append((struct.unpack_from("<I", body)[0], _short(body, 6, False)))
            elif kind == SST:
                reader = _Strings([body[8:], *bodies[1:]])
                self.strings = [reader.string() for _ in range(struct.unpack_from("<I", body, 4)[0])]
            elif kind == FORMAT:
                custom[struct.unpack_from("<H", body)[0]] = _short(body, 2, True)
            elif kind == XF:
                ids.append(struct.unpack_from("<H", body, 2)[0])
            elif kind == DATEMODE:
                self.date1904 = body[:1] == b"\1"
        for start, name in sheets:
            self.names.append(name)
            self.starts.append(start)
        self.formats = [custom.get(i, "General") for i in ids] or ["General"]

    def _records(self, sheet: int) -> Iterator[tuple[int, bytes]]:
        depth = 0
        for _, kind, bodies in records(self.stream, self.starts[sheet]):
            depth += kind == BOF
            if kind == EOF:
                depth -= 1
                if not depth:
                    return
            elif depth == 1:
                yield kind, bodies[0]

    def rows(self, sheet: int) -> Iterator[tuple[int, list[Cell]]]:
        """(row, cells) in order; rows of a legacy sheet are at most 65,536."""
        found: dict[int, dict[int, Cell]] = {}
        pending = None

        def put(row: int, col: int, style: int, kind: str, raw: str, formula: str | None = None) -> None:
            found.setdefault(row, {})[col] = Cell(col, kind, raw, style, formula)

        for kind, body in self._records(sheet):
            if kind in (LABELSST, LABEL, NUMBER, RK, BOOLERR, FORMULA):
                row, col, style = struct.unpack_from("<HHH", body)
            if kind == LABELSST:
                i, = struct.unpack_from("<I", body, 6)
                if i >= len(self.strings):
                    raise FormatError(f"no shared string {i}")
                put(row, col, style, "S", self.strings[i])
            elif kind == LABEL:
                put(row, col, style, "S", _short(body, 6, True))
            elif kind == NUMBER:
                put(row, col, style, "N", _text(struct.unpack_from("<d", body, 6)[0]))
            elif kind == RK:
                put(row, col, style, "N", _text(rk(struct.unpack_from("<I", body, 6)[0])))
            elif kind == MULRK:
                row, first = struct.unpack_from("<HH", body)
                for k in range((len(body) - 6) // 6):
                    style, value = struct.unpack_from("<HI", body, 4 + 6 * k)
                    put(row, first + k, style, "N", _text(rk(value)))
            elif kind == BOOLERR:
                put(row, col, style, "E" if body[7] else "B", ERRORS.get(body[6], "#N/A") if body[7] else str(body[6]))
            elif kind == FORMULA:
                value = body[6:14]
                if value[6:8] != b"\xff\xff":
                    put(row, col, style, "N", _text(struct.unpack("<d", value)[0]))
                elif value[0] == 0:
                    pending = row, col, style
                elif value[0] == 1:
                    put(row, col, style, "B", str(value[2]))
                elif value[0] == 2:
                    put(row, col, style, "E", ERRORS.get(value[2], "#N/A"))
                else:
                    put(row, col, style, "S", "")
            elif kind == STRING and pending:
                put(*pending, "S", _short(body, 0, True))
                pending = None
        for row in sorted(found):
            yield row, [found[row][c] for c in sorted(found[row])]

    def merges(self, sheet: int) -> list[tuple[int, int, int, int]]:
        """(first row, last row, first column, last column)."""
        out = []
        for kind, body in self._records(sheet):
            if kind == MERGED:
                out += [struct.unpack_from("<HHHH", body, 2 + 8 * k) for k in range(struct.unpack_from("<H", body)[0])]
        return out
