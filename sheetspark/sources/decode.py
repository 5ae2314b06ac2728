"""Files to rows: one stream of (sheet, row, cells) for every format, decoded where the file's bytes are."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from ..functions.formats import display, general, is_date_code
from . import csv, xlsx

_BLANK = "".join(map(chr, range(33)))


@dataclass
class ReadOptions:
    """How files are read. Sheets: None all, else numbers or names. Rows: zero-based, both ends included."""

    sheets: list | None = None
    head_rows: int = 1
    start_row: int | None = None
    end_row: int | None = None
    trim: bool = True
    ignore_empty: bool = True
    charset: str | None = None
    delimiter: str = ","
    use_1904: bool = False
    auto_1904: bool = False
    scientific: bool = False
    locale: str | None = None
    cache: str = "auto"
    password: str | None = None
    aliases: dict[str, str] = field(default_factory=dict)
    per_sheet_head: dict[int, int] = field(default_factory=dict)

    def __post_init__(self):
        if self.start_row is not None and self.end_row is not None and self.start_row > self.end_row:
            raise ValueError("the first row is behind the last")


def format_of(content: bytes) -> str:
    """xlsx, xls or csv by the first bytes."""
    return "xlsx" if content[:4] == b"PK\x03\x04" else "xls" if content[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" else "csv"


def format_of_name(name: str) -> str:
    """By extension, in any case; none means csv, an unknown one is an error."""
    last = name.rsplit("/", 1)[-1]
    if "." not in last:
        return "csv"
    kind = last.rsplit(".", 1)[1].lower()
    if kind not in ("xlsx", "xlsm", "xls", "csv"):
        raise xlsx.FormatError(f"unknown kind of file: {name}")
    return "xlsx" if kind == "xlsm" else kind


def sheet_names(content: bytes) -> list[str]:
    """Names of a file's sheets in their order; a delimited file has one, Sheet1."""
    kind = format_of(content)
    if kind == "xlsx":
        return [n for n, _ in xlsx.Package(content).sheets]
    if kind == "xls":
        from . import xls

        return xls.Book(content).names
    return ["Sheet1"]


#: A decoded cell: kind, text, what it shows, formula.
Decoded = tuple[str, str, str | None, str | None]


def _shown(kind: str, raw: str, code: str, o: ReadOptions, use_1904: bool) -> str | None:
    if kind != "N":
        return ("true" if raw == "1" else "false") if kind == "B" else None
    if code == "General":
        value = float(raw)
        if abs(value) >= 1e11 or 0 < abs(value) <= 1e-10:
            return general(value) if o.scientific else f"{value:.0f}"
        return None
    return display(float(raw), code, use_1904, o.locale)


def raw_rows(content: bytes, o: ReadOptions) -> Iterator[tuple[int, str, int, list[Decoded | None]]]:
    """(sheet number, name, row, cells) of the chosen sheets, nothing left out."""
    kind = format_of(content)
    if kind == "csv":
        for i, values in csv.records(content, o.charset, o.delimiter):
            yield 0, "Sheet1", i, [("S", v, None, None) for v in values]
        return
    if o.password:
        raise xlsx.Unsupported("passwords")
    if kind == "xls":
        from . import xls

        book = xls.Book(content)
        names, read, formats, date1904 = book.names, book.rows, book.formats, book.date1904
    else:
        package = xlsx.Package(content, o.cache)
        names, read, formats, date1904 = [n for n, _ in package.sheets], package.rows, package.formats, package.date1904
    use_1904 = date1904 if o.auto_1904 else o.use_1904
    from ..operators.rows import select_sheets

    for no in select_sheets(names, o.sheets):
        for row, cells in read(no):
            out: list[Decoded | None] = [None] * (cells[-1].col + 1 if cells else 0)
            for c in cells:
                if c.col >= len(out):
                    out += [None] * (c.col + 1 - len(out))
                code = formats[c.style] if c.style < len(formats) else "General"
                if c.kind == "N" and is_date_code(code):
                    out[c.col] = ("T", c.raw, display(float(c.raw), code, use_1904, o.locale), c.formula)
                else:
                    out[c.col] = (c.kind, c.raw, _shown(c.kind, c.raw, code, o, use_1904), c.formula)
            yield no, names[no].strip(), row, out


def rows(content: bytes, o: ReadOptions, labels: list[str | int] | None = None, head_only: bool = False) -> Iterator[tuple[int, str, int, list[Decoded | None]]]:
    """Data rows: trimmed, empty ones left out, within the range, behind the head.

    ``labels`` picks columns by head label or index, for each sheet by its own head, so files may have their
    columns in different orders. ``head_only`` gives the head's rows instead.
    """
    sheet, head_rows, places = None, 0, None
    for no, name, row, cells in raw_rows(content, o):
        if no != sheet:
            sheet, head, places = no, [], None
            head_rows = o.per_sheet_head.get(no, o.head_rows)
        if o.trim:
            cells = [(c[0], c[1].strip(_BLANK), c[2], c[3]) if c and c[0] == "S" else c for c in cells]
        if row < head_rows:
            if head_only:
                yield no, name, row, cells
            head = cells
            continue
        if head_only:
            continue
        if o.start_row is not None and row < o.start_row or o.end_row is not None and row > o.end_row:
            continue
        if o.ignore_empty and all(c is None or c[0] == "S" and not c[1].strip(_BLANK) for c in cells):
            continue
        if labels is not None:
            if places is None:
                by_label = {}
                for i, c in enumerate(head):
                    text = (c[2] or c[1]).strip(_BLANK) if c else ""
                    if text:
                        by_label[o.aliases.get(text, text)] = i
                places = [label if isinstance(label, int) else by_label.get(label, -1) for label in labels]
            cells = [cells[i] if 0 <= i < len(cells) else None for i in places]
        yield no, name, row, cells


CELL = "struct<kind:string,s:string,n:decimal(38,18),d:double,b:boolean,ts:timestamp_ntz,display:string,formula:string>"
SCHEMA = f"file string, sheet_no int, sheet_name string, _row long, cells array<{CELL}>"


def batches(path: str, content: bytes, o: ReadOptions, labels=None, head_only: bool = False, size: int = 20_000):
    """Arrow batches of ``rows``, cells as the universal struct."""
    import itertools

    stream = rows(content, o, labels, head_only)
    while part := list(itertools.islice(stream, size)):
        yield _batch(path, part, o.use_1904)


def _decimals(texts: list[str | None]):
    """Numbers as decimals; those that do not fit are null."""
    import decimal

    import pyarrow as pa
    import pyarrow.compute as pc

    kind = pa.decimal128(38, 18)
    try:
        return pc.cast(pa.array(texts, pa.string()), kind)
    except pa.ArrowInvalid:
        context, unit, out = decimal.Context(prec=60), decimal.Decimal("1E-18"), []
        for t in texts:
            d = None if t is None else decimal.Decimal(t)
            out.append(d.quantize(unit, decimal.ROUND_HALF_UP, context) if d is not None and abs(d) < 10**20 - 1 else None)
        return pa.array(out, kind)


def moments(serials, use_1904: bool):
    """Serial numbers as microseconds since 1970, to the millisecond; below zero and beyond ``dates.LAST_SERIAL`` none (the least integer)."""
    import numpy as np

    from ..functions.dates import LAST_SERIAL

    x = np.asarray(serials, float)
    day = np.floor(x)
    epoch = -24107 if use_1904 else np.where(day < 61, -25568, -25569)  # days from 1970 to 1904-01-01, 1899-12-31, 1899-12-30
    millis = np.floor((x - day) * 86400000 + 0.5)
    good = (x >= 0) & (x < LAST_SERIAL)
    return np.where(good, ((np.where(good, day, 0) + epoch) * 86400000 + np.where(good, millis, 0)) * 1000, np.iinfo(np.int64).min).astype(np.int64)


def _iso(text: str) -> int | None:
    import datetime as dt

    try:
        moment = dt.datetime.fromisoformat(text.removesuffix("Z"))
    except ValueError:
        return None
    return int((moment.replace(tzinfo=None) - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)


def _batch(path: str, part: list, use_1904: bool = False):
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    flat = [c for *_, cells in part for c in cells]
    kinds = [c[0] if c else None for c in flat]
    number = [c[1] if c and c[0] in "NT" else None for c in flat]
    ts = np.full(len(flat), np.iinfo(np.int64).min)
    if "T" in kinds:
        at = [i for i, k in enumerate(kinds) if k == "T"]
        ts[at] = moments([float(flat[i][1]) for i in at], use_1904)
    for i, k in enumerate(kinds):
        if k == "D" and (moment := _iso(flat[i][1])) is not None:
            ts[i] = moment
    columns = [
        pa.array([("N" if k == "T" else k) for k in kinds], pa.string()), pa.array([c[1] if c and c[0] in "SE" else None for c in flat], pa.string()), _decimals(number), pc.cast(pa.array(number, pa.string()), pa.float64()),
        pa.array([c[1] == "1" if c and c[0] == "B" else None for c in flat], pa.bool_()), pa.array(ts, pa.timestamp("us"), mask=ts == np.iinfo(np.int64).min),
        pa.array([c[2] if c else None for c in flat], pa.string()), pa.array([c[3] if c else None for c in flat], pa.string()),
    ]
    struct = pa.StructArray.from_arrays(columns, ["kind", "s", "n", "d", "b", "ts", "display", "formula"], mask=pa.array([k is None for k in kinds], pa.bool_()))
    offsets = np.concatenate([[0], np.cumsum([len(cells) for *_, cells in part])]).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([path] * len(part)), pa.array([p[0] for p in part], pa.int32()), pa.array([p[1] for p in part]),
            pa.array([p[2] for p in part], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), struct),
        ],
        ["file", "sheet_no", "sheet_name", "_row", "cells"],
    )


EXTRAS = "file string, sheet_no int, sheet_name string, type string, text string, first_row long, last_row long, first_col long, last_col long"


def extras(path: str, content: bytes, o: ReadOptions, kinds: set[str] | None = None):
    """Merges, links and notes of the chosen sheets; only packages have them."""
    import pyarrow as pa

    from ..operators.rows import select_sheets

    if format_of(content) != "xlsx":
        raise xlsx.Unsupported("extra data of files other than xlsx")
    package = xlsx.Package(content, o.cache)
    names = [n for n, _ in package.sheets]
    found = [(path, no, names[no].strip(), *e) for no in select_sheets(names, o.sheets) for e in package.extras(no) if not kinds or e[0] in kinds]
    types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), *[pa.int64()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found) if found else [()] * 9, types)], [f.split()[0] for f in EXTRAS.split(", ")])
