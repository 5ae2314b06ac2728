import datetime as dt

import pytest

from sheetspark.sinks import xls as out
from sheetspark.sources import xls, xlsx


def test_round_trip_of_kinds_and_long_tables():
    book = out.Book()
    sheet = book.sheet("a é中")
    rows = [["text", "é", "中文", 1, -2.5, True, None, dt.datetime(2020, 1, 1, 12), dt.date(1900, 1, 1), 2**60, float("nan")]]
    rows += [[f"row-{i} " + "x中"[i % 2] * (i % 50), i / 4] for i in range(3000)] + [["z" * 20_000], ["中" * 20_000]]
    for r in rows:
        sheet.write_row(r)
    sheet.merge(0, 1, 0, 1)
    book.sheet("two").write_row(["only"])
    read = xls.Book(book.finish())
    assert read.names == ["a é中", "two"] and read.merges(0) == [(0, 1, 0, 1)]
    got = dict(read.rows(0))
    assert [(c.kind, c.raw) for c in got[0]] == [("S", "text"), ("S", "é"), ("S", "中文"), ("N", "1"), ("N", "-2.5"), ("B", "1"), ("N", "43831.5"), ("N", "1"), ("S", str(2**60)), ("E", "#NUM!")]
    assert read.formats[got[0][6].style] == "yyyy-mm-dd hh:mm:ss"
    assert all([c.raw for c in got[i + 1]] == [r[0], f"{r[1]:g}" if r[1] != int(r[1]) else str(int(r[1]))] for i, r in enumerate(rows[1:3001]))
    assert got[3001][0].raw == "z" * 20_000 and got[3002][0].raw == "中" * 20_000
    assert [c.raw for _, cells in read.rows(1) for c in cells] == ["only"]


def test_large_compound_file_and_errors():
    stream = bytes(range(256)) * 40_000  # more sectors than the header alone can list
    assert xls.compound_streams(out.compound(stream))["Workbook"] == stream
    with pytest.raises(xlsx.FormatError):
        xls.Book(b"no")
    with pytest.raises(xlsx.Unsupported):
        out.Book(password="x")
    assert [xls.rk(v) for v in (0x3FF00000, 0x3FF00001, (5 << 2) | 2, (500 << 2) | 3, (0xFFFFFFFB << 2 | 2) & 0xFFFFFFFF)] == [1.0, 0.01, 5, 5.0, -5]
