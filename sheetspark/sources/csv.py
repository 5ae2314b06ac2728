"""Delimited text: records with their physical index, any charset, byte order marks."""

from __future__ import annotations

import codecs
import csv
import io
from collections.abc import Iterator

MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))

csv.field_size_limit(1 << 30)


def charset_name(name: str) -> str:
    """A charset's name; an unknown one is an error. GBK reads as its superset, as browsers do."""
    try:
        found = codecs.lookup(name).name
    except LookupError as e:
        raise ValueError(f"unknown charset: {name}") from e
    return "gb18030" if found in ("gbk", "gb2312") else found


def decode(data: bytes, charset: str | None = None) -> str:
    """Text of a file: a byte order mark wins over ``charset`` and is taken off."""
    for mark, name in MARKS:
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    return data.decode(charset_name(charset or "utf-8"), "replace")


def records(data: bytes, charset: str | None = None, delimiter: str = ",") -> Iterator[tuple[int, list[str]]]:
    """(index, values) of each record; blank lines aren't records but count, records have as many values as they have."""
    for i, values in enumerate(csv.reader(io.StringIO(decode(data, charset), newline=""), delimiter=delimiter)):
        if values:
            yield i, values


def byte_order_mark(charset: str) -> bytes:
    """The mark that a file of this charset begins with; none for charsets without one."""
    return {"utf-8": codecs.BOM_UTF8, "utf-16-le": codecs.BOM_UTF16_LE, "utf-16-be": codecs.BOM_UTF16_BE, "utf-16": codecs.BOM_UTF16_LE}.get(charset_name(charset), b"")


def quote(value: str | None) -> str:
    """A value as it stands in a record."""
    value = value or ""
    return '"' + value.replace('"', '""') + '"' if any(c in value for c in ',"\r\n') else value


def encode(rows: Iterator[list[str | None]], charset: str = "utf-8", with_bom: bool = True) -> Iterator[bytes]:
    """The bytes of records, a mark first if asked for."""
    name = charset_name(charset)
    name = "utf-16-le" if name == "utf-16" else name
    if with_bom:
        yield byte_order_mark(charset)
    for row in rows:
        line = ",".join(map(quote, row))
        yield ((line or '""') + "\r\n").encode(name, "replace")
