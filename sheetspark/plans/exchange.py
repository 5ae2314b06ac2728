"""Workbooks in and out of services: what an upload is, what a download needs, errors as JSON."""

from __future__ import annotations

import json
from urllib.parse import quote

from ..sources import decode
from ..sources.decode import ReadOptions
from ..sources.xlsx import FormatError, Unsupported

TYPES = {
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "xls": "application/vnd.ms-excel",
    "csv": "text/csv",
}


def download(content: bytes, name: str, kind: str = "xlsx") -> tuple[dict[str, str], bytes]:
    """Headers and body of a file to be saved under a name of any letters."""
    return {
        "Content-Type": TYPES[kind], "Content-Length": str(len(content)),
        "Content-Disposition": f"attachment; filename*=UTF-8''{quote(name + '.' + kind)}",
    }, content


def failure(error: Exception) -> tuple[int, bytes]:
    """Status and JSON body of an error."""
    kind = "unsupported" if isinstance(error, Unsupported) else "format" if isinstance(error, FormatError) else "error"
    return (415 if kind == "unsupported" else 400 if kind == "format" else 500), json.dumps({"status": "failure", "kind": kind, "message": str(error)}, ensure_ascii=False).encode()


def rows_of_upload(content: bytes, options: ReadOptions | None = None) -> list[list[str | None]]:
    """A small upload's rows as texts, without Spark."""
    return [[(c[2] or c[1]) if c else None for c in cells] for *_, cells in decode.rows(content, options or ReadOptions())]


def utf16_to_index(text: str, at: int) -> int:
    """The index in a text of a place counted in UTF-16 units; inside a pair is an error."""
    units = 0
    for i, c in enumerate(text):
        if units == at:
            return i
        units += 1 + (ord(c) > 0xFFFF)
    if units != at:
        raise ValueError("not between two characters")
    return len(text)
