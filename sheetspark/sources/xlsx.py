"""XLSX packages: sheets, shared strings, styles, cells as a stream, merges, links and notes."""

from __future__ import annotations

import codecs
import io
import posixpath
import re
import tempfile
import zipfile
from array import array
from collections.abc import Iterator
from typing import NamedTuple
from xml.parsers import expat

MAX_ROWS, MAX_COLUMNS = 1048576, 16384
#: Bytes of shared strings above which they are kept in a file.
CACHE_BYTES = 5_000_000
#: Codes of the built-in number formats that appear in packages.
BUILT_IN = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??",
    14: "yyyy/m/d", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "yyyy/m/d h:mm",
    37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mm:ss.0", 48: "##0.0E+0", 49: "@",
}
_ESCAPE = re.compile(r"_x([0-9A-Fa-f]{4})_")


class FormatError(ValueError):
    """A file that isn't what it says."""


class Unsupported(ValueError):
    """Something that is understood but not offered, such as encryption."""


class Cell(NamedTuple):
    """A cell as stored: kind S string, N number, B boolean, E error, D date text; ``raw`` is its text."""

    col: int
    kind: str
    raw: str
    style: int = 0
    formula: str | None = None


def unescape(text: str) -> str:
    """``_xHHHH_`` as the character it names; surrogates stay as written."""
    if "_x" not in text:
        return text
    return _ESCAPE.sub(lambda m: m[0] if 0xD800 <= int(m[1], 16) <= 0xDFFF else chr(int(m[1], 16)), text)


def parse_reference(reference: str) -> tuple[int, int]:
    """Zero-based row and column of an A1 reference, dollar signs and any case allowed."""
    m = re.fullmatch(r"\$?([A-Za-z]{1,3})\$?([0-9]{1,7})", reference)
    if not m:
        raise FormatError(f"not a cell reference: {reference}")
    col = 0
    for c in m[1].upper():
        col = col * 26 + ord(c) - 64
    row = int(m[2])
    if not 1 <= row <= MAX_ROWS or col > MAX_COLUMNS:
        raise FormatError(f"cell reference out of range: {reference}")
    return row - 1, col - 1


def letters(col: int) -> str:
    out, col = "", col + 1
    while col:
        col, rest = divmod(col - 1, 26)
        out = chr(65 + rest) + out
    return out


def parse_range(reference: str) -> tuple[int, int, int, int]:
    """(first row, last row, first column, last column)."""
    first, _, last = reference.partition(":")
    (a, b), (c, d) = parse_reference(first), parse_reference(last or first)
    return a, c, b, d


def number_text(raw: str) -> str:
    """A stored number kept to fifteen significant digits; not finite ones are an error."""
    value = float(raw)
    if value != value or value in (float("inf"), float("-inf")):
        raise FormatError(f"not a finite number: {raw}")
    if len(raw) <= 15 and "e" not in raw and "E" not in raw:
        return raw
    short = f"{value:.15g}"
    return repr(float(short)) if "e" in short else short


#: A row and a cell as most writers write them.
_ROW = re.compile(r'<row r="([0-9]{1,7})"[^<>]*(?<!/)>(.*?)</row>', re.S)
_CELL = re.compile(
    r'<c r="([A-Z]{1,3})([0-9]{1,7})"(?: s="([0-9]+)")?(?: t="(n|s|b|e|str|inlineStr)")?'
    r'(?:/>|>(?:<f>([^<]*)</f>)?(?:<v>([^<]*)</v>|<is><t(?: xml:space="preserve")?>([^<]*)</t></is>)?</c>)'
)
_COLUMNS: dict[str, int] = {}
_PLAIN_NUMBER = re.compile(r"-?[0-9]{1,15}")


def _entities(text: str) -> str:
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    return _ENTITY.sub(_named, text) if "&" in text else text


_ENTITY = re.compile(r"&(?:#x([0-9A-Fa-f]+)|#([0-9]+)|(amp|lt|gt|quot|apos));")
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def _named(m) -> str:
    return chr(int(m[1], 16)) if m[1] else chr(int(m[2])) if m[2] else _NAMED[m[3]]


def _plain_cell(m, row: int, strings) -> Cell | None:
    name, at, style, kind, formula, value, inline = m.groups()
    col = _COLUMNS.get(name)
    if col is None:
        col = _COLUMNS[name] = parse_reference(f"{name}1")[1]
    if int(at) != row + 1:
        raise FormatError(f"cell {name}{at} in row {row + 1}")
    raw = inline if value is None else value
    if raw is None and formula is None:
        return None
    style = int(style) if style else 0
    if formula is not None:
        formula = _entities(formula)
    if kind is None or kind == "n":
        if not raw:
            return Cell(col, "S", "", style, formula)
        return Cell(col, "N", raw if _PLAIN_NUMBER.fullmatch(raw) else number_text(raw), style, formula)
    if kind == "s":
        return Cell(col, "S", strings[int(raw)] if raw else "", style, formula)
    if kind in ("str", "inlineStr"):
        return Cell(col, "S", unescape(_entities(raw or "")), style, formula)
    return Cell(col, "B", "1" if raw in ("1", "true") else "0", style, formula) if kind == "b" else Cell(col, "E", raw or "", style, formula)


def _local(tag: str) -> str:
    return tag.rsplit(":", 1)[-1]


def _elements(data: bytes) -> Iterator[tuple[str, dict]]:
    """Start tags of a small part, without prefixes."""
    found: list[tuple[str, dict]] = []
    parser = expat.ParserCreate()
    parser.StartElementHandler = lambda t, a: found.append((_local(t), {_local(k) if k != "r:id" else "r:id": v for k, v in a.items()}))
    parser.Parse(data, True)
    return iter(found)


class SharedStrings:
    """Shared strings by index: in a list, or in a temporary file of this process with an index of offsets."""

    def __init__(self, stream, size: int, mode: str = "auto"):
        self.on_disk = mode == "disk" or mode == "auto" and size > CACHE_BYTES
        self.values: list[str] = []
        self.offsets = array("q", [0])
        self.file = tempfile.TemporaryFile() if self.on_disk else None
        parts: list[str] = []
        state = {"text": False, "phonetic": 0}

        def start(tag, _):
            tag = _local(tag)
            if tag == "si":
                parts.clear()
            elif tag == "rPh":
                state["phonetic"] += 1
            elif tag == "t":
                state["text"] = not state["phonetic"]

        def end(tag):
            tag = _local(tag)
            if tag == "t":
                state["text"] = False
            elif tag == "rPh":
                state["phonetic"] -= 1
            elif tag == "si":
                self._add(unescape("".join(parts)))

        parser = expat.ParserCreate()
        parser.buffer_text = True
        parser.StartElementHandler, parser.EndElementHandler = start, end
        parser.CharacterDataHandler = lambda s: parts.append(s) if state["text"] else None
        parser.ParseFile(stream)

    def _add(self, text: str) -> None:
        if self.file is None:
            self.values.append(text)
        else:
            raw = text.encode("utf-8", "surrogatepass")
            self.file.write(raw)
            self.offsets.append(self.offsets[-1] + len(raw))

    def __len__(self) -> int:
        return len(self.values) if self.file is None else len(self.offsets) - 1

    def __getitem__(self, i: int) -> str:
        if not 0 <= i < len(self):
            raise FormatError(f"no shared string {i}")
        if self.file is None:
            return self.values[i]
        self.file.seek(self.offsets[i])
        return self.file.read(self.offsets[i + 1] - self.offsets[i]).decode("utf-8", "surrogatepass")


class Package:
    """A workbook's parts. ``source``: a path, bytes or a binary file."""

    def __init__(self, source, cache: str = "auto"):
        raw = io.BytesIO(source) if isinstance(source, (bytes, bytearray, memoryview)) else source
        head = raw.read(8) if hasattr(raw, "read") else open(raw, "rb").read(8)
        if hasattr(raw, "seek"):
            raw.seek(0)
        if head == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
            raise Unsupported("an encrypted or a legacy workbook")
        try:
            self.zip = zipfile.ZipFile(raw)
        except zipfile.BadZipFile as e:
            raise FormatError("not a workbook package") from e
        self.names = {n.lower(): n for n in self.zip.namelist()}
        self.cache = cache
        roots = self._relations("")
        self.workbook = next((t for _, kind, t in roots if kind == "officeDocument"), "xl/workbook.xml")
        relations = {i: (kind, t) for i, kind, t in self._relations(self.workbook)}
        self.sheets: list[tuple[str, str]] = []
        self.date1904 = False
        for tag, a in _elements(self.read(self.workbook)):
            if tag == "sheet":
                kind, target = relations.get(a.get("r:id", ""), ("", ""))
                if not self.has(target):
                    raise FormatError(f"the part of sheet {a.get('name')} is missing")
                self.sheets.append((a["name"], target))
            elif tag == "workbookPr":
                self.date1904 = a.get("date1904") in ("1", "true")
        by_kind = {kind: t for kind, t in relations.values()}
        self.styles_part, self.strings_part = by_kind.get("styles"), by_kind.get("sharedStrings")
        self._strings: SharedStrings | None = None
        self._formats: list[str] | None = None

    def has(self, name: str) -> bool:
        return name.lower() in self.names

    def read(self, name: str) -> bytes:
        if not self.has(name):
            raise FormatError(f"the part {name} is missing")
        return self.zip.read(self.names[name.lower()])

    def open(self, name: str):
        return self.zip.open(self.names[name.lower()])

    def _relations(self, part: str) -> list[tuple[str, str, str]]:
        """(id, kind, target) of a part's relationships."""
        folder, name = posixpath.split(part)
        rels = posixpath.join(folder, "_rels", f"{name}.rels")
        if not self.has(rels):
            return []
        out = []
        for tag, a in _elements(self.read(rels)):
            if tag == "Relationship":
                target = a["Target"]
                if a.get("TargetMode") != "External":
                    target = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
                out.append((a["Id"], a["Type"].rsplit("/", 1)[-1], target))
        return out

    @property
    def strings(self) -> SharedStrings:
        if self._strings is None:
            if self.strings_part and self.has(self.strings_part):
                size = self.zip.getinfo(self.names[self.strings_part.lower()]).file_size
                self._strings = SharedStrings(self.open(self.strings_part), size, self.cache)
            else:
                self._strings = SharedStrings(io.BytesIO(b"<sst/>"), 0)
        return self._strings

    @property
    def formats(self) -> list[str]:
        """The number format code of each cell style."""
        if self._formats is None:
            custom, self._formats, inside = dict(BUILT_IN), [], False
            if self.styles_part and self.has(self.styles_part):
                ids = []
                for tag, a in _elements(self.read(self.styles_part)):
                    if tag == "numFmt":
                        custom[int(a["numFmtId"])] = a["formatCode"]
                    elif tag in ("cellStyleXfs", "cellXfs", "cellStyles", "dxfs"):
                        inside = tag == "cellXfs"
                    elif tag == "xf" and inside:
                        ids.append(int(a.get("numFmtId", 0)))
                self._formats = [custom.get(i, "General") for i in ids]
            self._formats = self._formats or ["General"]
        return self._formats

    def rows(self, sheet: int, with_formulas: bool = True) -> Iterator[tuple[int, list[Cell]]]:
        """(row, cells) of the rows that the sheet stores, in order, a few rows held at a time.

        Rows written in the usual plain way are matched by a pattern; from the first that isn't on, an XML
        parser reads the sheet, and rows already given are passed over.
        """
        last = -1
        if with_formulas:
            for row, cells in self._plain_rows(sheet):
                if cells is None:
                    break
                last = row
                yield row, cells
            else:
                return
        for row, cells in self._parsed_rows(sheet, with_formulas):
            if row > last:
                yield row, cells

    def _plain_rows(self, sheet: int) -> Iterator[tuple[int, list[Cell] | None]]:
        """Rows by pattern; a row of None cells says that there is something else."""
        strings, rest, begun = self.strings, "", False
        decoder = codecs.getincrementaldecoder("utf-8")("strict")
        with self.open(self.sheets[sheet][1]) as stream:
            while True:
                chunk = stream.read(1 << 18)
                try:
                    rest += decoder.decode(chunk, not chunk)
                except UnicodeDecodeError:
                    yield 0, None
                    return
                if not begun:
                    at = rest.find("<sheetData>")
                    if at < 0:
                        if chunk and len(rest) < 1 << 20:
                            continue
                        yield 0, None
                        return
                    rest, begun = rest[at + 11 :], True
                end = rest.rfind("</row>") + 6
                at = 0
                while at < end:
                    m = _ROW.match(rest, at)
                    if m is None:
                        break
                    body, cells, place = m[2], [], 0
                    row = int(m[1]) - 1
                    for c in _CELL.finditer(body):
                        if c.start() != place:
                            break
                        place = c.end()
                        cell = _plain_cell(c, row, strings)
                        if cell is not None:
                            cells.append(cell)
                    if place != len(body):
                        break
                    at = m.end()
                    yield row, cells
                if at < end:
                    yield 0, None
                    return
                rest = rest[at:]
                if "</sheetData>" in rest:
                    if not rest.startswith("</sheetData>") or "<row" in rest:
                        yield 0, None
                    return
                if not chunk:
                    yield 0, None
                    return

    def _parsed_rows(self, sheet: int, with_formulas: bool = True) -> Iterator[tuple[int, list[Cell]]]:
        """Rows by an XML parser, whatever way they are written."""
        stream = self.open(self.sheets[sheet][1])
        strings = self.strings
        done: list[tuple[int, list[Cell]]] = []
        now: dict = {"row": -1, "col": -1, "cells": [], "type": "n", "style": 0, "at": 0, "keep": None, "v": [], "f": [], "depth": 0}

        def start(tag, a):
            tag = _local(tag)
            if tag == "row":
                now["row"] = int(a["r"]) - 1 if "r" in a else now["row"] + 1
                now["col"], now["cells"] = -1, []
            elif tag == "c":
                if "r" in a:
                    row, now["at"] = parse_reference(a["r"])
                    if row != now["row"]:
                        now["row"] = row
                else:
                    now["at"] = now["col"] + 1
                now["col"] = now["at"]
                now["type"], now["style"], now["v"], now["f"] = a.get("t", "n"), int(a.get("s", 0)), None, None
            elif tag in ("v", "t"):
                now["keep"] = "v"
                now["v"] = now["v"] or []
            elif tag == "f" and with_formulas:
                now["keep"], now["f"] = "f", []
            elif tag == "rPh":
                now["phonetic"] = True

        def end(tag):
            tag = _local(tag)
            if tag in ("v", "t", "f"):
                now["keep"] = None
            elif tag == "c":
                cell = self._cell(now, strings)
                if cell is not None:
                    now["cells"].append(cell)
            elif tag == "row":
                done.append((now["row"], now["cells"]))

        def data(text):
            if now["keep"]:
                now[now["keep"]].append(text)

        parser = expat.ParserCreate()
        parser.buffer_text = True
        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
        while chunk := stream.read(1 << 16):
            try:
                parser.Parse(chunk, False)
            except expat.ExpatError as e:
                raise FormatError(f"broken worksheet: {e}") from e
            yield from done
            done.clear()
        try:
            parser.Parse(b"", True)
        except expat.ExpatError as e:
            raise FormatError(f"the worksheet ends early: {e}") from e
        yield from done

    def _cell(self, now: dict, strings: SharedStrings) -> Cell | None:
        kind, formula = now["type"], "".join(now["f"]) if now["f"] is not None else None
        raw = "".join(now["v"]) if now["v"] is not None else None
        if raw is None and formula is None:
            return None
        if kind == "s":
            return Cell(now["at"], "S", strings[int(raw)] if raw else "", now["style"], formula)
        if kind in ("str", "inlineStr"):
            return Cell(now["at"], "S", unescape(raw or ""), now["style"], formula)
        if kind == "b":
            return Cell(now["at"], "B", "1" if raw in ("1", "true") else "0", now["style"], formula)
        if kind == "e":
            return Cell(now["at"], "E", raw or "", now["style"], formula)
        if kind == "d":
            return Cell(now["at"], "D", raw or "", now["style"], formula)
        if kind != "n":
            raise FormatError(f"unknown cell type: {kind}")
        return Cell(now["at"], "N", number_text(raw), now["style"], formula) if raw else Cell(now["at"], "S", "", now["style"], formula)

    def last_row(self, sheet: int) -> int | None:
        """The last row that is written down, else the end of the sheet's dimension."""
        last = dimension = None
        for tag, a in _elements(self.read(self.sheets[sheet][1])):
            if tag == "row":
                last = int(a["r"]) - 1 if "r" in a else (-1 if last is None else last) + 1
            elif tag == "dimension":
                dimension = parse_range(a["ref"])[1]
        return dimension if last is None else last

    def extras(self, sheet: int) -> Iterator[tuple[str, str | None, int, int, int, int]]:
        """(MERGE, HYPERLINK or COMMENT, text, first row, last row, first column, last column): notes come last."""
        part = self.sheets[sheet][1]
        relations = {i: (kind, t) for i, kind, t in self._relations(part)}
        for tag, a in _elements(self.read(part)):
            if tag == "mergeCell":
                yield ("MERGE", None, *parse_range(a["ref"]))
            elif tag == "hyperlink":
                if "r:id" in a:
                    if a["r:id"] not in relations:
                        raise FormatError(f"a link without a target: {a['r:id']}")
                    target = relations[a["r:id"]][1] + (f"#{a['location']}" if a.get("location") else "")
                else:
                    target = a.get("location", "")
                yield ("HYPERLINK", target, *parse_range(a["ref"]))
        for kind, target in relations.values():
            if kind == "comments" and self.has(target):
                yield from _comments(self.read(target))


def _comments(data: bytes) -> list[tuple]:
    out, now = [], {"ref": None, "text": [], "keep": False}

    def start(tag, a):
        tag = _local(tag)
        if tag == "comment":
            now["ref"], now["text"] = a["ref"], []
        now["keep"] = tag == "t"

    def end(tag):
        if _local(tag) == "comment":
            out.append(("COMMENT", unescape("".join(now["text"])), *parse_range(now["ref"])))
        now["keep"] = False

    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda s: now["text"].append(s) if now["keep"] else None
    parser.Parse(data, True)
    return out
