"""Filling and extending existing XLSX packages: everything but the filled sheets stays as it is.

A sheet becomes a grid of cells with their style numbers. Lists are filled first, single values second,
appended rows last; then the grid is written back between the parts of the sheet around it, with merges,
formulas and the dimension moved along.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterable
from decimal import Decimal
from xml.sax.saxutils import escape

from ..sources.xlsx import MAX_ROWS, Package, letters, parse_range
from .xlsx import Link, escaped, serial

_HOLDER = re.compile(r"(?<!\\)\{([^{}\\]+)\}")
_REF = re.compile(r"(?<![A-Za-z0-9_!'.])(\$?[A-Z]{1,3})(\$?)([0-9]{1,7})(?![0-9A-Za-z_(])")


class Grid:
    """One sheet: cells by row and column as (style, value, formula)."""

    def __init__(self, package: Package, number: int):
        self.part = package.sheets[number][1]
        source = package.read(self.part).decode("utf-8")
        m = re.search(r"<sheetData\s*/>|<sheetData>.*?</sheetData>", source, re.S)
        self.before, self.after = source[: m.start()], source[m.end() :]
        self.attributes = {int(r) - 1: re.sub(r'\s(?:r|spans)="[^"]*"', "", a) for a, r in re.findall(r'<row\b((?:\s[^>]*?)?\sr="([0-9]+)"[^>/]*)/?>', m[0])}
        self.cells: dict[int, dict[int, tuple]] = {}
        for row, cells in package.rows(number):
            self.cells[row] = {c.col: (c.style, _value(c.kind, c.raw), c.formula) for c in cells}
        # styled cells without a value are cells, too
        for ref, style in re.findall(r'<c r="([A-Z]+[0-9]+)"(?: s="([0-9]+)")?\s*/>', m[0]):
            row, _, col, _ = parse_range(ref)
            self.cells.setdefault(row, {}).setdefault(col, (int(style or 0), None, None))

    @property
    def last_row(self) -> int:
        return max((r for r, cells in self.cells.items() if cells), default=-1)

    def shift(self, below: int, by: int) -> None:
        """Rows under ``below`` move down: cells, heights, merges and what formulas point at."""
        if by <= 0:
            return
        move = lambda r: r + by if r > below else r
        self.cells = {move(r): cells for r, cells in self.cells.items()}
        self.attributes = {move(r): a for r, a in self.attributes.items()}

        def moved(m):
            return f"{m[1]}{m[2]}{move(int(m[3]) - 1) + 1}"

        for cells in self.cells.values():
            for col, (style, value, formula) in cells.items():
                if formula:
                    cells[col] = style, value, _REF.sub(moved, formula)
        self.after = re.sub(r'(<(?:mergeCell|hyperlink|dataValidation|conditionalFormatting)\b[^>]*?(?:ref|sqref)=")([^"]+)"', lambda m: m[1] + _REF.sub(moved, m[2]) + '"', self.after)

    def xml(self, use_1904: bool) -> bytes:
        out = ["<sheetData>"]
        for row in sorted(set(self.cells) | set(self.attributes)):
            out.append(f'<row r="{row + 1}"{self.attributes.get(row, "")}>')
            for col, (style, value, formula) in sorted(self.cells.get(row, {}).items()):
                out.append(_cell_xml(row, col, style, value, formula, use_1904))
            out.append("</row>")
        out.append("</sheetData>")
        used = [(r, c) for r, cells in self.cells.items() for c in cells]
        before = self.before
        if used:
            ref = f"{letters(min(c for _, c in used))}{min(r for r, _ in used) + 1}:{letters(max(c for _, c in used))}{max(r for r, _ in used) + 1}"
            before = re.sub(r'<dimension ref="[^"]*"', f'<dimension ref="{ref}"', before)
        return (before + "".join(out) + self.after).encode("utf-8")


def _value(kind: str, raw: str):
    return raw == "1" if kind == "B" else Decimal(raw) if kind == "N" else raw


def _cell_xml(row: int, col: int, style: int, value, formula: str | None, use_1904: bool) -> str:
    head = f'<c r="{letters(col)}{row + 1}"' + (f' s="{style}"' if style else "")
    f = f"<f>{escape(formula)}</f>" if formula else ""
    if isinstance(value, Link):
        value = value.text or value.url
    if value is None:
        return f"{head}>{f}</c>" if f else f"{head}/>"
    if isinstance(value, bool):
        return f'{head} t="b">{f}<v>{int(value)}</v></c>'
    if isinstance(value, (dt.date, dt.datetime)):
        return f"{head}>{f}<v>{serial(value, use_1904)!r}</v></c>"
    if isinstance(value, Decimal):
        return f"{head}>{f}<v>{value:f}</v></c>"
    if isinstance(value, (int, float)):
        return f"{head}>{f}<v>{value!r}</v></c>"
    if f:
        return f'{head} t="str">{f}<v>{escaped(str(value))}</v></c>'
    return f'{head} t="inlineStr"><is><t xml:space="preserve">{escaped(str(value))}</t></is></c>'


def shown(value) -> str:
    """A value inside a longer text."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, dt.datetime):
        return value.strftime("%Y-%m-%d %H:%M:%S")
    return str(value)


def replaced(text: str, values: dict) -> object:
    """A template text with its names replaced; a text that is one name as a whole becomes the value itself."""
    whole = _HOLDER.fullmatch(text)
    if whole and whole[1] in values:
        return values[whole[1]]
    out = _HOLDER.sub(lambda m: shown(values[m[1]]) if m[1] in values else m[0], text)
    return out.replace("\\{", "{").replace("\\}", "}")


class Template:
    """``Template(bytes).fill({...}).fill_list(rows, prefix="p").finish()``."""

    def __init__(self, source, use_1904: bool = False):
        self.package = Package(source)
        self.grids: dict[int, Grid] = {}
        self.use_1904 = use_1904
        self.values: dict[int, dict] = {}
        self.lists: list[tuple] = []
        self.rows: list[tuple[int, list]] = []
        self.done: bytes | None = None

    def _sheet(self, sheet: int | str) -> int:
        names = [n.strip() for n, _ in self.package.sheets]
        if isinstance(sheet, str):
            if sheet.strip() not in names:
                raise LookupError(f"no such sheet: {sheet}")
            return names.index(sheet.strip())
        return sheet

    def fill(self, values: dict, sheet: int | str = 0) -> "Template":
        """Single values; of several calls the last value of a name counts."""
        self.values.setdefault(self._sheet(sheet), {}).update(values)
        return self

    def fill_list(self, rows: Iterable[dict], prefix: str = "", horizontal: bool = False, force_new_row: bool = False, auto_style: bool = True, sheet: int | str = 0) -> "Template":
        """Rows for ``{.name}``, or ``{prefix.name}``; a further call of a prefix goes on behind the last."""
        rows = [r if isinstance(r, dict) else r.asDict() for r in rows]
        if rows:
            self.lists.append((self._sheet(sheet), rows, prefix, horizontal, force_new_row, auto_style))
        return self

    def write_rows(self, rows: Iterable[list], sheet: int | str = 0) -> "Template":
        """Rows behind the last one of the sheet."""
        self.rows += [(self._sheet(sheet), list(r)) for r in rows]
        return self

    def _grid(self, n: int) -> Grid:
        if n not in self.grids:
            self.grids[n] = Grid(self.package, n)
        return self.grids[n]

    def finish(self) -> bytes:
        if self.done is not None:
            return self.done
        anchors: dict[tuple, list] = {}
        cursor: dict[tuple, int] = {}
        for n, rows, prefix, horizontal, force, style in self.lists:
            grid = self._grid(n)
            key = (n, prefix)
            mark = "{" + prefix + "."
            if key not in anchors:
                anchors[key] = [(r, c, cell) for r, cells in sorted(grid.cells.items()) for c, cell in sorted(cells.items()) if isinstance(cell[1], str) and mark in cell[1] and any(name.startswith(prefix + ".") for name in _HOLDER.findall(cell[1]))]
            begin = cursor.get(key, 0)
            last = max((r for r, _, _ in anchors[key]), default=0)
            if force and not horizontal:
                by = len(rows) if begin else len(rows) - 1
                below = last + max(0, begin - 1)
                grid.shift(below, by)
                for other, cells in anchors.items():
                    if other != key and other[0] == n:
                        anchors[other] = [(r + by if r > below else r, c, cell) for r, c, cell in cells]
            for r, c, (s, text, formula) in anchors[key]:
                for i, values in enumerate(rows, begin):
                    named = {f"{prefix}.{k}": v for k, v in values.items()}
                    at = (r, c + i) if horizontal else (r + i, c)
                    if at[0] >= MAX_ROWS:
                        raise ValueError("more rows than a sheet has")
                    grid.cells.setdefault(at[0], {})[at[1]] = (s if style or i == 0 else 0, replaced(text, named), formula)
                    if not horizontal and i and r in grid.attributes:
                        grid.attributes.setdefault(at[0], grid.attributes[r])
            cursor[key] = begin + len(rows)
        for n, values in self.values.items():
            for cells in self._grid(n).cells.values():
                for col, (s, text, formula) in cells.items():
                    if isinstance(text, str) and "{" in text:
                        cells[col] = s, replaced(text, values), formula
        for n, row in self.rows:
            grid = self._grid(n)
            grid.cells[grid.last_row + 1] = {c: (0, v, None) for c, v in enumerate(row) if v is not None}
        out, changed = io.BytesIO(), {g.part.lower(): g for g in self.grids.values()}
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for info in self.package.zip.infolist():
                grid = changed.get(info.filename.lower())
                z.writestr(info.filename, grid.xml(self.use_1904) if grid else self.package.zip.read(info))
        self.done = out.getvalue()
        return self.done


def append(source, df, order: list[str], sheet: int | str = 0, use_1904: bool = False) -> bytes:
    """A package with a DataFrame's rows behind those of a sheet; styles, merges and other parts stay."""
    return Template(source, use_1904).write_rows((list(r) for r in df.orderBy(*order).toLocalIterator()), sheet).finish()
