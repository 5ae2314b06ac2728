"""Writing XLSX packages row by row: styles, merges, widths, links, notes, rich texts, images.

A ``Sheet`` streams rows into its part; nothing but what stands beside the cells (merges, links, notes,
images) is held until the end.
"""

from __future__ import annotations

import datetime as dt
import io
import math
import zipfile
from dataclasses import dataclass, field, replace
from decimal import Decimal
from tempfile import SpooledTemporaryFile
from xml.sax.saxutils import escape, quoteattr

from ..sources.xlsx import MAX_COLUMNS, MAX_ROWS, letters

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
DRAWING = "http://schemas.openxmlformats.org/drawingml/2006"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
MAX_EXACT = 9007199254740991


@dataclass(frozen=True)
class Style:
    """A cell style; ``key`` decides whether two are the same."""

    number_format: str | None = None
    bold: bool = False
    italic: bool = False
    underline: bool = False
    strike: bool = False
    font_name: str = "Calibri"
    font_size: float = 11
    font_color: str | None = None
    fill: str | None = None
    horizontal: str | None = None
    vertical: str | None = None
    wrap: bool = False
    border: str | None = None
    border_color: str | None = None
    locked: bool = True
    rotation: int = 0
    indent: int = 0


HEAD_STYLE = Style(bold=True, font_size=14, fill="C0C0C0", horizontal="center", vertical="center", wrap=True, border="thin")


@dataclass(frozen=True)
class Link:
    url: str
    text: str | None = None


@dataclass(frozen=True)
class Formula:
    expression: str
    value: object = None


@dataclass(frozen=True)
class Note:
    value: object
    text: str
    author: str = ""


@dataclass(frozen=True)
class RichText:
    """Runs of (text, style)."""

    runs: tuple[tuple[str, Style | None], ...]


@dataclass(frozen=True)
class Anchor:
    """Cells that an image covers, the offsets inside them in EMU, and how it moves with cells."""

    rows: int = 1
    columns: int = 1
    dx1: int = 0
    dy1: int = 0
    dx2: int = 0
    dy2: int = 0
    moves: str = "twoCell"


@dataclass(frozen=True)
class Image:
    data: bytes
    value: object = None
    anchor: Anchor = Anchor()


def image_kind(data: bytes) -> str:
    for head, kind in ((b"\x89PNG", "png"), (b"\xff\xd8\xff", "jpeg"), (b"GIF8", "gif"), (b"BM", "bmp"), (b"II*\0", "tiff"), (b"MM\0*", "tiff")):
        if data.startswith(head):
            return kind
    return "png"


def escaped(text: str) -> str:
    """Text of a cell: XML entities, control characters and what looks like an escape as ``_xHHHH_``."""
    out = []
    for i, c in enumerate(text):
        if ord(c) < 32 and c not in "\t\n" or ord(c) in (0xFFFE, 0xFFFF) or 0xD800 <= ord(c) <= 0xDFFF:
            out.append(f"_x{ord(c):04X}_")
        elif c == "_" and text[i + 1 : i + 2] == "x" and text[i + 6 : i + 7] == "_" and all(h in "0123456789abcdefABCDEF" for h in text[i + 2 : i + 6]) and len(text) > i + 6:
            out.append("_x005F_")
        else:
            out.append(c)
    return escape("".join(out))


def serial(value: dt.date, use_1904: bool = False) -> float:
    """A date or datetime as a serial number."""
    day = value.date() if isinstance(value, dt.datetime) else value
    epoch = dt.date(1904, 1, 1) if use_1904 else dt.date(1899, 12, 31) if day < dt.date(1900, 3, 1) else dt.date(1899, 12, 30)
    out = float((day - epoch).days)
    if isinstance(value, dt.datetime):
        out += ((value.hour * 60 + value.minute) * 60 + value.second + value.microsecond / 1e6) / 86400
    return out


class Styles:
    """The style part: each different style once."""

    def __init__(self):
        self.known: dict[Style, int] = {Style(): 0}

    def number(self, style: Style | None) -> int:
        return 0 if style is None else self.known.setdefault(style, len(self.known))

    def xml(self) -> str:
        formats, fonts, fills, borders, xfs = {}, [], ['<fill><patternFill patternType="none"/></fill>', '<fill><patternFill patternType="gray125"/></fill>'], [], []

        def once(items, xml):
            if xml not in items:
                items.append(xml)
            return items.index(xml)

        for s in self.known:
            code = 0
            if s.number_format and s.number_format != "General":
                code = formats.setdefault(s.number_format, 164 + len(formats))
            font = once(fonts, font_xml("font", s))
            fill = once(fills, f'<fill><patternFill patternType="solid"><fgColor rgb="FF{s.fill}"/><bgColor indexed="64"/></patternFill></fill>') if s.fill else 0
            side = lambda n, s=s: f'<{n} style="{s.border}"><color {f"""rgb="FF{s.border_color}" """ if s.border_color else "auto=\"1\""}/></{n}>' if s.border else f"<{n}/>"
            border = once(borders, "<border>" + "".join(map(side, ("left", "right", "top", "bottom"))) + "<diagonal/></border>")
            align = "".join(f' {k}="{v}"' for k, v in (("horizontal", s.horizontal), ("vertical", s.vertical), ("wrapText", "1" if s.wrap else None), ("textRotation", s.rotation or None), ("indent", s.indent or None)) if v)
            inner = (f"<alignment{align}/>" if align else "") + ("" if s.locked else '<protection locked="0"/>')
            xfs.append(f'<xf numFmtId="{code}" fontId="{font}" fillId="{fill}" borderId="{border}" xfId="0" applyNumberFormat="1" applyFont="1" applyFill="1" applyBorder="1" applyAlignment="1">{inner}</xf>')
        listed = lambda n, items: f'<{n} count="{len(items)}">{"".join(items)}</{n}>' if items else ""
        codes = [f"<numFmt numFmtId=\"{i}\" formatCode={quoteattr(c)}/>" for c, i in formats.items()]
        return (
            f'{_HEAD}<styleSheet xmlns="{MAIN}">{listed("numFmts", codes)}{listed("fonts", fonts)}{listed("fills", fills)}{listed("borders", borders)}'
            f'<cellStyleXfs count="1"><xf numFmtId="0" fontId="0" fillId="0" borderId="0"/></cellStyleXfs>{listed("cellXfs", xfs)}'
            '<cellStyles count="1"><cellStyle name="Normal" xfId="0" builtinId="0"/></cellStyles></styleSheet>'
        )


def font_xml(tag: str, s: Style) -> str:
    name = "rFont" if tag == "rPr" else "name"
    flags = "".join(f"<{t}/>" for t, on in (("b", s.bold), ("i", s.italic), ("strike", s.strike), ("u", s.underline)) if on)
    return f'<{tag}>{flags}<sz val="{s.font_size:g}"/>' + (f'<color rgb="FF{s.font_color}"/>' if s.font_color else "") + f"<{name} val={quoteattr(s.font_name)}/></{tag}>"


@dataclass
class Options:
    """Of a sheet: widths and heights by column and row, panes, merges, validations, filter, conditions."""

    widths: dict[int, float] = field(default_factory=dict)
    freeze: tuple[int, int] | None = None
    default_height: float | None = None
    auto_filter: tuple[int, int, int, int] | None = None


class Sheet:
    """A worksheet that takes rows in order."""

    def __init__(self, book: "Workbook", name: str, options: Options):
        self.book, self.name, self.options = book, name, options
        self.next_row = 0
        self.merges: list[tuple[int, int, int, int]] = []
        self.links: list[tuple[int, int, str]] = []
        self.notes: list[tuple[int, int, str, str]] = []
        self.images: list[tuple[int, int, Image]] = []
        self.validations: list[str] = []
        self.conditions: list[str] = []
        self.max_column = -1
        self.spool = SpooledTemporaryFile(max_size=32 << 20)

    def write_row(self, values: list, styles: list[Style | None] | Style | None = None, row: int | None = None, height: float | None = None) -> int:
        """A row of values; None leaves a cell out unless it has a style. Returns its index."""
        at = self.next_row if row is None else row
        if at < self.next_row or at >= MAX_ROWS or len(values) > MAX_COLUMNS:
            raise ValueError("rows come in order, and within the sheet's limits")
        out = [f'<row r="{at + 1}"' + (f' ht="{height:g}" customHeight="1"' if height else "") + ">"]
        for col, value in enumerate(values):
            style = styles[col] if isinstance(styles, (list, tuple)) else styles
            if value is not None or style is not None:
                out.append(self._cell(at, col, value, style))
        out.append("</row>")
        self.spool.write("".join(out).encode("utf-8", "xmlcharrefreplace"))
        self.max_column = max(self.max_column, len(values) - 1)
        self.next_row = at + 1
        return at

    def _cell(self, row: int, col: int, value, style: Style | None) -> str:
        while isinstance(value, (Note, Image)):
            if isinstance(value, Note):
                self.notes.append((row, col, value.text, value.author))
            else:
                self.images.append((row, col, value))
            value = value.value
        if isinstance(value, Link):
            self.links.append((row, col, value.url))
            value = value.url if value.text is None else value.text
        formula = ""
        if isinstance(value, Formula):
            formula, value = f"<f>{escape(value.expression.removeprefix('='))}</f>", value.value
        if isinstance(value, (dt.date, dt.datetime)) and (style is None or style.number_format is None):
            code = "yyyy-mm-dd hh:mm:ss" if isinstance(value, dt.datetime) else "yyyy-mm-dd"
            style = Style(number_format=code) if style is None else replace(style, number_format=code)
        number = self.book.styles.number(style)
        head = f'<c r="{letters(col)}{row + 1}"' + (f' s="{number}"' if number else "")
        if value is None:
            return f"{head}>{formula}</c>" if formula else f"{head}/>"
        if isinstance(value, bool):
            return f'{head} t="b">{formula}<v>{int(value)}</v></c>'
        if isinstance(value, int) and abs(value) > MAX_EXACT:
            value = str(value)
        if isinstance(value, float) and not math.isfinite(value):
            return f'{head} t="e">{formula}<v>#NUM!</v></c>'
        if isinstance(value, (int, float, Decimal)):
            return f"{head}>{formula}<v>{value!r}</v></c>" if not isinstance(value, Decimal) else f"{head}>{formula}<v>{value:f}</v></c>"
        if isinstance(value, (dt.date, dt.datetime)):
            return f"{head}>{formula}<v>{serial(value, self.book.use_1904)!r}</v></c>"
        if isinstance(value, RichText):
            runs = "".join(f'<r>{font_xml("rPr", s) if s else ""}<t xml:space="preserve">{escaped(t)}</t></r>' for t, s in value.runs)
            return f'{head} t="inlineStr"><is>{runs}</is></c>'
        if formula:
            return f'{head} t="str">{formula}<v>{escaped(str(value))}</v></c>'
        if self.book.shared is not None:
            return f'{head} t="s"><v>{self.book.shared.setdefault(str(value), len(self.book.shared))}</v></c>'
        return f'{head} t="inlineStr"><is><t xml:space="preserve">{escaped(str(value))}</t></is></c>'

    def merge(self, first_row: int, last_row: int, first_col: int, last_col: int) -> None:
        if (first_row, first_col) != (last_row, last_col) and (first_row, last_row, first_col, last_col) not in self.merges:
            self.merges.append((first_row, last_row, first_col, last_col))

    def validate(self, area: tuple[int, int, int, int], choices: list[str]) -> None:
        """A list of allowed values for an area (first row, last row, first column, last column)."""
        r0, r1, c0, c1 = area
        self.validations.append(f'<dataValidation type="list" allowBlank="1" showErrorMessage="1" sqref="{letters(c0)}{r0 + 1}:{letters(c1)}{r1 + 1}"><formula1>{escape(chr(34) + ",".join(choices) + chr(34))}</formula1></dataValidation>')

    def condition(self, area: tuple[int, int, int, int], operator: str, value: str) -> None:
        """A conditional rule on an area, without a format of its own."""
        r0, r1, c0, c1 = area
        self.conditions.append(f'<conditionalFormatting sqref="{letters(c0)}{r0 + 1}:{letters(c1)}{r1 + 1}"><cfRule type="cellIs" priority="{len(self.conditions) + 1}" operator="{operator}"><formula>{escape(value)}</formula></cfRule></conditionalFormatting>')

    def write_to(self, zip_: zipfile.ZipFile, number: int) -> None:
        rels: list[str] = []

        def relation(kind: str, target: str, external: bool = False) -> str:
            rels.append(f'<Relationship Id="rId{len(rels) + 1}" Type="{OFFICE}/{kind}" Target={quoteattr(target)}{" TargetMode=\"External\"" if external else ""}/>')
            return f"rId{len(rels)}"

        o = self.options
        with zip_.open(f"xl/worksheets/sheet{number}.xml", "w", force_zip64=True) as out:
            put = lambda s: out.write(s.encode("utf-8"))
            put(f'{_HEAD}<worksheet xmlns="{MAIN}" xmlns:r="{OFFICE}">')
            if self.next_row and self.max_column >= 0:
                put(f'<dimension ref="A1:{letters(self.max_column)}{self.next_row}"/>')
            pane = ""
            if o.freeze:
                rows, cols = o.freeze
                split = (f' xSplit="{cols}"' if cols else "") + (f' ySplit="{rows}"' if rows else "")
                pane = f'<pane{split} topLeftCell="{letters(cols)}{rows + 1}" activePane="{"bottomRight" if rows and cols else "bottomLeft" if rows else "topRight"}" state="frozen"/>'
            put(f'<sheetViews><sheetView workbookViewId="0">{pane}</sheetView></sheetViews>')
            put(f'<sheetFormatPr defaultRowHeight="{o.default_height or 15:g}"' + (' customHeight="1"' if o.default_height else "") + "/>")
            if o.widths:
                put("<cols>" + "".join(f'<col min="{c + 1}" max="{c + 1}" width="{w:g}" customWidth="1"/>' for c, w in sorted(o.widths.items())) + "</cols>")
            put("<sheetData>")
            self.spool.seek(0)
            while chunk := self.spool.read(1 << 20):
                out.write(chunk)
            put("</sheetData>")
            if o.auto_filter:
                r0, r1, c0, c1 = o.auto_filter
                put(f'<autoFilter ref="{letters(c0)}{r0 + 1}:{letters(c1)}{r1 + 1}"/>')
            if self.merges:
                put(f'<mergeCells count="{len(self.merges)}">' + "".join(f'<mergeCell ref="{letters(c0)}{r0 + 1}:{letters(c1)}{r1 + 1}"/>' for r0, r1, c0, c1 in self.merges) + "</mergeCells>")
            put("".join(self.conditions))
            if self.validations:
                put(f'<dataValidations count="{len(self.validations)}">{"".join(self.validations)}</dataValidations>')
            if self.links:
                put("<hyperlinks>" + "".join(f'<hyperlink ref="{letters(c)}{r + 1}" ' + (f"location={quoteattr(url[1:])}" if url.startswith("#") else f'r:id="{relation("hyperlink", url, True)}"') + "/>" for r, c, url in self.links) + "</hyperlinks>")
            if self.images:
                put(f'<drawing r:id="{relation("drawing", f"../drawings/drawing{number}.xml")}"/>')
            if self.notes:
                put(f'<legacyDrawing r:id="{relation("vmlDrawing", f"../drawings/vmlDrawing{number}.vml")}"/>')
                relation("comments", f"../comments{number}.xml")
            put("</worksheet>")
        if rels:
            zip_.writestr(f"xl/worksheets/_rels/sheet{number}.xml.rels", f'{_HEAD}<Relationships xmlns="{RELS}">{"".join(rels)}</Relationships>')
        if self.notes:
            self._write_notes(zip_, number)
        if self.images:
            self._write_images(zip_, number)

    def _write_notes(self, zip_, number: int) -> None:
        authors = sorted({a for *_, a in self.notes})
        listed = "".join(f'<comment ref="{letters(c)}{r + 1}" authorId="{authors.index(a)}"><text><t xml:space="preserve">{escaped(t)}</t></text></comment>' for r, c, t, a in self.notes)
        zip_.writestr(f"xl/comments{number}.xml", f'{_HEAD}<comments xmlns="{MAIN}"><authors>{"".join(f"<author>{escape(a)}</author>" for a in authors)}</authors><commentList>{listed}</commentList></comments>')
        shapes = "".join(
            f'<v:shape id="_x0000_s{1025 + i}" type="#_x0000_t202" style="position:absolute;visibility:hidden" fillcolor="#ffffe1" o:insetmode="auto"><x:ClientData ObjectType="Note"><x:MoveWithCells/><x:SizeWithCells/>'
            f"<x:Anchor>{c + 1},15,{r},2,{c + 3},15,{r + 4},4</x:Anchor><x:AutoFill>False</x:AutoFill><x:Row>{r}</x:Row><x:Column>{c}</x:Column></x:ClientData></v:shape>"
            for i, (r, c, _, _) in enumerate(self.notes)
        )
        zip_.writestr(f"xl/drawings/vmlDrawing{number}.vml", f'<xml xmlns:v="urn:schemas-microsoft-com:vml" xmlns:o="urn:schemas-microsoft-com:office:office" xmlns:x="urn:schemas-microsoft-com:office:excel"><v:shapetype id="_x0000_t202" coordsize="21600,21600" o:spt="202" path="m,l,21600r21600,l21600,xe"/>{shapes}</xml>')

    def _write_images(self, zip_, number: int) -> None:
        rels, anchors = [], []
        for i, (r, c, image) in enumerate(self.images, 1):
            name = f"image{number}_{i}.{image_kind(image.data)}"
            zip_.writestr(f"xl/media/{name}", image.data)
            rels.append(f'<Relationship Id="rId{i}" Type="{OFFICE}/image" Target="../media/{name}"/>')
            a = image.anchor
            mark = lambda tag, col, dx, row, dy: f"<xdr:{tag}><xdr:col>{col}</xdr:col><xdr:colOff>{dx}</xdr:colOff><xdr:row>{row}</xdr:row><xdr:rowOff>{dy}</xdr:rowOff></xdr:{tag}>"
            anchors.append(
                f'<xdr:twoCellAnchor editAs="{a.moves}">{mark("from", c, a.dx1, r, a.dy1)}{mark("to", c + a.columns, a.dx2, r + a.rows, a.dy2)}'
                f'<xdr:pic><xdr:nvPicPr><xdr:cNvPr id="{i}" name="Image {i}"/><xdr:cNvPicPr/></xdr:nvPicPr><xdr:blipFill><a:blip r:embed="rId{i}"/><a:stretch><a:fillRect/></a:stretch></xdr:blipFill>'
                '<xdr:spPr><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></xdr:spPr></xdr:pic><xdr:clientData/></xdr:twoCellAnchor>'
            )
        zip_.writestr(f"xl/drawings/drawing{number}.xml", f'{_HEAD}<xdr:wsDr xmlns:xdr="{DRAWING}/spreadsheetDrawing" xmlns:a="{DRAWING}/main" xmlns:r="{OFFICE}">{"".join(anchors)}</xdr:wsDr>')
        zip_.writestr(f"xl/drawings/_rels/drawing{number}.xml.rels", f'{_HEAD}<Relationships xmlns="{RELS}">{"".join(rels)}</Relationships>')


class Workbook:
    """A package under construction. ``finish`` writes it once; a password is refused, as there is no cipher here."""

    def __init__(self, use_1904: bool = False, shared_strings: bool = False, password: str | None = None):
        if password:
            from ..sources.xlsx import Unsupported

            raise Unsupported("encrypted workbooks")
        self.use_1904, self.styles = use_1904, Styles()
        self.shared: dict[str, int] | None = {} if shared_strings else None
        self.sheets: list[Sheet] = []
        self.finished: bytes | None = None

    def sheet(self, name: str, options: Options | None = None) -> Sheet:
        """The sheet of that name, made if it isn't there."""
        if self.finished is not None:
            raise ValueError("the workbook is finished")
        for s in self.sheets:
            if s.name == name:
                return s
        if not name or len(name) > 31 or any(c in name for c in "[]:*?/\\"):
            raise ValueError(f"not a sheet name: {name!r}")
        self.sheets.append(Sheet(self, name, options or Options()))
        return self.sheets[-1]

    def write(self, out) -> None:
        """The package into a binary file."""
        sheets = self.sheets or [self.sheet("Sheet1")]
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=3) as z:
            overrides, kinds = [], set()
            for i, s in enumerate(sheets, 1):
                s.write_to(z, i)
                overrides.append((f"/xl/worksheets/sheet{i}.xml", "application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"))
                if s.notes:
                    overrides.append((f"/xl/comments{i}.xml", "application/vnd.openxmlformats-officedocument.spreadsheetml.comments+xml"))
                if s.images:
                    overrides.append((f"/xl/drawings/drawing{i}.xml", "application/vnd.openxmlformats-officedocument.drawing+xml"))
                    kinds |= {image_kind(image.data) for _, _, image in s.images}
            rels = "".join(f'<Relationship Id="rId{i}" Type="{OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
            rels += f'<Relationship Id="rIdS" Type="{OFFICE}/styles" Target="styles.xml"/>'
            overrides += [("/xl/workbook.xml", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"), ("/xl/styles.xml", "application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml")]
            if self.shared is not None:
                rels += f'<Relationship Id="rIdT" Type="{OFFICE}/sharedStrings" Target="sharedStrings.xml"/>'
                overrides.append(("/xl/sharedStrings.xml", "application/vnd.openxmlformats-officedocument.spreadsheetml.sharedStrings+xml"))
                z.writestr("xl/sharedStrings.xml", f'{_HEAD}<sst xmlns="{MAIN}" uniqueCount="{len(self.shared)}">' + "".join(f'<si><t xml:space="preserve">{escaped(t)}</t></si>' for t in self.shared) + "</sst>")
            names = "".join(f'<sheet name={quoteattr(s.name)} sheetId="{i}" r:id="rId{i}"/>' for i, s in enumerate(sheets, 1))
            z.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><workbookPr{" date1904=\"1\"" if self.use_1904 else ""}/><sheets>{names}</sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{RELS}">{rels}</Relationships>')
            z.writestr("xl/styles.xml", self.styles.xml())
            z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{RELS}"><Relationship Id="rId1" Type="{OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            defaults = {"rels": "application/vnd.openxmlformats-package.relationships+xml", "xml": "application/xml", "vml": "application/vnd.openxmlformats-officedocument.vmlDrawing"} | {k: f"image/{k}" for k in kinds}
            z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">' + "".join(f'<Default Extension="{e}" ContentType="{t}"/>' for e, t in defaults.items()) + "".join(f'<Override PartName="{n}" ContentType="{t}"/>' for n, t in overrides) + "</Types>")

    def finish(self) -> bytes:
        """The package's bytes; a second call gives them again."""
        if self.finished is None:
            out = io.BytesIO()
            self.write(out)
            self.finished = out.getvalue()
        return self.finished
