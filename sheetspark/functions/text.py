"""String functions of sheets as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim(c: Column) -> Column:
    """Strip characters up to U+0020 from both ends, and no others (U+00A0 stays)."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def is_empty(c: Column) -> Column:
    """Null or no characters."""
    return c.isNull() | (c == "")


def is_blank(c: Column) -> Column:
    """Null, or white space only."""
    return c.isNull() | c.rlike(r"^\s*$")


def equals(a: Column, b: Column) -> Column:
    """Equality in which null equals null."""
    return a.eqNullSafe(b)


def is_numeric(c: Column) -> Column:
    """Digits only, one at least."""
    return F.coalesce(c.rlike(r"^[0-9]+$"), F.lit(False))


def region_matches(c: Column, start: int, other: Column, other_start: int, length: int, ignore_case: bool = False) -> Column:
    """Whether ``length`` characters from the zero-based starts are the same; false beyond either end."""
    a, b = F.substring(c, start + 1, length), F.substring(other, other_start + 1, length)
    if ignore_case:
        a, b = F.lower(a), F.lower(b)
    return (F.length(c) >= start + length) & (F.length(other) >= other_start + length) & (a == b)


def boolean_value(c: Column) -> Column:
    """True for any case of ``true``; everything else, null too, is false."""
    return F.coalesce(F.lower(c) == "true", F.lit(False))


def byte_length(c: Column) -> Column:
    """Bytes in UTF-8."""
    return F.octet_length(c)


def xml_escape(c: Column) -> Column:
    """The five characters that XML reserves as entities."""
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def column_letters(index: Column) -> Column:
    """Letters of a zero-based column index below 18,278: A, Z, AA, XFD."""
    i = index.cast("int")
    letter = lambda n: F.chr(n + 65)
    two, three = i - 26, i - 702
    return (
        F.when(i < 26, letter(i))
        .when(i < 702, F.concat(letter(F.floor(two / 26)), letter(two % 26)))
        .otherwise(F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26) % 26), letter(three % 26)))
    )


def column_index(letters: Column) -> Column:
    """Zero-based index of column letters, in any case and with dollar signs."""
    clean = F.upper(F.replace(letters, F.lit("$"), F.lit("")))
    return F.aggregate(F.split(clean, ""), F.lit(0), lambda a, x: F.when(x == "", a).otherwise(a * 26 + F.ascii(x) - 64)) - 1


def cell_reference(reference: Column) -> Column:
    """struct(row, col), zero-based, of an A1 reference; null beyond 1,048,576 rows or 16,384 columns or if malformed."""
    letters, digits = (F.regexp_extract(reference, r"^\$?([A-Za-z]{1,3})\$?([1-9][0-9]{0,6})$", g) for g in (1, 2))
    row, col = digits.try_cast("int") - 1, column_index(letters)
    return F.when((digits != "") & (row < 1048576) & (col < 16384), F.struct(row.alias("row"), col.alias("col")))


def image_type(data: Column) -> Column:
    """Format of image bytes by their first bytes: png, jpeg, gif, bmp, emf, wmf, tiff or null."""
    h = F.hex(F.substring(data, 1, 8))
    return (
        F.when(h.startswith("89504E47"), "png").when(h.startswith("FFD8FF"), "jpeg").when(h.startswith("47494638"), "gif")
        .when(h.startswith("424D"), "bmp").when(h.startswith("D7CDC69A"), "wmf").when(h.startswith("01000000"), "emf")
        .when(h.startswith("49492A00") | h.startswith("4D4D002A"), "tiff")
    )


def file_format(head: Column) -> Column:
    """xlsx, xls or csv by a file's first bytes."""
    h = F.hex(F.substring(head, 1, 8))
    return F.when(h.startswith("504B0304"), "xlsx").when(h == "D0CF11E0A1B11AE1", "xls").otherwise("csv")


def placeholders(c: Column) -> Column:
    """Names in ``{name}``, ``{.name}`` and ``{list.name}`` of a text, those in escaped braces left out."""
    return F.regexp_extract_all(c, F.lit(r"(?<!\\)\{([^{}\\]+)\}"), F.lit(1))


def fill_placeholders(c: Column, values: dict[str, Column]) -> Column:
    """``{name}`` replaced by the column's text (null: nothing); unknown names stay, ``\\{x\\}`` becomes ``{x}``."""
    guard_open, guard_close = "\u0001", "\u0002"
    c = F.replace(F.replace(c, F.lit("\\{"), F.lit(guard_open)), F.lit("\\}"), F.lit(guard_close))
    for name, value in values.items():
        c = F.replace(c, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return F.replace(F.replace(c, F.lit(guard_open), F.lit("{")), F.lit(guard_close), F.lit("}"))


def unescape_ooxml(c: Column) -> Column:
    """``_xHHHH_`` as the character it names; surrogates stay as they are written."""
    parts = F.split(F.regexp_replace(c, r"_x([0-9A-Fa-f]{4})_", "\u0001$1\u0002"), "\u0001")

    def one(p: Column) -> Column:
        code = F.conv(F.substring(p, 1, 4), 16, 10).cast("int")
        rest = F.substr(p, F.lit(6))
        named = (F.substring(p, 5, 1) == "\u0002") & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.concat(F.lpad(F.hex(code), 4, "0"))), "UTF-16BE")
        return F.when(named, F.concat(char, rest)).when(F.substring(p, 5, 1) == "\u0002", F.concat(F.lit("_x"), F.substring(p, 1, 4), F.lit("_"), rest)).otherwise(p)

    return F.array_join(F.transform(parts, one), "")
