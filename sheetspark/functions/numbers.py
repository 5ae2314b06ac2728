"""Numbers of sheets as Column expressions: truncation and wrapping, rounding modes, decimal patterns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

UP, DOWN, CEILING, FLOOR, HALF_UP, HALF_DOWN, HALF_EVEN, UNNECESSARY = "UP", "DOWN", "CEILING", "FLOOR", "HALF_UP", "HALF_DOWN", "HALF_EVEN", "UNNECESSARY"
DECIMAL, WHOLE = "decimal(38,18)", "decimal(38,0)"
MAX_EXACT = 9007199254740991


def truncate(c: Column) -> Column:
    """Towards zero, as a whole decimal."""
    d = c.cast(DECIMAL)
    return (d - d % 1).cast(WHOLE)


def wrap(c: Column, bits: int) -> Column:
    """The low ``bits`` of a truncated number in two's complement: never an error."""
    half, whole = (F.lit(1 << n).cast(WHOLE) if n < 63 else F.lit(str(1 << n)).cast(WHOLE) for n in (bits - 1, bits))
    name = {8: "tinyint", 16: "smallint", 32: "int", 64: "bigint"}[bits]
    return (F.pmod(truncate(c) + half, whole) - half).cast(WHOLE).cast(name)


_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def parse_decimal(c: Column) -> Column:
    """A text that is a number as a whole, without spaces around it; null otherwise."""
    return F.when(c.rlike(_NUMBER), c.try_cast(DECIMAL))


def parse_double(c: Column) -> Column:
    """A text that is a number as a whole as a double, however large or small."""
    return F.when(c.rlike(_NUMBER), c.try_cast("double"))


def parse_wrapped(c: Column, bits: int) -> Column:
    """parse_byte, parse_short, parse_integer, parse_long: parsed, truncated, wrapped."""
    return wrap(parse_decimal(c), bits)


def round_to(c: Column, scale: int, mode: str = HALF_UP) -> Column:
    """A decimal rounded to ``scale`` digits by any of eight modes; UNNECESSARY raises if it would change the value."""
    d = c.cast(DECIMAL)
    s = F.lit(scale)
    floor, ceil = F.floor(d, s).cast(DECIMAL), F.ceil(d, s).cast(DECIMAL)
    half = F.lit(f"5E-{scale + 1}").cast(DECIMAL)
    by = {
        FLOOR: floor, CEILING: ceil,
        DOWN: F.when(d < 0, ceil).otherwise(floor), UP: F.when(d < 0, floor).otherwise(ceil),
        HALF_UP: F.round(d, scale).cast(DECIMAL), HALF_EVEN: F.bround(d, scale).cast(DECIMAL),
        HALF_DOWN: F.when(d < 0, -F.ceil(-d - half, s).cast(DECIMAL)).otherwise(F.ceil(d - half, s).cast(DECIMAL)),
        UNNECESSARY: F.when(floor == d, d).otherwise(F.raise_error(F.lit("rounding necessary")).cast(DECIMAL)),
    }
    return by[mode]


def plain_string(c: Column) -> Column:
    """A decimal's digits without trailing zeros behind the point."""
    s = c.cast(DECIMAL).cast("string")
    return F.regexp_replace(F.regexp_replace(s, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def java_string(c: Column) -> Column:
    """A double as Java writes it: 1.0, 1.0E7, -0.0, NaN."""
    return c.cast("double").cast("string")


def fifteen_digits(c: Column) -> Column:
    """A double kept to fifteen significant digits."""
    return F.format_string("%.14e", c.cast("double")).cast("double")


def is_exact_integer(c: Column) -> Column:
    """Whether a double holds the integer exactly; others are written as text. The least long, which has no absolute value, is none."""
    return c.between(-MAX_EXACT, MAX_EXACT)


def saturated(c: Column) -> Column:
    """A long clamped to the range of an int."""
    return F.greatest(F.least(c, F.lit(2147483647)), F.lit(-2147483648)).cast("int")


def general_extreme(c: Column, scientific: bool = False) -> Column:
    """General format of very large and small numbers: |x| >= 1E11 or 0 < |x| <= 1E-10; null for others.

    Plain: rounded to an integer, all its digits. Scientific: up to five decimals and an exponent.
    """
    d = c.cast("double")
    extreme = (F.abs(d) >= 1e11) | ((F.abs(d) <= 1e-10) & (d != 0))
    if not scientific:
        return F.when(extreme, F.round(d.cast("decimal(38,12)"), 0).cast(WHOLE).cast("string"))
    text = F.format_string("%.5e", d)
    mantissa = F.regexp_replace(F.regexp_replace(F.split_part(text, F.lit("e"), F.lit(1)), "0+$", ""), r"\.$", "")
    exponent = F.split_part(text, F.lit("e"), F.lit(2)).cast("int").cast("string")
    return F.when(extreme, F.concat(mantissa, F.lit("E"), exponent))


# --- decimal patterns ------------------------------------------------------------------------------


@dataclass
class Part:
    """One side of a decimal pattern."""

    prefix: str = ""
    suffix: str = ""
    whole: str = ""
    fraction: str = ""
    exponent: int = 0
    scale: int = 1
    grouping: int = field(init=False, default=0)

    def __post_init__(self):
        self.grouping = len(self.whole) - self.whole.rindex(",") - 1 if "," in self.whole else 0
        digits = self.whole.replace(",", "")
        if set(digits) - set("#0") or set(self.fraction) - set("#0") or not digits + self.fraction:
            raise ValueError(f"not a decimal pattern: {self.whole}.{self.fraction}")
        self.min_whole, self.width = digits.count("0"), max(1, len(digits))
        self.min_fraction, self.max_fraction = self.fraction.count("0"), len(self.fraction)


def _sides(pattern: str) -> list[list[tuple[str, bool]]]:
    """Signs of each side with whether they are quoted."""
    sides, quoted, i = [[]], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "'":
            if pattern[i + 1 : i + 2] == "'":
                sides[-1].append(("'", True))
                i += 1
            else:
                quoted = not quoted
        elif c == ";" and not quoted:
            sides.append([])
        else:
            sides[-1].append((c, quoted))
        i += 1
    if quoted or len(sides) > 2:
        raise ValueError(f"not a decimal pattern: {pattern}")
    return sides


def parse_pattern(pattern: str) -> tuple[Part, Part]:
    """Positive and negative side; without a negative one it is a minus sign and the positive one."""
    def side(signs: list[tuple[str, bool]]) -> Part:
        at = [i for i, (c, q) in enumerate(signs) if not q and c in "#0.,"]
        if not at:
            raise ValueError(f"not a decimal pattern: {pattern}")
        first, last = at[0], at[-1]
        body = signs[first : last + 1]
        exponent = 0
        mark = next((i for i, (c, q) in enumerate(body) if c == "E" and not q), None)
        if mark is not None:
            exponent, body = len(body) - mark - 1, body[:mark]
        prefix, suffix = ("".join(c for c, _ in s) for s in (signs[:first], signs[last + 1 :]))
        outside = [c for c, q in signs[:first] + signs[last + 1 :] if not q]
        text = "".join(c for c, _ in body)
        whole, _, fraction = text.partition(".")
        return Part(prefix, suffix, whole, fraction, exponent, 100 if "%" in outside else 1000 if "‰" in outside else 1)

    sides = _sides(pattern)
    positive = side(sides[0])
    if len(sides) == 1:
        return positive, Part("-" + positive.prefix, positive.suffix, positive.whole, positive.fraction, positive.exponent, positive.scale)
    negative = side(sides[1])
    # as in Java, only the affixes of the negative side count
    return positive, Part(negative.prefix, negative.suffix, positive.whole, positive.fraction, positive.exponent, positive.scale)


def _plain(d: Column, part: Part, mode: str) -> Column:
    """Digits of a number that isn't negative; one chain of replacements, so that the number is computed once."""
    most, least = part.max_fraction, part.min_fraction
    text = round_to(d, most, mode).cast(f"decimal(38,{min(most, 18)})").cast("string")
    if most > 18:
        text = F.concat(text, F.lit("0" * (most - 18)))
    if part.min_whole > 1:
        width = part.min_whole + (most + 1 if most else 0)
        text = F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))
    if part.grouping:
        text = F.regexp_replace(text, rf"(?<=[0-9])(?<!\.[0-9]{{0,40}})(?=(?:[0-9]{{{part.grouping}}})+(?:\.|$))", ",")
    if most > least:
        text = F.regexp_replace(text, rf"(\.[0-9]{{{least}}}[0-9]*?)0+$", "$1")
        if not least:
            text = F.regexp_replace(text, r"\.$", "")
    return text


def format_decimal(c: Column, pattern: str, mode: str = HALF_UP) -> Column:
    """A number by a decimal pattern: ``#,##0.00``, ``0.0%``, ``0.00E00``, ``0.00;[neg]0.00``, quoted affixes."""
    positive, negative = parse_pattern(pattern)
    d = c.cast(DECIMAL)

    def side(value: Column, part: Part, rounding: str) -> Column:
        scaled = (value * part.scale).cast(DECIMAL) if part.scale != 1 else value
        if not part.exponent:
            return F.concat(F.lit(part.prefix), _plain(scaled, part, rounding), F.lit(part.suffix))
        power = F.when(scaled == 0, F.lit(0)).otherwise(F.floor(F.floor(F.log10(scaled.cast("double")) + 1e-12) / part.width) * part.width).cast("int")
        shown = lambda p: _plain((scaled.cast("double") / F.pow(F.lit(10.0), p)).cast("decimal(38,15)"), part, rounding)
        over = F.length(F.split_part(shown(power), F.lit("."), F.lit(1))) > part.width
        power = F.when(over, power + part.width).otherwise(power)
        digits = F.abs(power).cast("string")
        digits = F.when(F.length(digits) < part.exponent, F.lpad(digits, part.exponent, "0")).otherwise(digits)
        return F.concat(F.lit(part.prefix), shown(power), F.lit("E"), F.when(power < 0, "-").otherwise(""), digits, F.lit(part.suffix))

    other = {CEILING: DOWN, FLOOR: UP}.get(mode, mode)
    return F.when(d < 0, side(-d, negative, other)).otherwise(side(d, positive, mode))


def parse_by_pattern(c: Column, pattern: str) -> Column:
    """A number at the start of a text by a decimal pattern, the negative side first; null if none is there.

    What stands behind the number is ignored unless the pattern has a suffix, which must follow.
    """
    import re

    def side(part: Part, sign: str) -> Column:
        number = r"([0-9][0-9,]*" if part.grouping else r"([0-9]+"
        number += r"(?:\.[0-9]*)?|\.[0-9]+)" if part.max_fraction else ")"
        exponent = r"(E-?[0-9]+)" if part.exponent else "()"
        found = re.escape(part.prefix) + number + exponent + re.escape(part.suffix)
        regex = "^" + found.replace("\\ ", " ").replace("\\-", "-")
        digits = F.replace(F.regexp_extract(c, regex, 1), F.lit(","), F.lit(""))
        value = F.concat(F.lit(sign), digits, F.regexp_extract(c, regex, 2)).try_cast(DECIMAL)
        return F.when(c.rlike(regex), (value / part.scale).cast(DECIMAL) if part.scale != 1 else value)

    positive, negative = parse_pattern(pattern)
    return F.coalesce(side(negative, "-"), side(positive, ""))
