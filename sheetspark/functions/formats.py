"""Number format codes: how a workbook shows a number, date or text.

Sections by sign or condition, digits and grouping, percent, exponents, fractions, dates, elapsed time,
12-hour clocks, quoted and padded text. ``display`` gives the text, and ``display_column`` a Column of it.
"""

from __future__ import annotations

import datetime as dt
import re
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that locales use. The second of each pair of day halves is the afternoon.
LOCALES = {
    "en": {"decimal": ".", "group": ",", "halves": ("AM", "PM"), "months": "January February March April May June July August September October November December".split(), "days": "Sunday Monday Tuesday Wednesday Thursday Friday Saturday".split()},
    "de": {"decimal": ",", "group": ".", "halves": ("AM", "PM"), "months": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(), "days": "Sonntag Montag Dienstag Mittwoch Donnerstag Freitag Samstag".split()},
    "fr": {"decimal": ",", "group": " ", "halves": ("AM", "PM"), "months": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(), "days": "dimanche lundi mardi mercredi jeudi vendredi samedi".split()},
    "es": {"decimal": ",", "group": ".", "halves": ("a. m.", "p. m."), "months": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(), "days": "domingo lunes martes miércoles jueves viernes sábado".split()},
    "zh": {"decimal": ".", "group": ",", "halves": ("上午", "下午"), "months": [f"{m}月" for m in "一 二 三 四 五 六 七 八 九 十 十一 十二".split()], "days": [f"星期{d}" for d in "日一二三四五六"]},
}

_TOKEN = re.compile(
    r'"([^"]*)"?|\\(.)|_(.)|\*(.)|\[([^\]]*)\]|(AM/PM|A/P|上午/下午)|(General)|(E[+-])|(y+|m+|d+|h+|s+|\.0+(?=\s*(?:$|[^0#?]))|[0#?.,%/@])|(.)', re.I | re.S
)


def locale_of(name: str | None) -> dict:
    """Names of a locale given as zh_CN, zh-Hans-CN or zh_CN.UTF-8; English for unknown ones."""
    return LOCALES.get(re.split(r"[_.@-]", name or "en")[0].lower(), LOCALES["en"])


def _sections(code: str) -> list[str]:
    out, quoted, start, i = [], False, 0, 0
    while i < len(code):
        if code[i] == '"':
            quoted = not quoted
        elif code[i] == "\\" and not quoted:
            i += 1
        elif code[i] == ";" and not quoted:
            out.append(code[start:i])
            start = i + 1
        i += 1
    return [*out, code[start:]]


@lru_cache(4096)
def _parsed(section: str) -> tuple[list[tuple[str, str]], tuple[str, float] | None]:
    """(kind, text) of each token, and the section's condition. Kinds: text, part (of a date or number), elapsed, half, general, exp."""
    tokens, condition = [], None
    for m in _TOKEN.finditer(section):
        quoted, escaped, pad, fill, bracket, half, general, exp, part, other = m.groups()
        if quoted is not None:
            tokens.append(("text", quoted))
        elif escaped is not None:
            tokens.append(("text", escaped))
        elif pad is not None or fill is not None:
            continue  # room for a sign, and filling of a column, have no text
        elif bracket is not None:
            c = re.fullmatch(r"(<=|>=|<>|<|>|=)(-?[0-9.]+)", bracket)
            if c:
                condition = c[1], float(c[2])
            elif re.fullmatch(r"h+|m+|s+", bracket, re.I):
                tokens.append(("elapsed", bracket.lower()))
            elif bracket.startswith("$"):
                sign = bracket[1:].partition("-")[0]
                if sign:
                    tokens.append(("text", sign))
        elif half:
            tokens.append(("half", half))
        elif general:
            tokens.append(("general", general))
        elif exp:
            tokens.append(("exp", exp))
        elif part:
            tokens.append(("part", part))
        else:
            tokens.append(("text", other))
    return tokens, condition


def is_date_code(code: str | None) -> bool:
    """Whether a code shows dates or times."""
    if not code or code == "General":
        return False
    return any(k in ("elapsed", "half") or k == "part" and t[0].lower() in "ymdhs" for k, t in _parsed(_sections(code)[0])[0])


def general(value: float) -> str:
    """A number without a format: up to eleven signs, an exponent for very large and small ones."""
    if value == int(value) and abs(value) < 1e11:
        return str(int(value))
    if 1e-4 <= abs(value) < 1e11:
        short = f"{value:.10g}" if len(f"{value:.10g}") <= 12 else f"{value:.9g}"
        return short if "e" not in short else f"{Decimal(short):f}"
    mantissa, _, exponent = f"{value:.5E}".partition("E")
    return f"{mantissa.rstrip('0').rstrip('.')}E{exponent[0]}{exponent[1:].lstrip('0').rjust(2, '0')}"


def display(value, code: str | None = None, use_1904: bool = False, locale: str | None = None) -> str:
    """The text that a format code makes of a number or text."""
    if value is None:
        return ""
    code = code or "General"
    sections = _sections(code)
    if isinstance(value, str):
        if len(sections) > 3 or "@" in sections[-1]:
            return "".join(value if (k, t) == ("part", "@") else t for k, t in _parsed(sections[-1])[0] if k == "text" or t == "@")
        return value
    number = float(value)
    tokens, minus = _choose(sections, number)
    if not tokens and not sections[0]:
        return general(number)
    if any(k in ("elapsed", "half") or k == "part" and t[0].lower() in "ymdhs" for k, t in tokens):
        return _date(number, tokens, use_1904, locale_of(locale))
    return minus + _number(Decimal(repr(abs(number))) if not isinstance(value, Decimal) else abs(value), tokens, locale_of(locale))


def _choose(sections: list[str], number: float) -> tuple[list[tuple[str, str]], str]:
    """The section's tokens for a number, and the minus sign that stands before it."""
    parsed = [_parsed(s) for s in sections[:3]]
    ops = {"<": number.__lt__, ">": number.__gt__, "<=": number.__le__, ">=": number.__ge__, "=": number.__eq__, "<>": number.__ne__}
    if any(c for _, c in parsed):
        for tokens, c in parsed:
            if c is None or ops[c[0]](c[1]):
                return tokens, "-" if number < 0 and (c is None or c[0] not in ("<", "<=")) else ""
        return parsed[-1][0], "-" if number < 0 else ""
    if number < 0 and len(parsed) > 1:
        return parsed[1][0], ""
    if number == 0 and len(parsed) > 2:
        return parsed[2][0], ""
    return parsed[0][0], "-" if number < 0 else ""


def _number(value: Decimal, tokens: list[tuple[str, str]], names: dict) -> str:
    if any(k == "general" for k, _ in tokens):
        return "".join(general(float(value)).replace(".", names["decimal"]) if k == "general" else t for k, t in tokens)
    if any(t == "/" for k, t in tokens if k == "part") and any(t in "?0#" for k, t in tokens if k == "part"):
        return _fraction(value, tokens)
    percent = sum(t == "%" for k, t in tokens if k == "part")
    digits = [i for i, (k, t) in enumerate(tokens) if k == "part" and (t in "0#?" or t.startswith(".0"))]
    if not digits:
        return "".join(t for k, t in tokens if k == "text" or t == "%")
    # commas right behind the last digit divide by a thousand
    last, scale = digits[-1], 0
    while last + scale + 1 < len(tokens) and tokens[last + scale + 1] == ("part", ","):
        scale += 1
    point = next((i for i, (k, t) in enumerate(tokens) if k == "part" and t.startswith(".")), None)
    exp = next((i for i, (k, _) in enumerate(tokens) if k == "exp"), None)
    end = exp if exp is not None else len(tokens)
    whole = [i for i in digits if (point is None or i < point) and i < end]
    tail = [c for i in range(point or end, end) if point is not None and tokens[i][0] == "part" for c in tokens[i][1] if c in "0#?"]
    grouped = any(t == "," for k, t in tokens[whole[0] : whole[-1]]) if whole else False
    value = value * Decimal(100) ** percent / Decimal(1000) ** scale
    power = 0
    if exp is not None:
        width = max(1, len(whole))
        power = ((value.adjusted()) // width) * width if value else 0
        value = value.scaleb(-power)
    value = value.quantize(Decimal(1).scaleb(-len(tail)), ROUND_HALF_UP)
    text = f"{value:f}"
    head, _, fraction = text.partition(".")
    least = sum(tokens[i][1] == "0" for i in whole)
    head = head.lstrip("0").rjust(least, "0")
    if grouped:
        head = re.sub(r"(?<=\d)(?=(\d{3})+$)", names["group"], head)
    spaces = sum(tokens[i][1] == "?" for i in whole)
    head = head.rjust(least + spaces) if spaces else head
    kept = list(fraction)
    for i in range(len(tail) - 1, -1, -1):
        if kept[i] != "0" or tail[i] == "0":
            break
        kept[i] = " " if tail[i] == "?" else ""
    fraction = "".join(kept)
    out, placed = [], False
    for i, (k, t) in enumerate(tokens):
        if k == "text":
            out.append(t)
        elif k == "exp":
            zeros = sum(1 for k2, t2 in tokens[i + 1 :] if k2 == "part" and t2 == "0")
            out.append(f"E{'-' if power < 0 else '+' if t[1] == '+' else ''}{str(abs(power)).rjust(zeros, '0')}")
            out += [t2 for k2, t2 in tokens[i + 1 :] if k2 == "text"]
            break
        elif t == "%":
            out.append("%")
        elif not placed and (i in whole or i == point):
            out.append(head)
            placed = True
            if point is not None and (fraction or True):
                shown = names["decimal"] + fraction if tail and fraction.strip() or "0" in tail else ("" if tail else "")
                out.append(shown)
    return "".join(out)


def _fraction(value: Decimal, tokens: list[tuple[str, str]]) -> str:
    slash = next(i for i, (k, t) in enumerate(tokens) if (k, t) == ("part", "/"))
    below = ""
    for k, t in tokens[slash + 1 :]:
        if k == "part" and t in "0#?" or k == "text" and t.isdigit():
            below += t
        else:
            break
    before = [i for i in range(slash) if tokens[i][0] == "part" and tokens[i][1] in "0#?"]
    apart = any(tokens[i][0] == "text" and tokens[i][1].isspace() for i in range(before[0], slash)) if before else False
    number = Fraction(value)
    whole = int(number) if apart else 0
    rest = number - whole
    if below.strip("0#?"):
        bottom = int(below.replace("#", "0").replace("?", "0"))
        top = round(rest * bottom)
    else:
        near = rest.limit_denominator(10 ** len(below) - 1)
        top, bottom = near.numerator, near.denominator
    if apart and top == bottom and top:
        whole, top = whole + 1, 0
    width = len(below)
    if apart and top == 0:
        return f"{whole}{' ' * (2 * width + 2)}".rstrip() if whole or not top else "0"
    shown = f"{str(top).rjust(width)}/{str(bottom).ljust(width)}"
    return (f"{whole} {shown}" if apart and whole else shown).rstrip() if apart else shown.strip()


def _date(serial: float, tokens: list[tuple[str, str]], use_1904: bool, names: dict) -> str:
    if serial < 0:
        return "#" * 10
    day = int(serial)
    # seconds are rounded to what is shown
    places = max((len(t) - 1 for k, t in tokens if k == "part" and t.startswith(".0")), default=0)
    seconds = round((serial - day) * 86400, places)
    if seconds >= 86400:
        day, seconds = day + 1, 0
    epoch = dt.datetime(1904, 1, 1) if use_1904 else dt.datetime(1899, 12, 31) if day < 61 else dt.datetime(1899, 12, 30)
    try:
        moment = epoch + dt.timedelta(days=day)
    except OverflowError:
        return "#" * 10
    whole = int(seconds)
    h, m, s = whole // 3600, whole // 60 % 60, whole % 60
    clock = any(k == "half" for k, _ in tokens)
    out = []
    marks = [(i, t.lower()) for i, (k, t) in enumerate(tokens) if k in ("part", "elapsed") and t[0].lower() in "ymdhs"]

    def minutes(i: int) -> bool:
        """Whether m means minutes: behind hours or before seconds."""
        at = [j for j, _ in marks].index(i)
        return (at > 0 and marks[at - 1][1][0] == "h") or (at + 1 < len(marks) and marks[at + 1][1][0] == "s")

    for i, (k, t) in enumerate(tokens):
        low = t.lower()
        if k == "text":
            out.append(t)
        elif k == "half":
            pair = names["halves"] if "/" in t and t.upper() == "AM/PM" else tuple(t.split("/"))
            out.append(pair[h >= 12])
        elif k == "elapsed":
            total = day * 86400 + whole
            n = {"h": total // 3600, "m": total // 60, "s": total}[low[0]]
            out.append(str(n).rjust(len(low), "0"))
        elif k != "part":
            continue
        elif low[0] == "y":
            out.append(f"{moment.year % 100:02d}" if len(low) <= 2 else f"{moment.year:04d}")
        elif low[0] == "m" and minutes(i):
            out.append(f"{m:02d}" if len(low) > 1 else str(m))
        elif low[0] == "m":
            name = names["months"][moment.month - 1]
            out.append(str(moment.month) if len(low) == 1 else f"{moment.month:02d}" if len(low) == 2 else name[:3] if len(low) == 3 else name if len(low) == 4 else name[0])
        elif low[0] == "d":
            name = names["days"][(moment.weekday() + 1) % 7]
            out.append(str(moment.day) if len(low) == 1 else f"{moment.day:02d}" if len(low) == 2 else name[:3] if len(low) == 3 else name)
        elif low[0] == "h":
            hour = (h % 12 or 12) if clock else h
            out.append(f"{hour:02d}" if len(low) > 1 else str(hour))
        elif low[0] == "s":
            out.append(f"{s:02d}" if len(low) > 1 else str(s))
        elif t.startswith(".0"):
            out.append(f"{seconds - whole:.{places}f}"[1:])
        elif t in "/,.":
            out.append(t)
    return "".join(out)


def display_column(value: Column, code: Column, use_1904: bool = False, locale: str | None = None) -> Column:
    """``display`` of a number column by a column of codes, in Arrow batches."""

    @F.pandas_udf("string")
    def run(values, codes):
        return values.__class__([None if v != v or v is None else display(v, c, use_1904, locale) for v, c in zip(values, codes)], dtype=object)

    return run(value.cast("double"), code)
