"""Dates of sheets as Column expressions: serial numbers in both date systems, patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns tried for texts without a pattern of their own.
DATETIME_PATTERNS = ("yyyyMMddHHmmss", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm", "yyyyMMdd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss")
DATE_PATTERNS = ("yyyy-MM-dd", "yyyy/MM/dd")
#: Numbers of the built-in formats that show dates.
DATE_FORMAT_IDS = (*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59))
#: A serial number is below this: the studied system's dates end with the year 262142.
LAST_SERIAL = 95_051_806
_STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%j": "DDD", "%%": "'%'"}


def from_serial(serial: Column, use_1904: bool = False) -> Column:
    """A serial number as timestamp_ntz, to the millisecond; null for negative and non-finite ones and beyond ``LAST_SERIAL``.

    In the 1900 system serials below 61 count from 1899-12-31 and others from 1899-12-30, as serial 60
    is a day that never was; 59 is 28 February, 60 and 61 are both 1 March 1900.
    """
    d = serial.cast("double")
    day = F.floor(d)
    millis = F.floor((d - day) * 86400000 + 0.5)
    epoch = F.lit("1904-01-01") if use_1904 else F.when(day < 61, F.lit("1899-12-31")).otherwise(F.lit("1899-12-30"))
    moment = F.timestamp_add("MILLISECOND", millis.cast("bigint"), F.timestamp_add("DAY", day.cast("int"), epoch.cast("timestamp_ntz")))
    return F.when((d >= 0) & (d < LAST_SERIAL) & ~F.isnan(d), moment)


def to_serial(c: Column, use_1904: bool = False) -> Column:
    """A date or timestamp as a serial number."""
    moment = c.cast("timestamp_ntz")
    date = moment.cast("date")
    epoch = F.lit("1904-01-01") if use_1904 else F.when(date < F.lit("1900-03-01").cast("date"), F.lit("1899-12-31")).otherwise(F.lit("1899-12-30"))
    micros = F.timestamp_diff("MICROSECOND", date.cast("timestamp_ntz"), moment)
    return F.datediff(date, epoch.cast("date")) + micros / F.lit(86400000000.0)


def java_date(days: Column) -> Column:
    """Days since 1899-12-30."""
    return F.date_add(F.lit("1899-12-30").cast("date"), days.cast("int"))


def spark_pattern(pattern: str) -> str:
    """A Java pattern as it is; strftime directives as what they are called in Java."""
    if "%" not in pattern:
        return pattern
    for directive, java in _STRFTIME.items():
        pattern = pattern.replace(directive, java)
    return pattern


def _parse(c: Column, pattern: str) -> Column:
    """A text by a pattern, null if it doesn't fit.

    Texts that can't fit a pattern of digits and separators don't reach the parser, whose failures cost much.
    """
    parsed = F.try_to_timestamp(c, F.lit(pattern))
    if not re.fullmatch(r"(?:yyyy|MM|dd|HH|mm|ss|[-/.: ])+", pattern):
        return parsed
    digits = re.sub("[yMdHms]", "[0-9]", re.escape(pattern).replace("\\ ", " ").replace("\\-", "-"))
    return F.when(c.rlike(f"^{digits}$"), parsed)


def parse_datetime(c: Column, pattern: str | None = None) -> Column:
    """The first pattern that a text fits as a whole, as timestamp_ntz; null if none does."""
    patterns = [spark_pattern(pattern)] if pattern else DATETIME_PATTERNS
    return F.coalesce(*[_parse(c, p).cast("timestamp_ntz") for p in patterns])


def parse_date(c: Column, pattern: str | None = None) -> Column:
    """As ``parse_datetime``, for dates."""
    patterns = [spark_pattern(pattern)] if pattern else DATE_PATTERNS
    return F.coalesce(*[_parse(c, p).cast("date") for p in patterns])


def format_datetime(c: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """A date or timestamp as text; years beyond 9999 have all their digits and no sign."""
    pattern = spark_pattern(pattern)
    unsigned = "'".join(re.sub("y{4,}", "y", part) if i % 2 == 0 else part for i, part in enumerate(pattern.split("'")))
    return F.date_format(c, pattern) if unsigned == pattern else F.when(F.year(c) > 9999, F.date_format(c, unsigned)).otherwise(F.date_format(c, pattern))


def is_date_format(code: Column, number: Column | None = None) -> Column:
    """Whether a number format shows dates: by built-in number, or by y, d, h or s in its code."""
    plain = F.regexp_replace(F.lower(code), r"\"[^\"]*\"|\\.|\[(?![hms]+\])[^\]]*\]", "")
    by_code = F.coalesce(plain.rlike("[ydhs]"), F.lit(False))
    return by_code if number is None else F.coalesce(number.isin(*DATE_FORMAT_IDS), F.lit(False)) | by_code
