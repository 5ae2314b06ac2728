import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sheetspark.functions import dates, numbers, text
from sheetspark.functions.formats import display, is_date_code
from sheetspark.operators.schema import Field, Schema, head_merges, sheet_row


@pytest.mark.parametrize("value, code, want", [
    (1234.5, "#,##0.00", "1,234.50"), (0.125, "0.0%", "12.5%"), (-3, "0.00;(0.00)", "(3.00)"), (12345678, "0.00E+00", "1.23E+07"),
    (43831.042372685, "yyyy-mm-dd hh:mm:ss", "2020-01-01 01:01:01"), (43831.75, "h:mm AM/PM", "6:00 PM"), (1.5, "[h]:mm", "36:00"), (0.5, "# ?/?", "1/2"), (1.25, "# ?/?", "1 1/4"),
    (5, '"x"0"y"', "x5y"), (1234567, '0,"k"', "1235k"), (0, '0;-0;"zero"', "zero"), (43831, "d-mmm-yy", "1-Jan-20"), (3, "General", "3"), (0.1, None, "0.1"),
    (150, '[>100]"big";"small"', "big"), (7, "000", "007"), (60, "yyyy/m/d", "1900/3/1"), (5, "_(* #,##0_)", "5"), (1e12, "General", "1E+12"), ("t", '@"!"', "t!"), (-1.5, "0.0", "-1.5"), (43831.5, '上午/下午h"时"', "下午12时"),
])
def test_display(value, code, want):
    assert display(value, code) == want


def test_date_codes():
    assert is_date_code("yyyy-mm-dd") and is_date_code("[h]:mm") and not is_date_code("0.00") and not is_date_code('0 "days"') and not is_date_code("General")
    assert display(43831, "mmmm d", locale="de_DE") == "Januar 1" and display(1234.5, "#,##0.0", locale="fr") == "1\u202f234,5"


def test_decimal_patterns(spark):
    cases = [("#.##%", "1.235", "123.5%"), ("#", "1.235", "1"), ("0.00", "1.235", "1.24"), ("#,##0.00", "1234.5", "1,234.50"), ("0.00;[neg]0.00", "-1.235", "[neg]1.24"), ("0.00E00", "1235", "1.24E03"), ("'USD '0.00", "12.5", "USD 12.50"), ("#.##‰", "0.01234", "12.34‰"), ("0.0", "-0.04", "-0.0")]
    row = spark.range(1).select(*[numbers.format_decimal(F.lit(Decimal(v)), p).alias(f"c{i}") for i, (p, v, _) in enumerate(cases)]).first()
    assert list(row) == [w for _, _, w in cases]
    parse = [("12.34%", "#.##%", Decimal("0.1234")), ("12.34", "#.##%", None), ("1,234.50", "#,##0.00", Decimal("1234.5")), ("1.00abc", "0.00", Decimal(1)), (" 1.00", "0.00", None), ("1.24E03", "0.00E00", Decimal(1240)), ("-5", "0", Decimal(-5))]
    row = spark.range(1).select(*[numbers.parse_by_pattern(F.lit(t), p).alias(f"c{i}") for i, (t, p, _) in enumerate(parse)]).first()
    assert list(row) == [w for _, _, w in parse]
    row = spark.range(1).select(numbers.parse_wrapped(F.lit("255.9"), 8).alias("a"), numbers.parse_decimal(F.lit(" 1")).alias("b"), numbers.fifteen_digits(F.lit(0.1) + F.lit(0.2)).alias("c"), numbers.general_extreme(F.lit(1.5e11), True).alias("d")).first()
    assert list(row) == [-1, None, 0.3, "1.5E11"]
    with pytest.raises(Exception, match="rounding necessary"):
        spark.range(1).select(numbers.format_decimal(F.lit(Decimal("1.001")), "0.00", numbers.UNNECESSARY)).collect()
    with pytest.raises(ValueError):
        numbers.parse_pattern("abc")


def test_serials(spark):
    got = [r[0] for r in spark.createDataFrame([(x,) for x in (0.0, 1.0, 59.0, 60.0, 61.0, 43831.042372685, -1.0)], "x double").select(dates.from_serial(F.col("x"))).collect()]
    assert got == [dt.datetime(1899, 12, 31), dt.datetime(1900, 1, 1), dt.datetime(1900, 2, 28), dt.datetime(1900, 3, 1), dt.datetime(1900, 3, 1), dt.datetime(2020, 1, 1, 1, 1, 1), None]


def test_texts(spark):
    row = spark.range(1).select(text.trim(F.lit("\t\0 a  ")), text.unescape_ooxml(F.lit("a_x000D__xD800_b")), text.column_letters(F.lit(16383)), text.column_index(F.lit("$xfd")), text.fill_placeholders(F.lit("{a} \\{a\\} {b}"), {"a": F.lit(1)})).first()
    assert list(row) == ["a ", "a\r_xD800_b", "XFD", 16383, "1 {a} {b}"]


def test_schema_plans():
    s = Schema([Field("a", order=2), Field("b", index=0), Field("c", order=1), Field("d", ignore=True), Field("e", index=4)])
    assert [(i, f.name) for i, f in s.columns()] == [(0, "b"), (1, "c"), (2, "a"), (4, "e")]
    assert [(i, f.name) for i, f in s.selected(include_names=["a", "b"], by_include_order=True)] == [(0, "a"), (1, "b")]
    with pytest.raises(ValueError):
        Schema([Field("a", index=1), Field("b", index=1)])
    assert head_merges([("T", "x"), ("T", "y"), ("z",)]) == [(0, 0, 0, 1), (0, 1, 2, 2)]

    @sheet_row(ignore_unannotated=True)
    class Person:
        name: str = Field("", heads=("Name",))
        age: int = Field("", index=3)
        note: str

    assert [(f.name, f.type) for f in Person.__sheet__.used] == [("name", "string"), ("age", "long")]
