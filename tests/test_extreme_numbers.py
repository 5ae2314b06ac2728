"""Numbers that a decimal with 18 digits behind the point does not hold."""

from sheetspark.operators import convert
from sheetspark.operators.schema import Field, Schema
from sheetspark.plans.reader import read_bytes

VALUES = ["1e25", "-1e25", "1.5e-20", "1e300", "0", "12.5", "99999999999999999999.5"]


def test_doubles_survive_csv_and_mark_nothing(spark):
    schema = Schema([Field("id", "int"), Field("v", "double")])
    made = ("id,v\n" + "\n".join(f"{i},{v}" for i, v in enumerate(VALUES))).encode()
    got = read_bytes(spark, made).schema(schema).on_error(convert.PERMISSIVE).load().orderBy("id").collect()
    assert [r.v for r in got] == [float(v) for v in VALUES] and not any(r._error for r in got)


def test_a_decimal_that_does_not_fit_is_an_error(spark):
    schema = Schema([Field("v", "decimal")])
    got = read_bytes(spark, b"v\n1e25\n3.5").schema(schema).on_error(convert.PERMISSIVE).load().collect()
    assert [r.v is None for r in got] == [True, False] and got[0]._error.message == "not a decimal"
