"""Tables of any length as many files, written and read in tasks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sheetspark.operators.schema import Field, Schema
from sheetspark.plans.reader import read_files
from sheetspark.plans.writer import write
from sheetspark.sinks import xls

SCHEMA = Schema([Field("k", "long"), Field("t"), Field("at", "datetime"), Field("d", "double")])


def table(spark, n):
    return spark.range(n).select(F.col("id").alias("k"), F.concat(F.lit('é,"'), "id").alias("t"), F.expr("timestamp_ntz'2020-02-29 12:30:00' + make_interval(0, 0, 0, int(id))").alias("at"), (F.col("id") * 0.5).alias("d"))


@pytest.mark.parametrize("kind", ["csv", "xlsx", "xls"])
def test_files_hold_all_rows_in_order(spark, kind):
    files = write(table(spark, 1000).orderBy(F.xxhash64("k")), ["k"], SCHEMA).files(kind, rows_each=70)
    found = read_files(files).schema(SCHEMA).load(("file", "_row")).orderBy("file", "_row").collect()
    assert [r.k for r in found] == list(range(1000)) and max(r._row for r in found) == 70
    assert found[31].t == 'é,"31' and found[31].at == dt.datetime(2020, 3, 31, 12, 30) and found[31].d == 15.5


def test_more_rows_than_a_legacy_sheet_holds(spark):
    files = write(table(spark, xls.MAX_ROWS + 10).coalesce(1), None, SCHEMA).files("xls", rows_each=10**6)
    assert files.count() == 2 and read_files(files).schema(SCHEMA).load().agg(F.count_distinct("k")).first()[0] == xls.MAX_ROWS + 10


def test_no_rows_and_merges(spark):
    assert read_files(write(table(spark, 0), ["k"], SCHEMA).files("xlsx")).schema(SCHEMA).load().count() == 0
    with pytest.raises(ValueError):
        write(table(spark, 5), ["k"], SCHEMA, loop_merges=[(2, 0, 1)]).files("xlsx")


def test_conversions_are_done_once(spark):
    plan = read_files(write(table(spark, 5), ["k"], SCHEMA).files("csv")).schema(SCHEMA).load()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("pmod") == 1
