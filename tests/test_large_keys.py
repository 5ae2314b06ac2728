"""Queries on keys that only larger tables have, against their SQL or plain Python."""

import pytest
from pyspark.sql import functions as F

from sheetspark import queries as catalog

KEYS = [0, 60, 61, 900_719, 900_720, 922_337, 922_338, 2_958_465, 2_958_466, 8_999_999, 90_000_000]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    made = str(tmp_path_factory.mktemp("keys"))
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").limit(1).drop("o_orderkey")
    spark.createDataFrame([(k,) for k in KEYS], "o_orderkey long").crossJoin(F.broadcast(orders)).write.parquet(f"{made}/orders.parquet")
    return made


def test_exact_integer_guard_beyond_long(spark, folder):
    got = {r.o_orderkey: r.kind for r in catalog.queries()["q_exact_integer_guard"](spark, folder).collect()}
    assert got == {k: "text" if k * 10**13 > 9007199254740991 else "number" for k in KEYS}


@pytest.mark.parametrize("name", ["q_cnv_string_number", "q_cnv_double_extreme"])
def test_query_of_large_keys(spark, folder, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{folder}/orders.parquet/*.parquet'")
    df = catalog.queries()[name](spark, folder)
    found = con.execute(catalog.oracle_sql()[name])
    at = [d[0] for d in found.description]
    assert sorted(map(tuple, df.select(*at).collect())) == sorted(found.fetchall())


def test_dates_end_where_the_studied_system_ends(spark):
    from sheetspark.functions import dates
    from sheetspark.sources import decode

    last = dates.LAST_SERIAL
    df = spark.createDataFrame([(float(last) - 1,), (float(last),)], "n double")
    shown = [r.s for r in df.select(dates.format_datetime(dates.from_serial(F.col("n")), "'yyyy' yyyy-MM-dd").alias("s")).collect()]
    assert shown == ["yyyy 262142-12-31", None]
    none, known = decode.moments([last, last - 1], False).tolist()
    assert none == -(1 << 63) and known == spark.sql("select unix_micros(timestamp'+262142-12-31 00:00:00Z')").first()[0]
