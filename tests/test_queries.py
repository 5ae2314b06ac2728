"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import decimal
import os

import pytest

from sheetspark import queries as catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return f"{value.normalize():f}"
    return repr(value) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, FOLDER)
    names = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*names).collect())
    found = duck.execute(catalog.oracle_sql()[name])
    at = [d[0] for d in found.description]
    assert sorted(at) == names
    assert got == sorted(tuple(plain(r[at.index(n)]) for n in names) for r in found.fetchall())
