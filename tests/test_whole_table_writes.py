import pytest

from sheetspark import queries as catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", "decimal bigint byte short int long float double".split())
def test_all_orders_are_written(spark, name):
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet").count()
    got = catalog.queries()[f"q_cnv_{name}_write_all"](spark, FOLDER).collect()
    assert len(got) == orders
    assert any(r.formatted.startswith("-") for r in got) and (name == "byte" or any("," in r.formatted for r in got))
