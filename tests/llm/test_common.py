import pytest
from pyspark.sql import functions as F

from sheetspark.llm import common


def test_a_cluster_needs_a_shared_folder():
    for master in ("local", "local[*]", "local[4]", "local[4,2]"):
        common.require_local(master)
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            common.require_local(master)


def test_spread_join_equals_join(spark):
    rows = common.settle(spark.range(20_000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 50).alias("k"), "id"))
    single = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    want = sorted(map(tuple, rows.join(single, "k").collect()))
    assert sorted(map(tuple, common.spread_join(rows, single, "k", parts=4).collect())) == want
    assert sorted(map(tuple, common.spread_join(rows, single, ["k"], how="left").collect())) == want
    odd = spark.createDataFrame([(None, 1), (3, 2), (99, 3)], "k long, id long")
    assert sorted(map(tuple, common.spread_join(odd, single, "k", how="left").collect()), key=str) == sorted([(None, 1, None), (3, 2, 30), (99, 3, None)], key=str)
    assert common.spread_join(odd.limit(0), single, "k").count() == 0
