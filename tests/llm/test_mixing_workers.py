import random
import re

from sheetspark.llm import mixing


def test_sample_runs_each_function_once(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randint(0, 60))), rng.choice(["a", "b", None]), rng.choice(["en", None])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    drawn = mixing.sample(docs)
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("ArrowEvalPython", plan)) == 1
    assert sorted(r.doc_id for r in drawn.collect()) == [r.doc_id for r in mixing.mix(docs).where("sampled = 1").orderBy("doc_id").collect()]


def test_plan_needs_no_python_workers(spark):
    stats = spark.range(40).selectExpr("concat('s', id % 3) source", "'en' lang", "cast(id % 4 as int) topic", "id + 1 tokens")
    planned = mixing.plan(stats)
    assert "PythonRDD" not in planned._jdf.queryExecution().toRdd().toDebugString()
    assert planned.count() == 12 and planned.dtypes == [("source_class", "string"), ("lang_class", "string"), ("topic", "int"), ("probability", "double")]
    assert mixing.plan(stats.limit(0)).count() == 0
