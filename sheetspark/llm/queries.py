"""The queries of this subpackage over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import extract, media, mixing, packing, pii, quality, simhash, topk, toxicity, urlfilter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), urlfilter.RULES, evidence=urlfilter.page_evidence)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels, categories = toxicity.category_labels(table(spark, sf_dir, "labels"))
    return toxicity.classify(docs, toxicity.train(docs, labels, categories))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_urlfilter": op1_urlfilter, "op2_mixing": op2_mixing, "op3_simhash": op3_simhash, "op4_extract": op4_extract, "op5_media": op5_media, "op6_packing": op6_packing, "op7_pii": op7_pii, "op8_quality": op8_quality, "op9_toxicity": op9_toxicity, "op10_topk": op10_topk}


OP10_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id as vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id
), ranked as (
  select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as "rank" from scored
)
select query_id, "rank", vec_id, score from ranked where "rank" <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_urlfilter": urlfilter.oracle_sql(), "op10_topk": OP10_SQL}
