"""Connected components of a table of links, by rounds of least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import settle, spread_join


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): label is the least node reachable.

    Each round every node, and the node its label names, take the least label next to it; then labels
    are followed one step. Labels only fall, so rounds end when their sum does. Lineage is cut each
    round by a table in the shared folder. No node's links and no label's nodes meet in one task: joins
    deal hot keys over tasks, and minima are taken where the rows are before they are shuffled.
    """
    both = settle(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels, before = _summed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")))
    while before is not None:
        near = (
            spread_join(both, labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
            .join(labels.withColumnRenamed("node", "a"), "a")
        )
        told = F.array(F.struct(F.col("a").alias("node"), F.least("near", "label").alias("label")), F.struct(F.col("label").alias("node"), F.least("near", "label").alias("label")))
        lower = settle(near.select(F.explode(told).alias("x")).select("x.node", "x.label").groupBy("node").agg(F.min("label").alias("label")))
        jumped = spread_join(lower, lower.select(F.col("node").alias("label"), F.col("label").alias("next")), "label").select("node", F.least("label", "next").alias("label"))
        labels, now = _summed(jumped)
        if now == before:
            break
        before = now
    return labels


def _summed(labels: DataFrame) -> tuple[DataFrame, object]:
    """A settled table of labels and their sum, None if there are none."""
    seen = Observation()
    return settle(labels.observe(seen, F.sum(F.col("label").cast("decimal(38,0)")).alias("sum"))), seen.get["sum"]
