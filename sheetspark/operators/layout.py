"""Positions in sheets: widths, pages, merges, style cycles, places of following writes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

MAX_WIDTH = 255


def longest_widths(rows: DataFrame, columns: dict[str, tuple[str, Column]]) -> DataFrame:
    """One row: for each output name the width of (head, text column) in UTF-8 bytes, 255 at most."""
    return rows.agg(*[
        F.least(F.lit(MAX_WIDTH), F.greatest(F.octet_length(F.lit(head)), F.coalesce(F.max(text.byte_length(c)), F.lit(0)))).alias(name)
        for name, (head, c) in columns.items()
    ])


def numbered(rows: DataFrame, order: list[str], name: str = "_at", partitions: int | None = None) -> DataFrame:
    """``rows`` with their place, from 0, in the given order.

    Rows are range-partitioned and counted where they are; only the partitions' counts are added up by a
    window, so no task sees all rows.
    """
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    inside = Window.partitionBy("_p").orderBy(*order)
    counts = placed.groupBy("_p").agg(F.count("*").alias("_n"))
    starts = counts.select("_p", (F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_start"))
    ranked = placed.withColumn("_in", F.row_number().over(inside) - 1)
    return ranked.join(F.broadcast(starts), "_p").withColumn(name, (F.col("_start") + F.col("_in")).cast("long")).drop("_p", "_in", "_start")


def page_batches(at: Column, size: int) -> Column:
    """Number of the batch of ``size`` rows that a place lies in."""
    if size < 1:
        raise ValueError("a batch has a row at least")
    return F.floor(at / size).cast("long")


def loop_merges(rows: DataFrame, strategies: list[tuple[int, int, int]], first_row: int = 0, at: str = "_at") -> DataFrame:
    """Merged ranges (first_row, last_row, first_col, last_col) of (every, column, width), each once.

    A range begins at each row whose place is a multiple of ``every``.
    """
    parts = []
    for every, column, width in strategies:
        if every < 1 or width < 1:
            raise ValueError("a merge needs a row and a column at least")
        begin = F.col(at) + first_row
        parts.append(rows.where(F.col(at) % every == 0).select(
            begin.cast("long").alias("first_row"), (begin + every - 1).cast("long").alias("last_row"),
            F.lit(column).cast("long").alias("first_col"), F.lit(column + width - 1).cast("long").alias("last_col"),
        ))
    return reduce(DataFrame.unionByName, parts).distinct()


def equal_runs(rows: DataFrame, order: str, label: str) -> DataFrame:
    """(grp, c0, c1, lbl): stretches of equal labels in order."""
    band = Window.orderBy(order)
    changed = F.when(F.lag(label).over(band) == F.col(label), 0).otherwise(1)
    grouped = rows.select(F.col(order).alias("i"), F.col(label).alias("lbl"), changed.alias("chg"))
    grouped = grouped.select("i", "lbl", F.sum("chg").over(Window.orderBy("i")).alias("grp"))
    return grouped.groupBy("grp").agg(F.min("i").alias("c0"), F.max("i").alias("c1"), F.min("lbl").alias("lbl"))


def style_cycle(at: Column, styles: int) -> Column:
    """Number of the content style of a place."""
    return (at % styles).cast("long")


def running_position(batch: str, order: str, start: int = 0) -> Column:
    """Place of a row when batches are written one after the other."""
    return (F.row_number().over(Window.orderBy(batch, order)) - 1 + start).cast("long")


def collection_cursor(prefix: str, order: list[str], anchor: Column) -> Column:
    """Row of an item when lists of the same prefix are filled one after the other."""
    return (F.row_number().over(Window.partitionBy(prefix).orderBy(*order)) - 1 + anchor).cast("long")


def absolute_merge(first_row: int, last_row: int, first_col: int, last_col: int) -> tuple[int, int, int, int] | None:
    """A fixed range; any negative number means none."""
    given = (first_row, last_row, first_col, last_col)
    if min(given) < 0:
        return None
    if first_row > last_row or first_col > last_col:
        raise ValueError("a range ends before it begins")
    return given
