"""Operations on sheet rows: ``_row`` (zero-based), and a column of cells or texts as an array."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def row_range(rows: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Rows from ``start`` to ``end``, both included."""
    if start is not None and end is not None and start > end:
        raise ValueError("the first row is behind the last")
    if start is not None:
        rows = rows.where(F.col("_row") >= start)
    return rows if end is None else rows.where(F.col("_row") <= end)


def skip_head(rows: DataFrame, head_rows: int) -> DataFrame:
    """Rows behind the head."""
    return rows.where(F.col("_row") >= head_rows)


def trimmed(values: Column) -> Column:
    """An array of texts, each trimmed."""
    return F.transform(values, text.trim)


def not_empty(values: Column) -> Column:
    """Whether an array of texts has one that is not empty."""
    return F.exists(values, lambda v: v.isNotNull() & (v != ""))


def ignore_empty(rows: DataFrame, values: str = "values") -> DataFrame:
    """Rows with something in them, looked at trimmed."""
    return rows.where(not_empty(trimmed(F.col(values))))


def with_missing_rows(rows: DataFrame, last_row: int | None = None, partitions: int | None = None) -> DataFrame:
    """Rows that lie between others, and up to ``last_row``, as rows of nulls.

    The gaps are made where they are: each row makes those before it, back to the one before.
    """
    band = Window.orderBy("_row")
    before = F.coalesce(F.lag("_row").over(band), F.col("_row") - 1)
    ends = rows.select("_row").distinct().select((before + 1).alias("low"), F.col("_row").alias("high"))
    if last_row is not None:
        top = rows.agg(F.max("_row").alias("m")).select((F.col("m") + 1).alias("low"), F.lit(last_row).cast("long").alias("high")).where("low <= high")
        ends = ends.unionByName(top)
    every = ends.select(F.explode(F.sequence("low", "high")).alias("_row"))
    return every.join(rows, "_row", "left")


def head_labels(head: list[str | None], aliases: dict[str, str] | None = None) -> dict[str, int]:
    """Label to column index of a head row: empty labels go, the last of equal ones counts, aliases rename."""
    out = {}
    for i, label in enumerate(head):
        label = (label or "").strip("".join(map(chr, range(33))))
        if label:
            out[(aliases or {}).get(label, label)] = i
    return out


def dynamic_map(values: Column) -> Column:
    """An array of cells as a map of column index to cell."""
    return F.map_from_entries(F.transform(values, lambda v, i: F.struct(i.alias("key"), v.alias("value"))))


def dense(cells_by_index: Column) -> Column:
    """A map of column index to cell as an array up to the last index, nulls where there is none."""
    top = F.array_max(F.map_keys(cells_by_index))
    return F.when(F.size(cells_by_index) > 0, F.transform(F.sequence(F.lit(0), top), lambda i: F.element_at(cells_by_index, i))).otherwise(F.slice(F.map_values(cells_by_index), 1, 0))


def fit_width(values: Column, heads: int) -> Column:
    """A short row filled with nulls up to the head's width; a longer one keeps what lies behind it."""
    lack = F.greatest(F.lit(heads) - F.size(values), F.lit(0))
    return F.concat(values, F.array_repeat(F.lit(None).cast("string"), lack))


def pick(values: Column, indexes: list[int]) -> list[Column]:
    """Columns of an array by index; null beyond its end."""
    return [F.get(values, i) for i in indexes]


def present(rows: DataFrame, row: str = "row") -> DataFrame:
    """``_row`` counted over all rows by the order of ``_pos``, then only those whose struct is there."""
    counted = rows.withColumn("_row", F.row_number().over(Window.orderBy("_pos")) - 1)
    return counted.where(F.col(row).isNotNull())


def union_sheets(sheets: list[tuple[int, str, DataFrame]]) -> DataFrame:
    """Sheets as one table with ``sheet_no`` and ``sheet_name``; columns by name, missing ones null."""
    if not sheets:
        raise ValueError("no sheets to read")
    named = [df.select(F.lit(no).alias("sheet_no"), F.lit(name).alias("sheet_name"), "*") for no, name, df in sheets]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def select_sheets(names: list[str], wanted: list[int | str] | None) -> list[int]:
    """Numbers of the sheets wanted by number or trimmed name, in workbook order; all for None.

    Unknown ones are left out if others are there; if none is there that is an error.
    """
    if wanted is None:
        return list(range(len(names)))
    found = [i for i, n in enumerate(names) if any(w == i if isinstance(w, int) else w.strip() == n.strip() for w in wanted)]
    if not found:
        raise LookupError(f"no such sheet: {wanted}")
    return found
