"""Template filling on relations: template cells (sheet, row, col, text) and data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .layout import numbered


def fill_scalars(template: DataFrame, values: dict[str, str]) -> DataFrame:
    """Template cells with ``{name}`` replaced; unknown names stay."""
    return template.withColumn("text", text.fill_placeholders(F.col("text"), {k: F.lit(v) for k, v in values.items()}))


def list_cells(template: DataFrame, prefix: str = "") -> DataFrame:
    """Template cells that hold a whole ``{prefix.field}``, with the field's name."""
    pattern = r"^\{" + (prefix.replace(".", r"\.") if prefix else "") + r"\.([^{}\\]+)\}$"
    field = F.regexp_extract("text", pattern, 1)
    return template.select("*", field.alias("field")).where(field != "")


def fill_list(template: DataFrame, data: DataFrame, order: list[str], prefix: str = "", horizontal: bool = False, offset: int = 0) -> DataFrame:
    """(row, col, text) of every list cell for every data row: row ``i`` goes ``i`` below its template cell, or right of it.

    The list cells of a template are few and on the driver; each data row makes its own cells, so data is
    neither joined nor shuffled but for its numbering.
    """
    anchors = [(r["row"], r["col"], r["field"]) for r in list_cells(template, prefix).collect()]
    fields = set(data.columns)
    made = []
    for row, col, name in anchors:
        value = F.col(f"`{name}`").cast("string") if name in fields else F.lit(None).cast("string")
        shift = F.col("_at") + offset
        place = (F.lit(row).cast("long"), F.lit(col) + shift) if horizontal else (F.lit(row) + shift, F.lit(col).cast("long"))
        made.append(F.struct(place[0].cast("long").alias("row"), place[1].cast("long").alias("col"), value.alias("text")))
    if not made:
        return data.sparkSession.createDataFrame([], "row long, col long, text string")
    return numbered(data, order).select(F.explode(F.array(*made)).alias("cell")).select("cell.*")


def shift_rows(cells: DataFrame, anchor: int, items: int) -> DataFrame:
    """Cells below the anchor moved down by the rows that a list of ``items`` adds."""
    return cells.withColumn("row", F.col("row") + F.when(F.col("row") > anchor, max(0, items - 1)).otherwise(0))


def append_rows(cells: DataFrame, rows: DataFrame, order: list[str]) -> DataFrame:
    """Cells, and rows of texts (column ``values``) below the last of them."""
    last = cells.agg(F.max("row").alias("m")).first()["m"]
    begin = 0 if last is None else last + 1
    added = numbered(rows, order).select((F.col("_at") + begin).alias("row"), F.posexplode("values").alias("col", "text")).select("row", F.col("col").cast("long"), "text")
    return cells.select("row", "col", "text").unionByName(added)
