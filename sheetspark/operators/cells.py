"""The universal cell: a struct that holds whatever a sheet's cell holds, and its text forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import dates, numbers

#: Kinds: S string, N number, B boolean, D date, E error; a null struct is an empty cell. A number is there as a
#: decimal, null if it does not fit one, and as a double.
CELL = "struct<kind:string,s:string,n:decimal(38,18),d:double,b:boolean,ts:timestamp_ntz,display:string,formula:string>"


def cell(kind: str, s=None, n=None, b=None, ts=None, display=None, formula=None) -> Column:
    """A cell of the given columns; null if its value is null."""
    values = {"S": s, "N": n, "B": b, "D": ts, "E": s}[kind]
    null = lambda c, t: F.lit(None).cast(t) if c is None else c.cast(t)
    made = F.struct(
        F.lit(kind).alias("kind"), null(s, "string").alias("s"), (F.lit(None) if n is None else n.try_cast(numbers.DECIMAL)).cast(numbers.DECIMAL).alias("n"), null(n, "double").alias("d"), null(b, "boolean").alias("b"),
        null(ts, "timestamp_ntz").alias("ts"), null(display, "string").alias("display"), null(formula, "string").alias("formula"),
    )
    return F.when(values.isNotNull(), made)


def of(value: Column, type_name: str) -> Column:
    """A cell of a column by its field type."""
    if type_name in ("string", "binary"):
        return cell("S", s=value)
    if type_name == "boolean":
        return cell("B", b=value)
    if type_name in ("date", "datetime"):
        return cell("D", ts=value.cast("timestamp_ntz"))
    return cell("N", n=value)


def text(value: Column, type_name: str) -> Column:
    """The text of a value: booleans in small letters, dates by their usual patterns, numbers in plain digits; binary is empty."""
    if type_name == "date":
        return F.date_format(value, "yyyy-MM-dd")
    if type_name == "datetime":
        return F.date_format(value, "yyyy-MM-dd HH:mm:ss")
    if type_name in ("float", "double"):
        return value.cast("string")
    if type_name == "decimal":
        return numbers.plain_string(value)
    if type_name == "binary":
        return F.lit("")
    return value.cast("string")


def number_text(c: Column) -> Column:
    """The digits of a number cell; of one that its decimal does not hold, the double's text."""
    lost = c["n"].isNull() | ((c["n"] == 0) & (c["d"] != 0))
    return F.when(lost, c["d"].cast("string")).otherwise(numbers.plain_string(c["n"]))


def display(c: Column) -> Column:
    """What a cell shows: its display text if it has one, else its value's text."""
    shown = (
        F.when(c["kind"] == "N", number_text(c)).when(c["kind"] == "B", c["b"].cast("string"))
        .when(c["kind"] == "D", F.date_format(c["ts"], "yyyy-MM-dd HH:mm:ss")).otherwise(c["s"])
    )
    return F.coalesce(c["display"], shown)


def actual(c: Column) -> Column:
    """The typed value of a cell as a variant."""
    return (
        F.when((c["kind"] == "N") & c["n"].isNull(), F.to_variant_object(F.struct(c["d"].alias("v")))).when(c["kind"] == "N", F.to_variant_object(F.struct(c["n"].alias("v")))).when(c["kind"] == "B", F.to_variant_object(F.struct(c["b"].alias("v"))))
        .when(c["kind"] == "D", F.to_variant_object(F.struct(c["ts"].alias("v")))).otherwise(F.to_variant_object(F.struct(c["s"].alias("v"))))
    )


def is_empty(c: Column) -> Column:
    """No cell, or an empty text."""
    return c.isNull() | F.coalesce((c["kind"] == "S") & (c["s"] == ""), F.lit(False))


def serial_cell(c: Column, use_1904: bool = False) -> Column:
    """A date cell as the number that a workbook stores."""
    return F.when(c["kind"] == "D", dates.to_serial(c["ts"], use_1904)).otherwise(c["d"])
