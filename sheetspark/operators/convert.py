"""Converters between cells and values: a registry of (type, cell kind) to Column builders.

The later registration wins, a field's own converter wins over all. A builder takes the cell struct and a
context and returns the value, null where the cell can't be converted; ``read`` turns those nulls into
errors with the cell's place, so that rows can be kept, dropped or refused.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, numbers, text
from . import cells
from .schema import SPARK_TYPES, Field, Schema


@dataclass(frozen=True)
class Context:
    """What a conversion may depend on."""

    format: str | None = None
    rounding: str = "HALF_UP"
    use_1904: bool = False


Reader = Callable[[Column, Context], Column]
Writer = Callable[[Column, Context], Column]
BITS = {"byte": 8, "short": 16, "int": 32, "long": 64}


def _narrow(type_name: str) -> Callable[[Column], Column]:
    """A decimal as a type of numbers: signed integers truncate and wrap, bigint truncates."""
    if type_name in BITS:
        return lambda d: numbers.wrap(d, BITS[type_name])
    if type_name == "bigint":
        return numbers.truncate
    return lambda d: d.cast(SPARK_TYPES[type_name])


def _from_text(c: Column, ctx: Context) -> Column:
    return numbers.parse_by_pattern(c, ctx.format) if ctx.format else numbers.parse_decimal(c)


def _number_text(type_name: str) -> Writer:
    def write(v: Column, ctx: Context) -> Column:
        return numbers.format_decimal(v, ctx.format, ctx.rounding) if ctx.format else cells.text(v, type_name)

    return write


def _strict(type_name: str) -> tuple[Reader, Reader]:
    """Unsigned integers: no fractions, no negative numbers, nothing out of range."""
    top = {"ubyte": 8, "ushort": 16, "uint": 32, "ulong": 64}[type_name]

    def fit(d: Column) -> Column:
        limit = F.lit(str((1 << top) - 1)).cast(numbers.WHOLE)
        return F.when((d == F.floor(d)) & (d >= 0) & (d <= limit), F.floor(d).cast(SPARK_TYPES[type_name]))

    return (lambda c, x: fit(c["n"])), (lambda c, x: fit(F.when(c["s"].rlike(r"^\+?[0-9]+$"), c["s"].try_cast(numbers.WHOLE))))


@dataclass
class Registry:
    """Builders by (type, kind) for reading and by (type, target) for writing; ``target`` is cell or string."""

    readers: dict[tuple[str, str], Reader] = field(default_factory=dict)
    writers: dict[tuple[str, str], Writer] = field(default_factory=dict)
    #: What is done last, once, to what any reader of a type gives; such readers give decimals.
    finish: dict[str, Callable[[Column], Column]] = field(default_factory=dict)

    def register_reader(self, type_name: str, kind: str, build: Reader) -> "Registry":
        self.readers[type_name, kind] = build
        return self

    def register_writer(self, type_name: str, target: str, build: Writer) -> "Registry":
        self.writers[type_name, target] = build
        return self

    def copy(self) -> "Registry":
        return Registry(dict(self.readers), dict(self.writers), dict(self.finish))


def default_registry() -> Registry:
    """All built-in converters."""
    r = Registry()
    for t in ("decimal", "bigint", "byte", "short", "int", "long", "float", "double"):
        r.finish[t] = _narrow(t)
        r.register_reader(t, "B", lambda c, x: F.when(c["b"], 1).otherwise(0).cast(numbers.DECIMAL))
        r.register_reader(t, "N", lambda c, x: c["n"])
        r.register_reader(t, "S", lambda c, x: _from_text(c["s"], x))
        r.register_writer(t, "cell", lambda v, x: cells.cell("N", n=v))
        r.register_writer(t, "boolean", lambda v, x: cells.cell("B", b=v == 1))
        r.register_writer(t, "string", _number_text(t))
    for t in ("float", "double"):  # not through decimals, which hold neither large nor tiny ones
        del r.finish[t]
        to = SPARK_TYPES[t]
        r.register_reader(t, "B", lambda c, x, to=to: F.when(c["b"], 1).otherwise(0).cast(to))
        r.register_reader(t, "N", lambda c, x, to=to: c["d"].cast(to))
        r.register_reader(t, "S", lambda c, x, to=to: (numbers.parse_by_pattern(c["s"], x.format).cast("double") if x.format else numbers.parse_double(c["s"])).cast(to))
    for t in ("ubyte", "ushort", "uint", "ulong"):
        by_number, by_text = _strict(t)
        r.register_reader(t, "N", by_number).register_reader(t, "S", by_text)
        r.register_reader(t, "B", lambda c, x, t=t: F.when(c["b"], 1).otherwise(0).cast(SPARK_TYPES[t]))
        r.register_writer(t, "cell", lambda v, x: cells.cell("N", n=v)).register_writer(t, "string", _number_text("long"))
    r.register_reader("boolean", "B", lambda c, x: c["b"])
    r.register_reader("boolean", "N", lambda c, x: c["d"] == 1)
    r.register_reader("boolean", "S", lambda c, x: text.boolean_value(c["s"]))
    r.register_writer("boolean", "cell", lambda v, x: cells.cell("B", b=v))
    r.register_writer("boolean", "number", lambda v, x: cells.cell("N", n=F.when(v, 1).otherwise(0)))
    r.register_writer("boolean", "string", lambda v, x: v.cast("string"))
    for t, parse, pattern in (("date", dates.parse_date, "yyyy-MM-dd"), ("datetime", dates.parse_datetime, "yyyy-MM-dd HH:mm:ss")):
        spark_type = SPARK_TYPES[t]
        r.register_reader(t, "N", lambda c, x, s=spark_type: F.coalesce(c["ts"], dates.from_serial(c["n"], x.use_1904)).cast(s))
        r.register_reader(t, "S", lambda c, x, p=parse: p(c["s"], x.format))
        r.register_reader(t, "D", lambda c, x, s=spark_type: c["ts"].cast(s))
        r.register_writer(t, "cell", lambda v, x: cells.cell("D", ts=v))
        r.register_writer(t, "number", lambda v, x: cells.cell("N", n=dates.to_serial(v, x.use_1904)))
        r.register_writer(t, "string", lambda v, x, p=pattern: dates.format_datetime(v, x.format or p))
    r.register_reader("string", "S", lambda c, x: c["s"])
    r.register_reader("string", "B", lambda c, x: c["b"].cast("string"))
    r.register_reader("string", "N", _number_as_text)
    r.register_reader("string", "D", lambda c, x: dates.format_datetime(c["ts"], x.format if _shows_dates(x.format) else "yyyy-MM-dd HH:mm:ss"))
    r.register_reader("string", "E", lambda c, x: c["s"])
    r.register_writer("string", "cell", lambda v, x: cells.cell("S", s=v))
    r.register_writer("string", "number", lambda v, x: cells.cell("N", n=_from_text(v, x)))
    r.register_writer("string", "boolean", lambda v, x: cells.cell("B", b=v == "true"))
    r.register_writer("string", "error", lambda v, x: cells.cell("E", s=v))
    r.register_writer("string", "string", lambda v, x: v)
    r.register_reader("binary", "S", lambda c, x: F.unbase64(c["s"]))
    r.register_writer("binary", "string", lambda v, x: F.lit(""))
    r.register_writer("binary", "cell", lambda v, x: cells.cell("S", s=F.base64(v)))
    return r


def _number_as_text(c: Column, ctx: Context) -> Column:
    """A date pattern shows the number as a date, a decimal pattern formats it; else what the cell shows."""
    if not ctx.format:
        return cells.display(c)
    if _shows_dates(ctx.format):
        return dates.format_datetime(dates.from_serial(c["n"], ctx.use_1904), ctx.format)
    return numbers.format_decimal(c["n"], ctx.format, ctx.rounding)


def _shows_dates(pattern: str | None) -> bool:
    """Whether a pattern is one of dates: by signs outside quotes that only those have."""
    plain = "".join(part for i, part in enumerate((pattern or "").split("'")) if i % 2 == 0)
    return any(mark in plain for mark in ("y", "d", "h", "H", "s", "%Y", "%m", "%H"))


def loose_boolean(c: Column) -> Column:
    """Fallback without a registered converter: non-zero is true; true and 1, false and 0 as text; null otherwise."""
    return (
        F.when(c["kind"] == "B", c["b"]).when(c["kind"] == "N", c["d"] != 0)
        .when(F.lower(c["s"]).isin("true", "1"), True).when(F.lower(c["s"]).isin("false", "0"), False)
    )


def read_value(c: Column, f: Field, registry: Registry, use_1904: bool = False) -> Column:
    """The value of a cell for a field; null if there is no cell or no converter makes anything of it."""
    ctx = Context(f.format, f.rounding, use_1904)
    finish = registry.finish.get(f.type)
    kind_of = numbers.DECIMAL if finish else SPARK_TYPES[f.type]
    out = F.lit(None).cast(kind_of)
    if f.converter is not None:
        return f.converter(c, ctx).cast(SPARK_TYPES[f.type])
    for (t, kind), build in registry.readers.items():
        if t == f.type:
            out = F.when(c["kind"] == kind, build(c, ctx).cast(kind_of)).otherwise(out)
    return finish(out) if finish else out


def write_value(v: Column, f: Field, registry: Registry, target: str = "cell", use_1904: bool = False) -> Column:
    """A value as a cell, or as text for target ``string``."""
    build = registry.writers.get((f.type, target)) or registry.writers[f.type, "cell"]
    return build(v, Context(f.format, f.rounding, use_1904))


#: What becomes of rows with a cell that can't be converted.
PERMISSIVE, DROP, FAIL = "PERMISSIVE", "DROPMALFORMED", "FAILFAST"


def bind(rows: DataFrame, columns: list[tuple[str | None, Field]], registry: Registry | None = None, mode: str = FAIL, use_1904: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed rows of cell columns: ``columns`` gives each field's cell column, None for a field without one.

    A cell that no converter makes a value of is an error. PERMISSIVE keeps such rows with a null there and
    a struct ``_error``; DROPMALFORMED leaves them out; FAILFAST raises. Empty cells are null, an empty text
    for strings that aren't nullable.
    """
    registry = registry or default_registry()
    read, errors, values, flags = [], [], [], []
    for i, (name, f) in enumerate(columns):
        if name is None or f.ignore:
            values.append(F.lit(None).cast(SPARK_TYPES[f.type]).alias(f.name))
            continue
        c, value = F.col(f"`{name}`"), F.col(f"_v{i}")
        missing = c.isNull() if f.type == "string" else cells.is_empty(c)
        read += [read_value(c, f, registry, use_1904).alias(f"_v{i}"), cells.display(c).alias(f"_d{i}")]
        flags.append(missing)
        missing = F.get("_m", F.lit(len(flags) - 1))
        shown = F.col(f"_d{i}")
        place = {
            PERMISSIVE: F.struct(F.lit(name).alias("column"), F.lit(f.name).alias("field"), shown.alias("value"), F.lit(f"not a {f.type}").alias("message")),
            FAIL: F.concat(F.lit(f"cell of {f.name}: not a {f.type}: "), F.coalesce(shown, F.lit(""))), DROP: F.lit(True),
        }[mode]
        errors.append(F.when(~missing & value.isNull(), place))
        if not f.nullable:
            if f.type == "string":
                value = F.coalesce(value, F.lit(""))
            else:
                errors.append(F.when(missing, place))
        values.append(value.alias(f.name))
    # a function of functions, so that Spark compiles each conversion on its own: together they are a method too large for
    # the JVM's compiler; not deterministic, so that the optimiser doesn't do the conversions once more for the filter
    read.append(F.when(F.spark_partition_id() >= 0, F.transform(F.array(*flags).cast("array<boolean>"), lambda flag: flag)).alias("_m"))
    # values first, then what is said of them: so each is computed once
    empty = {PERMISSIVE: "struct<column:string,field:string,value:string,message:string>", FAIL: "string", DROP: "boolean"}[mode]
    bound = rows.select(*keep, *read).select(*keep, *values, F.coalesce(*errors, F.lit(None).cast(empty)).alias("_error"))
    if mode == PERMISSIVE:
        return bound
    said = F.col("_error").isNull() if mode == DROP else F.when(F.col("_error").isNotNull(), F.raise_error(F.col("_error")).isNull()).otherwise(True)
    return bound.where(said).drop("_error")


def schema_columns(schema: Schema, heads: dict[str, str], names: list[str]) -> list[tuple[str | None, Field]]:
    """Which cell column each field reads: its index first, then its head, else none.

    ``heads`` maps labels to cell columns, ``names`` are the cell columns by index.
    """
    out = []
    for f in schema.fields:
        if f.ignore or f not in schema.used:
            out.append((None, f))
        elif f.index is not None:
            out.append((names[f.index] if f.index < len(names) else None, f))
        else:
            out.append((heads.get(f.labels[-1]), f))
    return out
