"""Row schemas: fields with sheet options, and the plan of physical columns."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

UNORDERED = 2**31 - 1


@dataclass(frozen=True)
class Field:
    """One field of a row.

    ``type``: decimal, bigint, byte, short, int, long, float, double, boolean, date, datetime, string, binary.
    ``heads``: the labels above the column, outermost first; the field's name if there are none.
    """

    name: str
    type: str = "string"
    heads: tuple[str, ...] = ()
    index: int | None = None
    order: int = UNORDERED
    format: str | None = None
    rounding: str = "HALF_UP"
    converter: Any = None
    nullable: bool = True
    ignore: bool = False
    annotated: bool = True
    width: int | None = None
    style: dict | None = None
    options: dict = field(default_factory=dict, hash=False)

    @property
    def labels(self) -> tuple[str, ...]:
        return self.heads or (self.name,)


#: Spark types of field types.
SPARK_TYPES = {
    "decimal": T.DecimalType(38, 18), "bigint": T.DecimalType(38, 0), "byte": T.ByteType(), "short": T.ShortType(), "int": T.IntegerType(), "long": T.LongType(),
    "float": T.FloatType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(), "datetime": T.TimestampNTZType(), "string": T.StringType(), "binary": T.BinaryType(),
    "ubyte": T.ShortType(), "ushort": T.IntegerType(), "uint": T.LongType(), "ulong": T.DecimalType(20, 0),
}
_BACK = {"DecimalType": "decimal", "ByteType": "byte", "ShortType": "short", "IntegerType": "int", "LongType": "long", "FloatType": "float", "DoubleType": "double", "BooleanType": "boolean", "DateType": "date", "TimestampType": "datetime", "TimestampNTZType": "datetime", "StringType": "string", "BinaryType": "binary"}


class Schema:
    """Fields of a row. ``ignore_unannotated`` leaves out fields that carry no options."""

    def __init__(self, fields: list[Field], ignore_unannotated: bool = False):
        names = [f.index for f in fields if f.index is not None and not f.ignore]
        if len(names) != len(set(names)):
            raise ValueError("two fields have the same column index")
        self.fields = fields
        self.used = [f for f in fields if not f.ignore and (f.annotated or not ignore_unannotated)]

    @staticmethod
    def of(struct: T.StructType) -> "Schema":
        """From a Spark schema; options come from the fields' metadata under ``sheet``."""
        fields = []
        for f in struct.fields:
            options = dict(f.metadata.get("sheet", {})) if f.metadata else {}
            if "heads" in options:
                options["heads"] = tuple(options["heads"])
            fields.append(Field(f.name, _BACK.get(type(f.dataType).__name__, "string"), **options))
        return Schema(fields)

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, SPARK_TYPES[f.type], True) for f in self.fields])

    def columns(self) -> list[tuple[int, Field]]:
        """(physical index, field) in physical order.

        Fields with an index keep it; the others, by order and then as declared, take the free indexes.
        """
        forced = {f.index: f for f in self.used if f.index is not None}
        free = iter(i for i in range(len(self.used) + max(forced, default=0) + 1) if i not in forced)
        rest = sorted((f for f in self.used if f.index is None), key=lambda f: f.order)
        return sorted([*forced.items(), *((next(free), f) for f in rest)], key=lambda c: c[0])

    def selected(self, include_names=None, include_indexes=None, exclude_names=(), exclude_indexes=(), by_include_order: bool = False) -> list[tuple[int, Field]]:
        """Columns left by include and exclude lists.

        Includes by name and by index add up, excludes win. ``by_include_order`` takes the order of the
        include list and numbers columns densely; otherwise they stay where they were, with gaps.
        """
        chosen = []
        for i, f in self.columns():
            inside = (include_names is None and include_indexes is None) or f.name in (include_names or ()) or i in (include_indexes or ())
            if inside and f.name not in exclude_names and i not in exclude_indexes:
                chosen.append((i, f))
        if by_include_order and (include_names or include_indexes):
            key = (lambda c: list(include_names).index(c[1].name)) if include_names else (lambda c: list(include_indexes).index(c[0]))
            known = [c for c in chosen if not include_names or c[1].name in include_names]
            return [(i, f) for i, (_, f) in enumerate(sorted(known, key=key))]
        return chosen

    def with_field(self, name: str, **changes) -> "Schema":
        return Schema([replace(f, **changes) if f.name == name else f for f in self.fields])


def sheet_row(ignore_unannotated: bool = False):
    """Decorator: a class with annotated attributes, some of them ``Field``s, as a row schema in ``__sheet__``."""
    kinds = {int: "long", float: "double", str: "string", bool: "boolean", bytes: "binary"}

    def make(cls):
        fields = []
        for name, kind in cls.__annotations__.items():
            given = getattr(cls, name, None)
            base = kind if isinstance(kind, str) else kinds.get(kind, getattr(kind, "__name__", "string"))
            base = {"int": "long", "float": "double", "str": "string", "bool": "boolean", "bytes": "binary", "Decimal": "decimal", "date": "date", "datetime": "datetime"}.get(base, base)
            fields.append(replace(given, name=name, type=base if given.type == "string" else given.type) if isinstance(given, Field) else Field(name, base, annotated=False))
        cls.__sheet__ = Schema(fields, ignore_unannotated)
        return cls

    return make


def head_merges(heads: list[tuple[str, ...]]) -> list[tuple[int, int, int, int]]:
    """(first row, last row, first column, last column) of equal labels above columns.

    Short paths repeat their last label. From each cell not yet covered a run goes right along equal labels,
    then down as long as whole rows below have the same ones.
    """
    depth = max(map(len, heads), default=0)
    grid = [[path[min(r, len(path) - 1)] if path else "" for path in heads] for r in range(depth)]
    covered, out = set(), []
    for r in range(depth):
        for c in range(len(heads)):
            if (r, c) in covered:
                continue
            last_c = c
            while last_c + 1 < len(heads) and grid[r][last_c + 1] == grid[r][c] and (r, last_c + 1) not in covered:
                last_c += 1
            last_r = r
            while last_r + 1 < depth and all(grid[last_r + 1][k] == grid[r][c] and (last_r + 1, k) not in covered for k in range(c, last_c + 1)):
                last_r += 1
            covered.update((i, k) for i in range(r, last_r + 1) for k in range(c, last_c + 1))
            if (last_r, last_c) != (r, c):
                out.append((r, last_r, c, last_c))
    return out
