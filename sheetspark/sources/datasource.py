"""Workbooks as Spark data sources: ``spark.read.format("sheet")`` and ``df.write.format("sheet")``.

For paths that tasks can open as files. Each file is a partition; filters on ``sheet_no``, ``sheet_name``
and ``_row`` are taken into the reading where Spark pushes filters to such sources, and every filter is
handed back, so that Spark applies it again. ``plans.reader`` reads from any store.
"""

from __future__ import annotations

import glob
import os
import uuid

from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from . import decode
from .decode import ReadOptions


def _options(options) -> ReadOptions:
    get = options.get
    number = lambda k: int(get(k)) if get(k) is not None else None
    flag = lambda k, d: (get(k) or d).lower() == "true"
    sheets = [int(x) if x.strip().isdigit() else x for x in get("sheet").split(",")] if get("sheet") else None
    return ReadOptions(
        sheets=sheets, head_rows=number("headRows") if get("headRows") else 1, start_row=number("startRow"), end_row=number("endRow"), trim=flag("trim", "true"),
        ignore_empty=flag("ignoreEmptyRow", "true"), charset=get("charset"), use_1904=flag("use1904", "false"), cache=get("readCache") or "auto", password=get("password"),
    )


class FilePart(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class SheetReader(DataSourceReader):
    """Cells of files, a file in a task."""

    def __init__(self, path: str, options: ReadOptions):
        self.path, self.options = path, options

    def partitions(self):
        found = sorted(f for p in glob.glob(self.path) for f in ([p] if os.path.isfile(p) else glob.glob(os.path.join(p, "*"))) if not os.path.basename(f).startswith(("_", ".")))
        return [FilePart(f) for f in found]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            yield from decode.batches(partition.path, f.read(), self.options)


class PushingReader(SheetReader):
    """With filters on rows and sheets taken along."""

    def pushFilters(self, filters):  # noqa: N802
        from dataclasses import replace

        for f in filters:
            column, value, kind = ".".join(getattr(f, "attribute", ())), getattr(f, "value", None), type(f).__name__
            o = self.options
            if column == "_row" and kind in ("GreaterThan", "GreaterThanOrEqual", "EqualTo"):
                low = value + (kind == "GreaterThan")
                o = replace(o, start_row=low if o.start_row is None or o.end_row is not None and low > o.end_row else max(low, o.start_row))
            if column == "_row" and kind in ("LessThan", "LessThanOrEqual", "EqualTo"):
                high = value - (kind == "LessThan")
                o = replace(o, end_row=high) if (o.end_row is None or high < o.end_row) and (o.start_row is None or high >= o.start_row) else o
            self.options = o
            yield f


class Written(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


class SheetWriter(DataSourceArrowWriter):
    """A workbook from each partition: part files that are renamed once all tasks are done."""

    def __init__(self, path: str, schema: StructType, options):
        self.path, self.schema, self.options, self.run = path, schema, dict(options), uuid.uuid4().hex

    def write(self, iterator):
        from pyspark import TaskContext

        from ..sinks import xlsx

        book = xlsx.Workbook()
        sheet = book.sheet(self.options.get("sheet") or "Sheet1")
        if (self.options.get("needHead") or "true").lower() == "true":
            sheet.write_row(self.schema.names, xlsx.HEAD_STYLE)
        rows = 0
        for batch in iterator:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                sheet.write_row(list(row))
                rows += 1
        if not rows:
            return Written("")
        os.makedirs(self.path, exist_ok=True)
        target = os.path.join(self.path, f"_{self.run}-{TaskContext.get().partitionId():05d}.xlsx")
        with open(target, "wb") as f:
            book.write(f)
        return Written(target)

    def commit(self, messages):
        for m in messages:
            if m and m.path:
                os.replace(m.path, os.path.join(self.path, "part" + os.path.basename(m.path)[33:]))

    def abort(self, messages):
        for m in messages:
            if m and m.path and os.path.exists(m.path):
                os.remove(m.path)


class SheetSource(DataSource):
    """``sheet``: options path, sheet, headRows, startRow, endRow, trim, ignoreEmptyRow, charset, use1904, readCache."""

    @classmethod
    def name(cls):
        return "sheet"

    def schema(self):
        return decode.SCHEMA

    def reader(self, schema):
        from pyspark.sql import SparkSession

        session = SparkSession.getActiveSession()
        pushes = session is not None and session.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true"
        return (PushingReader if pushes else SheetReader)(self.options["path"], _options(self.options))

    def writer(self, schema, overwrite):
        return SheetWriter(self.options["path"], schema, self.options)


def register(spark) -> None:
    """Make ``sheet`` known to a session."""
    spark.dataSource.register(SheetSource)
