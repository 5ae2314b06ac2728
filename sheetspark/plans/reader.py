"""Reading workbooks and delimited files: a builder that ends in a lazy DataFrame.

Files are read as bytes by Spark's own reader, from any store it knows, and decoded in tasks, a file
each; what follows (binding, typing, filters) is Column expressions. Only the head of the first file is
read on the driver, and only where columns are asked for by position.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cells as cells_of
from ..operators import convert
from ..operators.schema import Schema
from ..sources import decode
from ..sources.decode import ReadOptions


class SheetReader:
    """``read(spark, path).sheet("a").schema(s).load()``: every step gives a new reader."""

    def __init__(self, spark: SparkSession, path: str | list[str], options: ReadOptions = ReadOptions(), **more):
        self._spark, self._path, self.options = spark, path, options
        self._schema: Schema | None = more.get("schema")
        self._registry: convert.Registry | None = more.get("registry")
        self._mode: str = more.get("mode", convert.FAIL)
        self._content: bytes | DataFrame | None = more.get("content")

    def _with(self, options: ReadOptions | None = None, **changes) -> "SheetReader":
        kept = {"schema": self._schema, "registry": self._registry, "mode": self._mode, "content": self._content}
        return SheetReader(self._spark, self._path, options or self.options, **kept | changes)

    def option(self, **changes) -> "SheetReader":
        """Any of ``ReadOptions``."""
        return self._with(replace(self.options, **changes))

    def sheet(self, *wanted: int | str) -> "SheetReader":
        """Sheets by number or name; none: all."""
        return self.option(sheets=list(wanted) or None)

    def head_rows(self, n: int) -> "SheetReader":
        return self.option(head_rows=n)

    def rows(self, start: int | None = None, end: int | None = None) -> "SheetReader":
        return self.option(start_row=start, end_row=end)

    def alias(self, **names: str) -> "SheetReader":
        return self.option(aliases={**self.options.aliases, **names})

    def schema(self, schema: Schema | type) -> "SheetReader":
        """A schema, or a class made by ``sheet_row``."""
        return self._with(schema=getattr(schema, "__sheet__", schema))

    def converters(self, registry: convert.Registry) -> "SheetReader":
        return self._with(registry=registry)

    def on_error(self, mode: str) -> "SheetReader":
        """PERMISSIVE, DROPMALFORMED or FAILFAST."""
        return self._with(mode=mode)

    def _files(self) -> DataFrame:
        if isinstance(self._content, DataFrame):
            return self._content.select("path", "content")
        if self._content is not None:
            return self._spark.createDataFrame([("bytes", bytearray(self._content))], "path string, content binary")
        return self._spark.read.format("binaryFile").load(self._path).select("path", "content")

    def raw(self, labels: list[str | int] | None = None, head_only: bool = False) -> DataFrame:
        """(file, sheet_no, sheet_name, _row, cells): decoded cells, those of ``labels`` if given."""
        options = self.options

        def run(batches):
            for batch in batches:
                for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                    yield from decode.batches(path, content.as_py(), options, labels, head_only)

        return self._files().mapInArrow(run, decode.SCHEMA)

    def heads(self) -> DataFrame:
        """The rows of heads, as texts: what a listener of heads would see."""
        shown = F.transform("cells", cells_of.display)
        return self.raw(head_only=True).select("file", "sheet_no", "sheet_name", "_row", shown.alias("labels"))

    def cells(self) -> DataFrame:
        """Rows with an array of universal cells."""
        return self.raw()

    def dynamic(self, form: str = "STRING") -> DataFrame:
        """Rows without a schema, as maps of column index: STRING what cells show, ACTUAL typed values, CELL structs."""
        from ..operators.rows import dynamic_map

        value = {"STRING": cells_of.display, "ACTUAL": cells_of.actual, "CELL": lambda c: c}[form]
        made = self.cells()
        return made.select("file", "sheet_no", "sheet_name", "_row", dynamic_map(F.transform("cells", lambda c: value(c))).alias("values"))

    def load(self, keep: tuple[str, ...] = ()) -> DataFrame:
        """Typed rows; ``keep`` adds columns of file, sheet_no, sheet_name, _row. Without a schema: texts by head."""
        schema = self._schema or self._from_head()
        fields = [f for f in schema.fields if f in schema.used]
        labels = [f.index if f.index is not None else f.labels[-1] for f in fields]
        raw = self.raw(labels)
        wide = raw.select(*keep, *[F.get("cells", i).alias(f"_c{i}") for i in range(len(fields))])
        columns = [(f"_c{fields.index(f)}" if f in fields else None, f) for f in schema.fields]
        return convert.bind(wide, columns, self._registry, self._mode, self.options.use_1904, keep)

    def _from_head(self) -> Schema:
        from ..operators.schema import Field

        first = self.heads().orderBy("file", "sheet_no", F.desc("_row")).first()
        labels = first["labels"] if first else []
        names = {self.options.aliases.get(x, x): i for i, x in enumerate(labels) if x}
        return Schema([Field(n, index=i) for n, i in names.items()])

    def extras(self, *kinds: str) -> DataFrame:
        """Merges, links and notes: (file, sheet_no, sheet_name, type, text, first_row, last_row, first_col, last_col)."""
        options, wanted = self.options, set(kinds)

        def run(batches):
            for batch in batches:
                for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                    yield decode.extras(path, content.as_py(), options, wanted)

        return self._files().mapInArrow(run, decode.EXTRAS)

    def sheets(self) -> DataFrame:
        """(file, sheet_no, sheet_name) of all sheets."""
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                    names = decode.sheet_names(content.as_py())
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(names)), pa.array(range(len(names)), pa.int32()), pa.array(names)], ["file", "sheet_no", "sheet_name"])

        return self._files().mapInArrow(run, "file string, sheet_no int, sheet_name string")

    def collect(self) -> list:
        return self.load().collect()


def read(spark: SparkSession, path: str | list[str]) -> SheetReader:
    """A reader of the files of a path, a folder, a pattern or a list of these."""
    return SheetReader(spark, path)


def read_bytes(spark: SparkSession, content: bytes) -> SheetReader:
    """A reader of one file's bytes, such as an upload."""
    return SheetReader(spark, "", content=content)


def read_files(files: DataFrame) -> SheetReader:
    """A reader of files that are rows of a table (path, content)."""
    return SheetReader(files.sparkSession, "", content=files)


def read_sheets(reader: SheetReader, schemas: dict[int | str, Schema], keep: tuple[str, ...] = ()) -> DataFrame:
    """Sheets with a schema each as one table with sheet_no and sheet_name."""
    from functools import reduce

    if not schemas:
        raise ValueError("no sheets to read")
    parts = [reader.sheet(which).schema(s).load(("sheet_no", "sheet_name", *keep)) for which, s in schemas.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
