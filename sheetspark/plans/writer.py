"""Writing workbooks and delimited files: a builder over DataFrames.

Values become texts or typed cells as Column expressions; a sheet is one ordered stream, as its format
demands, and a sheet's rows are bounded by the format. Many files are written at once in tasks: a table of any
length by ranges of its order (``SheetWriter.files``), a workbook for each group of rows (``workbooks``), delimited
files without heads by Spark's text writer (``csv_parts``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import convert, layout
from ..operators.schema import Schema, head_merges
from ..sinks import xls as xls_sink
from ..sinks import xlsx as xlsx_sink
from ..sources import csv as csv_source

#: Rows of each of many files; a sheet that holds fewer has fewer.
ROWS_EACH = 100_000


@dataclass
class WriteOptions:
    """Of a sheet or, in it, of a table."""

    sheet: str = "Sheet1"
    need_head: bool = True
    head_at: int = 0
    include: list[str] | None = None
    include_indexes: list[int] | None = None
    exclude: tuple[str, ...] = ()
    exclude_indexes: tuple[int, ...] = ()
    by_include_order: bool = False
    heads: list[tuple[str, ...]] | None = None
    merge_head: bool = True
    loop_merges: list[tuple[int, int, int]] = field(default_factory=list)
    merges: list[tuple[int, int, int, int]] = field(default_factory=list)
    widths: dict[int, float] = field(default_factory=dict)
    auto_width: bool = False
    head_height: float | None = None
    content_height: float | None = None
    head_style: xlsx_sink.Style | None = xlsx_sink.HEAD_STYLE
    content_styles: list[xlsx_sink.Style] = field(default_factory=list)
    column_styles: dict[str, xlsx_sink.Style] = field(default_factory=dict)
    freeze_head: bool = False
    freeze: tuple[int, int] | None = None
    auto_filter: bool = False
    use_1904: bool = False
    trim: bool = False
    validations: dict[str, list[str]] = field(default_factory=dict)
    handlers: list = field(default_factory=list)


class Handler:
    """Hooks of writing, all doing nothing. ``order`` sorts handlers; of those with an equal ``unique`` the first stays."""

    order = 0
    unique: str | None = None

    def before_sheet(self, sheet: xlsx_sink.Sheet) -> None: ...
    def after_sheet(self, sheet: xlsx_sink.Sheet) -> None: ...
    def before_row(self, sheet: xlsx_sink.Sheet, row: int, is_head: bool) -> None: ...
    def after_row(self, sheet: xlsx_sink.Sheet, row: int, is_head: bool) -> None: ...

    def cell(self, value, row: int, col: int, is_head: bool):
        """The value to write instead; ``SKIP`` leaves the cell out."""
        return value

    def style(self, style, value, row: int, col: int, is_head: bool):
        return style


SKIP = object()


def effective_handlers(handlers: list[Handler]) -> list[Handler]:
    """By order, the first of equal unique values."""
    seen, out = set(), []
    for h in sorted(handlers, key=lambda h: h.order):
        if h.unique is None or h.unique not in seen:
            out.append(h)
            seen.add(h.unique)
    return out


def string_rows(df: DataFrame, columns: list[tuple[int, object]], registry: convert.Registry | None = None, use_1904: bool = False) -> DataFrame:
    """(values): each row's texts by physical column; gaps are empty texts."""
    registry = registry or convert.default_registry()
    width = max((i for i, _ in columns), default=-1) + 1
    by = {i: F.coalesce(convert.write_value(F.col(f"`{f.name}`"), f, registry, "string", use_1904), F.lit("")) for i, f in columns}
    return df.select(F.array(*[by.get(i, F.lit("")) for i in range(width)]).alias("values"))


def csv_lines(df: DataFrame, columns: list[tuple[int, object]], registry: convert.Registry | None = None) -> DataFrame:
    """(value): each row as a record, quoted where needed, in JVM expressions."""
    quoted = lambda v: F.when(v.rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)
    rows = string_rows(df, columns, registry)
    line = F.array_join(F.transform("values", quoted), ",")
    return rows.select(F.when(line == "", '""').otherwise(line).alias("value"))


def head_grid(columns: list[tuple[int, object]], heads: list[tuple[str, ...]] | None = None) -> list[list[str]]:
    """Rows of labels above the physical columns; short paths repeat their last label, gaps are empty."""
    width = max((i for i, _ in columns), default=-1) + 1
    paths: list[tuple[str, ...]] = [("",)] * width
    for at, (i, f) in enumerate(columns):
        paths[i] = tuple(heads[at]) if heads else f.labels
    depth = max(map(len, paths), default=0)
    return [[p[min(r, len(p) - 1)] for p in paths] for r in range(depth)]


class SheetWriter:
    """``write(df).schema(s).options(...)`` then ``to_csv``, ``to_xlsx`` or ``to_xls``."""

    def __init__(self, df: DataFrame, order: list[str] | None = None, schema: Schema | None = None, options: WriteOptions | None = None, registry: convert.Registry | None = None):
        self.df, self.order = df, order
        self.schema = getattr(schema, "__sheet__", schema) or Schema.of(df.schema)
        self.options, self.registry = options or WriteOptions(), registry or convert.default_registry()

    def columns(self) -> list[tuple[int, object]]:
        o = self.options
        return self.schema.selected(o.include, o.include_indexes, o.exclude, o.exclude_indexes, o.by_include_order)

    def _ordered(self) -> DataFrame:
        return self.df.orderBy(*self.order) if self.order else self.df

    # --- delimited -------------------------------------------------------------------------------

    def csv_parts(self, path: str) -> None:
        """Many files without heads, written by Spark in parallel."""
        csv_lines(self.df, self.columns(), self.registry).write.mode("overwrite").text(path)

    def csv_chunks(self, charset: str = "utf-8", with_bom: bool = True) -> Iterator[bytes]:
        """One file's bytes in order; one partition at a time is on the driver."""
        lines = csv_lines(self._ordered(), self.columns(), self.registry).toLocalIterator(prefetchPartitions=True)
        return self._csv((r["value"] for r in lines), charset, with_bom)

    def _csv(self, lines: Iterator[str], charset: str, with_bom: bool) -> Iterator[bytes]:
        """The bytes of a file with the head and these records."""
        name = csv_source.charset_name(charset)
        if with_bom:
            yield csv_source.byte_order_mark(charset)
        end = "\r\n"
        if self.options.need_head:
            for row in head_grid(self.columns(), self.options.heads):
                yield (",".join(map(csv_source.quote, row)) + end).encode(name, "replace")
        for line in lines:
            yield (line + end).encode(name, "replace")

    def to_csv(self, charset: str = "utf-8", with_bom: bool = True) -> bytes:
        return b"".join(self.csv_chunks(charset, with_bom))

    def save_csv(self, path: str, charset: str = "utf-8", with_bom: bool = True) -> None:
        save(self.df.sparkSession, path, self.csv_chunks(charset, with_bom))

    # --- workbooks -------------------------------------------------------------------------------

    def _values(self) -> DataFrame:
        """Values as a workbook takes them: dates stay dates, numbers numbers, and user converters' cells their value."""
        picked = []
        for _, f in self.columns():
            c = F.col(f"`{f.name}`")
            if f.type == "string" and self.options.trim:
                from ..functions.text import trim

                c = trim(c)
            picked.append(c.alias(f.name))
        return self._ordered().select(*picked)

    def write_into(self, sheet: xlsx_sink.Sheet, rows: Iterator | None = None) -> None:
        """Head and rows of this table behind what the sheet has."""
        o, columns = self.options, self.columns()
        handlers = effective_handlers(o.handlers)
        width = max((i for i, _ in columns), default=-1) + 1
        grid = head_grid(columns, o.heads) if o.need_head else []
        longest = {i: 0 for i, _ in columns}

        def put(values: list, styles: list, is_head: bool, height) -> int:
            at = sheet.next_row
            for h in handlers:
                h.before_row(sheet, at, is_head)
                for col, v in enumerate(values):
                    new = h.cell(v, at, col, is_head)
                    values[col] = None if new is SKIP else new
                    styles[col] = None if new is SKIP else h.style(styles[col], values[col], at, col, is_head)
            sheet.write_row(values, styles, height=height)
            for h in handlers:
                h.after_row(sheet, at, is_head)
            return at

        for h in handlers:
            h.before_sheet(sheet)
        first = sheet.next_row + o.head_at
        sheet.next_row = first
        for row in grid:
            put(list(row), [o.head_style if i in longest else None for i in range(width)], True, o.head_height)
            for i in longest:
                longest[i] = max(longest[i], len(row[i].encode()))
        if grid and o.merge_head:
            paths = [tuple(g[i] for g in grid) for i in range(width)]
            for r0, r1, c0, c1 in head_merges(paths):
                if grid[r0][c0]:
                    sheet.merge(first + r0, first + r1, c0, c1)
        begin = sheet.next_row
        by_column = {i: o.column_styles.get(f.name) or (xlsx_sink.Style(**f.style) if f.style else xlsx_sink.Style(number_format=f.format) if f.format else None) for i, f in columns}
        for n, r in enumerate(rows if rows is not None else self._values().toLocalIterator(prefetchPartitions=True)):
            values: list = [None] * width
            for (i, _), v in zip(columns, r):
                values[i] = bytes(v) if isinstance(v, bytearray) else v
            values = [xlsx_sink.Image(v) if isinstance(v, bytes) else v for v in values]
            cycle = o.content_styles[n % len(o.content_styles)] if o.content_styles else None
            at = put(values, [by_column.get(i) or cycle for i in range(width)], False, o.content_height)
            for every, col, wide in o.loop_merges:
                if n % every == 0:
                    sheet.merge(at, at + every - 1, col, col + wide - 1)
            if o.auto_width:
                for i in longest:
                    if values[i] is not None:
                        longest[i] = max(longest[i], len(str(values[i]).encode()))
        for given in o.merges:
            if (area := layout.absolute_merge(*given)) is not None:
                sheet.merge(*area)
        widths = {i: min(255, n) for i, n in longest.items()} if o.auto_width else {}
        sheet.options.widths |= widths | {i: f.width for i, f in columns if f.width} | o.widths
        if o.freeze or o.freeze_head and grid:
            sheet.options.freeze = o.freeze or (begin, 0)
        if o.auto_filter and grid and width:
            sheet.options.auto_filter = (begin - 1, max(begin - 1, sheet.next_row - 1), 0, width - 1)
        for i, f in columns:
            if choices := o.validations.get(f.name) or f.options.get("choices"):
                sheet.validate((begin, 1048575, i, i), choices)
        for h in handlers:
            h.after_sheet(sheet)

    def to_xlsx(self, rows: Iterator | None = None) -> bytes:
        book = xlsx_sink.Workbook(self.options.use_1904)
        self.write_into(book.sheet(self.options.sheet), rows)
        return book.finish()

    def to_xls(self, rows: Iterator | None = None) -> bytes:
        """A legacy workbook: values, number formats, merges and widths."""
        o, columns = self.options, self.columns()
        book = xls_sink.Book(o.use_1904)
        sheet = book.sheet(o.sheet)
        width = max((i for i, _ in columns), default=-1) + 1
        grid = head_grid(columns, o.heads) if o.need_head else []
        for row in grid:
            sheet.write_row(row)
        if grid and o.merge_head:
            for area in head_merges([tuple(g[i] for g in grid) for i in range(width)]):
                sheet.merge(*area)
        codes: list = [None] * width
        for i, f in columns:
            codes[i] = f.format
        for n, r in enumerate(rows if rows is not None else self._values().toLocalIterator(prefetchPartitions=True)):
            values: list = [None] * width
            for (i, _), v in zip(columns, r):
                values[i] = v
            at = sheet.write_row(values, codes)
            for every, col, wide in o.loop_merges:
                if n % every == 0:
                    sheet.merge(at, at + every - 1, col, col + wide - 1)
        sheet.widths |= o.widths
        return book.finish()

    def files(self, kind: str, rows_each: int = ROWS_EACH, charset: str = "utf-8", with_bom: bool = True) -> DataFrame:
        """(path, content): the table as files of ``kind`` (csv, xlsx, xls), each with the head, written in tasks.

        Rows are in order within files and from file to file, as paths sort. A file has ``rows_each`` rows at most,
        or what its format's sheet holds, so a task holds no more than that of a table of any length. A table
        without rows gives no files.
        """
        o = self.options
        if o.loop_merges or o.merges:
            raise ValueError("merged rows can't be cut into files")
        limit = {"csv": None, "xlsx": xlsx_sink.MAX_ROWS, "xls": xls_sink.MAX_ROWS}[kind]
        if limit is not None:
            rows_each = min(rows_each, limit - o.head_at - (len(head_grid(self.columns(), o.heads)) if o.need_head else 0))
        table = csv_lines(self._ordered(), self.columns(), self.registry) if kind == "csv" else self._values()
        zoned = [f.name for f in table.schema if f.dataType.typeName() == "timestamp"]
        table = table.withColumns({name: F.col(f"`{name}`").cast("timestamp_ntz") for name in zoned}) if zoned else table
        # tasks take the plan without its tables
        plan = SheetWriter.__new__(SheetWriter)
        plan.df, plan.order, plan.schema, plan.options, plan.registry = None, None, self.schema, o, None

        def run(batches):
            import itertools

            import pyarrow as pa
            from pyspark import TaskContext

            rows = (r for b in batches for r in (b.column(0).to_pylist() if kind == "csv" else zip(*(c.to_pylist() for c in b.columns))))
            for n in itertools.count():
                part = list(itertools.islice(rows, rows_each))
                if not part:
                    return
                content = b"".join(plan._csv(iter(part), charset, with_bom)) if kind == "csv" else plan.to_xlsx(iter(part)) if kind == "xlsx" else plan.to_xls(iter(part))
                yield pa.RecordBatch.from_arrays([pa.array([f"part-{TaskContext.get().partitionId():06d}-{n:06d}.{kind}"]), pa.array([content], pa.binary())], ["path", "content"])

        return table.mapInArrow(run, "path string, content binary")

    def save_xlsx(self, path: str) -> None:
        save(self.df.sparkSession, path, iter([self.to_xlsx()]))


def write(df: DataFrame, order: list[str] | None = None, schema: Schema | None = None, registry: convert.Registry | None = None, **options) -> SheetWriter:
    """A writer of a DataFrame; ``order`` gives the rows' order, options are those of ``WriteOptions``."""
    return SheetWriter(df, order, schema, WriteOptions(**options), registry)


class Workbook:
    """Several writes into one workbook: the same sheet again appends without a new head."""

    def __init__(self, use_1904: bool = False, on_error: str = "discard", password: str | None = None):
        self.book, self.on_error = xlsx_sink.Workbook(use_1904, password=password), on_error
        self.headed: set[str] = set()

    def __enter__(self) -> "Workbook":
        return self

    def __exit__(self, kind, *_):
        if kind is not None and self.on_error == "discard":
            self.book.sheets.clear()
        return False

    def write(self, writer: SheetWriter, table: bool = False) -> "Workbook":
        """``table``: with its own head even where the sheet has one."""
        from dataclasses import replace

        name = writer.options.sheet
        if name in self.headed and not table:
            writer = SheetWriter(writer.df, writer.order, writer.schema, replace(writer.options, need_head=False, head_at=0), writer.registry)
        writer.write_into(self.book.sheet(name))
        self.headed.add(name)
        return self

    def finish(self) -> bytes:
        return self.book.finish()


def workbooks(df: DataFrame, by: str, order: list[str], schema: Schema | None = None, **options) -> DataFrame:
    """(key, part, content): a workbook for every value of ``by``, written in tasks.

    Rows of a key are cut into parts of a sheet's limit, so no task holds more than a sheet's rows, however
    many a key has; keys beyond one sheet give several workbooks.
    """
    from pyspark.sql import Window

    rows_each = 1_000_000
    inner = [c for c in df.columns if c != by]
    ranked = df.withColumn("_part", F.floor((F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1) / rows_each).cast("int"))
    plan = WriteOptions(**options)
    own = schema or Schema.of(df.select(*inner).schema)

    def run(key, pdf):
        import pandas as pd

        book = xlsx_sink.Workbook(plan.use_1904)
        writer = SheetWriter.__new__(SheetWriter)
        writer.schema, writer.options, writer.order, writer.df = own, plan, order, None
        names = [f.name for _, f in writer.columns()]
        body = pdf.sort_values(order)[names].astype(object)
        writer.write_into(book.sheet(plan.sheet), iter(body.where(body.notna(), None).itertuples(index=False, name=None)))
        return pd.DataFrame({"key": [str(key[0])], "part": [int(key[1])], "content": [book.finish()]})

    return ranked.groupBy(by, "_part").applyInPandas(run, "key string, part int, content binary")


def save(spark, path: str, chunks: Iterator[bytes]) -> None:
    """Bytes into a file of any store that Spark knows; a file that is there is replaced once all is written."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    part = jvm.org.apache.hadoop.fs.Path(path + "._writing")
    out = fs.create(part, True)
    try:
        for chunk in chunks:
            for i in range(0, len(chunk), 1 << 20):
                out.write(bytearray(chunk[i : i + (1 << 20)]))
        out.close()
    except BaseException:
        out.close()
        fs.delete(part, False)
        raise
    fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"can't write {path}")
