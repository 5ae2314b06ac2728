"""Workbooks of a folder as a stream: every new file is decoded once, in the micro-batch it comes in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import convert
from ..operators.schema import Schema
from ..sources import decode
from ..sources.decode import ReadOptions


def read_stream(spark: SparkSession, folder: str, schema: Schema, options: ReadOptions | None = None, mode: str = convert.DROP, files_each: int = 100) -> DataFrame:
    """Typed rows of a folder's files, with their file, sheet and row, as a streaming DataFrame.

    Spark's file source keeps which files were read in the query's checkpoint, so a query that starts again
    goes on where it was.
    """
    options = options or ReadOptions()
    fields = [f for f in schema.fields if f in schema.used]
    labels = [f.index if f.index is not None else f.labels[-1] for f in fields]
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_each).load(folder)

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from decode.batches(path, content.as_py(), options, labels)

    raw = files.select("path", "content").mapInArrow(run, decode.SCHEMA)
    place = ("file", "sheet_no", "sheet_name", "_row")
    wide = raw.select(*place, *[F.get("cells", i).alias(f"_c{i}") for i in range(len(fields))])
    columns = [(f"_c{fields.index(f)}" if f in fields else None, f) for f in schema.fields]
    return convert.bind(wide, columns, mode=convert.PERMISSIVE if mode == convert.DROP else mode, use_1904=options.use_1904, keep=place).transform(lambda d: d.where("_error is null").drop("_error") if mode == convert.DROP else d)


def for_each_batch(stream: DataFrame, use: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """A running query that hands every micro-batch to ``use``; ``once`` ends when all there is was read."""
    writer = stream.writeStream.foreachBatch(use).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
