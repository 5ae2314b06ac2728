"""What the operators of this subpackage share: settled tables, column picking, bounded batches."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) a temporary folder is set; on a
    cluster without one executors would write to disks of their own, which is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        require_local(spark.sparkContext.master)
        named = tempfile.mkdtemp(prefix="sheetspark-checkpoints-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def require_local(master: str) -> None:
    """An error unless the master is one machine."""
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir is not set, and {master} is not one machine")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    It cuts the lineage, survives lost executors, and keeps later reads columnar. The table goes when the
    driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names; extra columns never clash."""
    return df.select(*[F.col(f"`{name}`").alias(own) for own, name in columns.items()])


#: A key with more than one part in ``PARTS`` of all rows is hot, and its rows are dealt over ``SALTS`` tasks.
PARTS, SALTS = 1024, 32
#: Rows of a table of numbers and short texts that is sent to all tasks at most; larger ones are shuffled.
SMALL_TABLE = 100_000


def hot_keys(counts: DataFrame, keys: list[str], total: int, parts: int = PARTS) -> DataFrame:
    """Those of ``counts`` (keys, _n) with more than one part in ``parts`` of ``total`` rows: fewer than ``parts``."""
    return counts.where(F.col("_n") * parts > F.lit(max(total, 16 * parts))).select(*keys, F.lit(True).alias("_hot"))


def spread_join(
    rows: DataFrame, single: DataFrame, key: str | list[str], like: DataFrame | None = None, how: str = "inner", narrow: bool = True, hot: DataFrame | None = None,
    parts: int = PARTS, salts: int = SALTS, small: int = SMALL_TABLE,
) -> DataFrame:
    """``rows`` joined with ``single`` (a row for each key) so that no key's rows meet in one task.

    A settled ``single`` of ``small`` rows at most that is ``narrow`` (numbers and short texts only) is sent to
    all tasks. Otherwise hot keys, fewer than ``parts`` by their definition, are; rows that have one are dealt
    by a hash of the row, and its row of ``single`` is there once for each salt. ``like`` is a settled table
    with the keys of ``rows``, where ``rows`` itself would have to be computed to count them, or ``hot`` are
    its ``hot_keys`` already.
    """
    keys = [key] if isinstance(key, str) else key
    if narrow and small and len(single.limit(small + 1).select(F.lit(1)).groupBy().count().where(F.col("count") <= small).head(1)):
        return rows.join(F.broadcast(single), keys, how)
    if hot is None:
        like = rows if like is None else like
        hot = hot_keys(like.groupBy(*keys).agg(F.count("*").alias("_n")), keys, like.count(), parts)
    hot = F.broadcast(hot)
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    each = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = rows.join(hot, keys, "left").withColumn("_salt", salt).drop("_hot")
    right = single.join(hot, keys, "left").withColumn("_salt", F.explode(each)).drop("_hot")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def text_slices(texts, limit: int = 8 << 20) -> Iterator:
    """Slices of an Arrow array of texts of about ``limit`` bytes at most; a single longer text makes a slice of its own."""
    import pyarrow as pa

    for part in text_batches([pa.RecordBatch.from_arrays([texts], ["text"])], limit):
        yield part.column(0)


def text_batches(batches: Iterator, limit: int = 8 << 20) -> Iterator:
    """Slices of Arrow batches whose last column, a text, has about ``limit`` bytes at most.

    A single longer text makes a slice of its own; no text is cut.
    """
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False)
        ends, begin = np.cumsum(sizes.astype(np.int64)), 0
        while begin < batch.num_rows:
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end
    give_back()


def give_back() -> None:
    """Hand freed memory back to the system: workers and the driver live on, and what one task or fit held would stay with them."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tokenizer_path(name: str) -> str:
    """Place of a vocabulary file of the installed public tokenizers (``TOKENIZERS_DIR`` overrides it)."""
    if os.environ.get("TOKENIZERS_DIR"):
        return os.path.join(os.environ["TOKENIZERS_DIR"], name)
    import public_tokenizers

    return str(public_tokenizers.path(name))
