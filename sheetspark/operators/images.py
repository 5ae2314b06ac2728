"""Images for cells: bytes from columns, files and addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import image_type


def from_files(rows: DataFrame, path_col: str, folder: str, into: str = "image") -> DataFrame:
    """The bytes of the files that a column of paths or names means, read by Spark from ``folder``; null if there is none."""
    files = rows.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("content").alias(into))
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    return rows.withColumn("_name", name(F.col(f"`{path_col}`"))).join(files.withColumn("_name", name(F.col("path"))).drop("path"), "_name", "left").drop("_name")


def from_urls(url: Column, connect: float = 1.0, read: float = 5.0) -> Column:
    """The bytes behind addresses, fetched in tasks within the two time limits; null where that fails."""
    limit = connect + read

    @F.pandas_udf("binary")
    def fetch(urls):
        from urllib.request import urlopen

        def one(u):
            try:
                with urlopen(u, timeout=limit) as r:
                    return r.read()
            except (OSError, ValueError):
                return None

        return urls.__class__([one(u) if isinstance(u, str) else None for u in urls], dtype=object)

    return fetch(url)


def checked(data: Column) -> Column:
    """struct(type, data) of image bytes; null for bytes of no known image."""
    kind = image_type(data)
    return F.when(kind.isNotNull(), F.struct(kind.alias("type"), data.alias("data")))
