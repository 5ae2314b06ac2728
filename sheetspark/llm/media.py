"""Media columns: every text as a baseline JPEG file, read back, with its dimensions and thumbnail hash.

A text's UTF-8 bytes, filled with bytes 255 up to a positive multiple of 576, become the quantised
coefficients of a grey baseline image (see ``jpeg``), the format's own unit, without loss. The stored
file is then decoded again, and everything returned but ``n_bytes`` comes from what was decoded.

Defined cases: a null or empty text is stored as 576 bytes 255; equal texts give equal values; a null
id is carried along; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import DataFrame

from . import jpeg
from .common import pick, text_batches

SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string"
)


def describe(texts: list[str | None], keep: bool = False) -> list[tuple]:
    """n_bytes and the other columns of each text; with ``keep`` the stored file last."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    files = [jpeg.encode(jpeg.pad(r)) for r in raw]
    out = []
    for r, stored, (head, coefficients) in zip(raw, files, jpeg.decode(files)):
        payload = jpeg.payload_of(head, coefficients)
        row = (
            len(r), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]),
            len(stored), hashlib.sha256(stored).hexdigest(), jpeg.feature(head, coefficients),
        )
        out.append((*row, stored) if keep else row)
    return out


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """One row per document; ``keep`` adds the stored file as column ``media``."""
    schema = SCHEMA + (", media binary" if keep else "")

    def run(batches):
        import pyarrow as pa

        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        names = [f.split()[0] for f in schema.split(", ")]
        for batch in text_batches(batches, 4 << 20):
            rows = describe(batch.column(1).to_pylist(), keep)
            columns = [batch.column(0).to_pylist(), *zip(*rows)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return pick(docs, doc_id=id_col, text=text_col).selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, schema)
