"""SimHash near-duplicates: fingerprints of word shingles, Golay keys, verified links, components.

A fingerprint is cut into segments of 22, 21 and 21 bits. Of two bits that differ at most, one of the
three segments has none, and any other has two at most, so for one of three pairings (whole segment,
Golay key of the next, filled up to 23 bits) both fingerprints have a key in common. Keys with two fingerprints or more give
the candidates. Small buckets are joined and every pair verified; a bucket of more than ``SMALL``
fingerprints is not: its members go, each with the 64 fingerprints one bit away, to a table in which
two fingerprints meet exactly if they differ in at most two bits, and each links to the least one
there, so the work stays in proportion to the members. Components follow from the links.

Only different fingerprints take part in this; documents with the same one are a component already.
"""

from __future__ import annotations

from itertools import repeat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, pick, settle, spread_join, text_batches
from .graph import components

#: Fingerprints of a bucket that are compared with each other; more go the other, equally exact way.
SMALL = 16
#: First bit and bits of the segments of a fingerprint.
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def fingerprint(text: str | None, words_each: int = 3) -> int:
    """The 64-bit SimHash of the lower-cased (A-Z) text's word shingles, repeats included, unsigned.

    Words part at white space of ASCII. Fewer words than a shingle has: the whole sequence is the only
    shingle. No words (a null, empty or blank text): zero.
    """
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = min(words_each, len(words))
    total, count = np.zeros(64, np.int64), len(words) - n + 1
    for i in range(0, count, 1 << 16):
        some = words[i : i + (1 << 16) + n - 1]
        shingles = map(b" ".join, zip(*(some[k:] for k in range(n))))
        hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(42)), np.uint64)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > count, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of every document as a signed long."""

    def run(batches):
        import pyarrow as pa

        for batch in text_batches(batches):
            values = [fingerprint(t, words_each) for t in batch.column(1).to_pylist()]
            signed = pa.array([v - (1 << 64) if v >> 63 else v for v in values], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), signed], ["doc_id", "fp"])

    return pick(docs, doc_id=id_col, text=text_col).selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, fp long")


def golay_keys(distinct: DataFrame) -> DataFrame:
    """(key, fp): for each fingerprint its three to eighteen keys."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from .golay import golay

        for batch in batches:
            signed = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            parts = [(signed.view(np.uint64) >> np.uint64(at)).astype(np.int64) & ((1 << bits) - 1) for at, bits in SEGMENTS]
            for k, whole in enumerate(parts):
                at = (k + 1) % 3
                near, there = golay().keys(parts[at] << (23 - SEGMENTS[at][1]))
                keys = (k << 40) | (whole[:, None] << 12) | near
                yield pa.RecordBatch.from_arrays([pa.array(keys[there]), pa.array(np.broadcast_to(signed[:, None], there.shape)[there])], ["key", "fp"])

    return distinct.select("fp").mapInArrow(run, "key long, fp long")


def links(distinct: DataFrame, small: int = SMALL) -> DataFrame:
    """(a, b): links between different fingerprints at most two bits apart.

    Every link of a bucket of at most ``small`` is there; those of larger buckets are there as stars
    that connect the same fingerprints.
    """
    keys = settle(golay_keys(distinct))
    sizes = settle(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    held = settle(spread_join(keys, sizes, "key", hot=hot_keys(sizes.select("key", F.col("n").alias("_n")), ["key"], keys.count())))
    few = held.where(F.col("n") <= small).select("key", "fp")
    pairs = (
        few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key")
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b")
    )
    many = held.where(F.col("n") > small).select("fp").distinct()
    bits = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    between = many.select("fp", F.explode(bits).alias("bit")).select(F.col("fp"), F.col("fp").bitwiseXOR(F.col("bit")).alias("between"))
    least = between.groupBy("between").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("between", "a")
    stars = between.withColumnRenamed("fp", "b").join(least, "between").where("a < b").select("a", "b")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id reachable).

    Defined cases: null, empty and blank texts have fingerprint zero and are linked like any other;
    repeated rows stay and share a component; a null id is carried along, and a component of null ids
    only has a null id; an empty table gives no rows; other columns are not read.
    """
    found = settle(fingerprints(docs, id_col, text_col, words_each))
    distinct = settle(found.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = components(links(distinct))
    # a label is a fingerprint of the component; its document is the first of all its fingerprints
    linked = settle(labels.join(distinct, labels.node == distinct.fp).select("node", "label", "first"))
    firsts = settle(linked.groupBy("label").agg(F.min("first").alias("component_id")))
    component = spread_join(linked, firsts, "label").select(F.col("node").alias("fp"), "component_id")
    own = settle(distinct.join(component, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")))
    return spread_join(found, own, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
