"""Near-duplicates of texts by SimHash with Golay keys, completed to every pair of ``SIMILARITY`` or above.

Texts are sets of five-word shingles. Sets with the same SimHash, or with ones that link by their Golay keys
(``simhash.links``), are candidates. Of two sets with a Jaccard similarity of 0.8 about ten of 64 bits
differ, which no number of Golay keys that can be afforded reaches, so SimHash alone can't give all pairs;
the rest come from an exact join.

For it shingles are put in one order for all texts, common ones last. Of two sets with a similarity of 0.8,
each has four fifths of its shingles in common with the other, so they meet in at least ``MEET`` of
the first ``n - ceil(0.8 n) + MEET`` shingles of each (in all that must be common, if those are fewer).
These are the keys. A pair that meets in buckets of more than ``SMALL`` sets no more often than the one
of the two that has fewer such keys must meet in smaller ones as often as is left, so it is a candidate there;
or both have at least as many such keys as they must meet in, and meet in the first few of these. Only
those are compared in large buckets: with a few members first, and then those that are in different components
still, so a large group of copies costs in proportion to its members. All candidates are verified on the
shingles themselves, and components follow from the links.

Which shingles count as common only decides the order, so it has no bearing on the result.
"""

from __future__ import annotations

from itertools import repeat

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import hot_keys, settle, spread_join, text_batches
from .graph import components

WORDS = 5
#: Similarity as a fraction: 0.8.
SIMILARITY = (4, 5)
MEET, SMALL = 4, 16
#: Counters of a set's own shingles.
BINS = 512
#: Counters that shingles fall into for their order, and how many of them are told apart.
SLOTS, HEAVY = 1 << 18, 1 << 16
#: Members of a large bucket that its others are compared with in a round, and rounds before all that is left
#: is compared, as long as one in ``WORTH`` comparisons finds a link.
PIVOTS, ROUNDS, WORTH = 8, 6, 50
#: Members of a large bucket in a block, where what is left is compared.
BLOCK = 512


def shingles(text: str | None, words_each: int = WORDS) -> list[bytes]:
    """The different shingles of the lower-cased (A-Z) text, parted at ASCII white space.

    Fewer words than a shingle has: the whole sequence is the only shingle. No words: no shingles.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = min(words_each, len(words))
    return list(set(map(b" ".join, zip(*(words[k:] for k in range(n)))))) if n else []


def hashes(text: str | None):
    """Sorted hashes of a text's shingles."""
    import numpy as np
    from xxhash import xxh64_intdigest

    return np.unique(np.fromiter(map(xxh64_intdigest, shingles(text), repeat(42)), np.uint64))


def needed(n):
    """Shingles that a set of ``n`` has in common with any that is similar enough."""
    return -(-n * SIMILARITY[0] // SIMILARITY[1])


def similar(a: set, b: set) -> bool:
    if not a or not b:
        return not a and not b
    both = len(a & b)
    return both * SIMILARITY[1] >= (len(a) + len(b) - both) * SIMILARITY[0]


def heavy_slots(texts: DataFrame) -> dict[int, int]:
    """Counters that common shingles fall into; what reaches the driver is bounded by ``HEAVY``."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        counts = np.zeros(SLOTS, np.int64)
        for batch in text_batches(batches):
            made = [hashes(text) for text in batch.column(0).to_pylist()]
            counts += np.bincount((np.concatenate(made) % SLOTS).astype(np.int64), minlength=SLOTS)
        at = np.flatnonzero(counts > 4 * counts.mean() + 3)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["slot", "n"])

    sums = texts.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    return {r["slot"]: r["n"] for r in sums.orderBy(F.desc("n"), "slot").limit(HEAVY).collect()}


def simhash_of(hashes_of_shingles) -> int:
    """The signed SimHash of a set of shingle hashes: a bit is 1 if it is in over half of them."""
    import numpy as np

    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes_of_shingles), 1 << 16):
        total += np.unpackbits(hashes_of_shingles[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes_of_shingles), bitorder="little").view(np.int64)[0])


def histogram(hashes_of_shingles) -> bytes:
    """How many shingles fall into each of ``BINS``, a byte each; nothing if a byte does not hold one of them."""
    import numpy as np

    counts = np.bincount((hashes_of_shingles % BINS).astype(np.int64), minlength=BINS)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def may_be_similar(na, nb, ha: list[bytes], hb: list[bytes]):
    """Whether sets of so many shingles can be similar enough: they have no more in common than their histograms."""
    import numpy as np

    both = np.minimum(na, nb)
    told = np.array([len(x) == len(y) == BINS for x, y in zip(ha, hb)], bool)
    at = np.flatnonzero(told)
    if len(at):
        one, other = (np.frombuffer(b"".join(h[i] for i in at), np.uint8).reshape(-1, BINS) for h in (ha, hb))
        both[at] = np.minimum(both[at], np.minimum(one, other).sum(1, dtype=np.int64))
    return both * SIMILARITY[1] >= (na + nb - both) * SIMILARITY[0]


def sets(texts: DataFrame) -> DataFrame:
    """(doc_id, th, node, n, fp, bins, last, keys) of rows (doc_id, th, text): node stands for the set of n shingles, 0 for the empty one; fp is its SimHash, bins its histogram, last the place of its last key in the order."""
    import numpy as np

    heavy = np.zeros(SLOTS, np.int64)
    for slot, count in heavy_slots(texts).items():
        heavy[slot] = count
    shared = texts.sparkSession.sparkContext.broadcast(heavy)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        order = shared.value
        for batch in text_batches(batches):
            nodes, sizes, prints, bins, lasts, keys = [], [], [], [], [], []
            for text in batch.column(2).to_pylist():
                h = hashes(text)
                n = len(h)
                first = h[np.argsort(order[(h % SLOTS).astype(np.int64)], kind="stable")][: n - needed(n) + MEET] if n else h
                nodes.append(xxh64_intdigest(h.tobytes(), 7) if n else 0)
                sizes.append(n)
                prints.append(simhash_of(h))
                bins.append(histogram(h))
                lasts.append((int(order[int(first[-1] % SLOTS)]), int(first[-1]) - (1 << 63)) if n else (0, 0))
                keys.append(first.view(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys), pa.int64()))
            signed = pa.array(np.array(nodes, np.uint64).view(np.int64))
            rank = pa.StructArray.from_arrays([pa.array([c for c, _ in lasts], pa.int64()), pa.array([x for _, x in lasts], pa.int64())], ["c", "h"])
            columns = [batch.column(0), batch.column(1), signed, pa.array(sizes, pa.int32()), pa.array(prints, pa.int64()), pa.array(bins, pa.binary()), rank, lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "node", "n", "fp", "bins", "last", "keys"])

    return texts.select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th long, node long, n int, fp long, bins binary, last struct<c:long,h:long>, keys array<long>")


def verified(pairs: DataFrame, distinct: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose shingles are similar enough."""

    def run(batches):
        import pyarrow as pa

        name, held = None, set()
        for batch in text_batches(batches):
            a, b, b_text, a_text = (c.to_pylist() for c in batch.columns)
            keep = []
            for i in range(len(a)):
                if a[i] != name:
                    name, held = a[i], set(shingles(a_text[i]))
                if similar(held, set(shingles(b_text[i]))):
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64())).select(["a", "b"])

    def possible(batches):
        import pyarrow as pa

        for batch in batches:
            na, nb = (batch.column(i).to_numpy().astype("int64") for i in (2, 3))
            ok = may_be_similar(na, nb, batch.column(4).to_pylist(), batch.column(5).to_pylist())
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    # first histograms, then the texts of what is left
    pairs = settle(pairs)
    one, other = (distinct.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bins").alias(f"h{x}")) for x in "ab")
    told = spread_join(spread_join(pairs, other, "b", narrow=False), one, "a", pairs, narrow=False).select("a", "b", "na", "nb", "ha", "hb")
    pairs = settle(told.mapInArrow(possible, "a long, b long"))
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    some = settle(distinct.join(nodes, "node").select("node", "th"))
    told = settle(spread_join(texts.select("th", "text"), some, "th", texts.select("th")).groupBy("node").agg(F.first("text").alias("text")))
    first, second = (told.select(F.col("node").alias(x), F.col("text").alias(f"{x}_text")) for x in "ab")
    both = spread_join(spread_join(pairs, second, "b", narrow=False), first, "a", pairs, narrow=False)
    return settle(both.select("a", "b", "b_text", "a_text").mapInArrow(run, "a long, b long"))


def _close(a: str, b: str):
    """Whether sets of so many shingles can be similar enough."""
    low, high = F.least(a, b), F.greatest(a, b)
    return low * SIMILARITY[1] >= high * SIMILARITY[0]


def _enough(a: str, b: str):
    """Whether sets that meet in no keys but those of large buckets can be similar enough.

    Common shingles that are keys of the set whose last key comes first are keys of the other too. So this
    set has no more in common with the other than ``room``: all but those of its keys that it can't meet in.
    """
    room = F.when(F.col(f"last{a}") <= F.col(f"last{b}"), F.col(f"room{a}")).otherwise(F.col(f"room{b}"))
    return room * (SIMILARITY[0] + SIMILARITY[1]) >= (F.col(f"n{a}") + F.col(f"n{b}")) * SIMILARITY[0]


def seeds(distinct: DataFrame) -> DataFrame:
    """(a, b): sets whose fingerprints are the same or link by their Golay keys, as stars around the least of each fingerprint."""
    first = settle(distinct.groupBy("fp").agg(F.min("node").alias("first")))
    same = spread_join(distinct.select("node", "fp"), first, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = simhash.links(first.select("fp"))
    one, other = (first.select(F.col("fp").alias(x), F.col("first").alias(f"{x}_node")) for x in "ab")
    linked = near.join(one, "a").join(other, "b").select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))
    return same.unionByName(linked)


def least_met(n):
    """Keys in which a set of ``n`` shingles meets any that is similar enough, at least."""
    return F.least(F.lit(MEET), F.ceil(n * SIMILARITY[0] / SIMILARITY[1]))


def links(distinct: DataFrame, texts: DataFrame, small: int = SMALL) -> DataFrame:
    """(a, b): links between sets that connect all that are similar enough."""
    keys = distinct.select("node", "n", F.explode("keys").alias("key"))
    total = distinct.agg(F.sum(F.size("keys"))).first()[0] or 0
    sizes = settle(keys.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"))
    held = settle(spread_join(keys, sizes, "key", hot=hot_keys(sizes.select("key", F.col("members").alias("_n")), ["key"], total)))
    # a set's keys with large buckets, those of the smallest first: a list has no more of them than the set has keys
    by_set = F.array_sort(F.collect_list(F.struct("members", "key")))
    crowded = settle(held.where(F.col("members") > small).groupBy("node").agg(F.first("n").alias("n"), by_set.alias("crowd")).withColumn("crowds", F.size("crowd")))
    crowds = crowded.select("node", "crowds")
    few = settle(spread_join(held.where(F.col("members") <= small), crowds, "node", held, "left").select("key", "node", "n", F.coalesce("crowds", F.lit(0)).alias("crowds")))
    one, other = (few.select("key", F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("crowds").alias(f"c{x}")) for x in "ab")
    pairs = (
        one.join(other, "key").where(F.col("a") < F.col("b")).where(_close("na", "nb"))
        .groupBy("a", "b").agg(F.count("*").alias("met"), F.first(F.greatest("na", "nb")).alias("n"), F.first(F.least("ca", "cb")).alias("crowds"))
        .where(F.col("met") >= least_met(F.col("n")) - F.col("crowds")).select("a", "b")
    )
    found = verified(pairs.unionByName(seeds(distinct)).distinct(), distinct, texts)
    # the first of them, in which a set meets any that it meets in such only; sets take their places and labels before their keys are dealt
    first = (F.col("crowds") - least_met(F.col("n")) + 1).cast("int")
    at = crowded.where(first > 0).select("node", "n", "crowds", F.transform(F.slice("crowd", 1, first), lambda x: x["key"]).alias("first"))
    room = (F.col("n") - F.size("keys") + F.col("crowds")).cast("long").alias("room")
    member = ["node", "n", "room", "last"]
    places = settle(distinct.select("node", "keys", "last").join(at, "node").select("node", "n", room, "last", "first"))
    if not places.head(1):
        return found
    for turn in range(ROUNDS + 1):
        label = components(found)
        told = spread_join(large, label, "node", how="left") if turn else places.join(label, "node", "left").withColumn("key", F.explode("first"))
        now = settle(told.select("key", *member, F.coalesce("label", "node").alias("label")))
        apart = now.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.array_distinct(F.array(*[F.min_by(F.struct(*member, "label"), F.xxhash64("label", "node", F.lit(PIVOTS * turn + i))) for i in range(PIVOTS)])).alias("pivots")).where("low < high")
        large = settle(spread_join(now, settle(apart.select("key", "pivots")), "key"))
        if not large.head(1):
            return found
        if turn == ROUNDS:
            break
        compared = large.select("*", F.explode("pivots").alias("p")).where("label <> p.label").select(*[F.col(f"p.{c}").alias(f"{c}a") for c in member], *[F.col(c).alias(f"{c}b") for c in member])
        compared = settle(compared.where(_close("na", "nb") & _enough("a", "b")).select(F.col("nodea").alias("a"), F.col("nodeb").alias("b")).distinct())
        more = verified(compared, distinct, texts)
        found = found.unionByName(more)
        if more.count() * WORTH < compared.count():
            break
        large = large.select("key", *member)
    return found.unionByName(verified(compared_in_blocks(large, distinct, member), distinct, texts))


def compared_in_blocks(large: DataFrame, distinct: DataFrame, member: list[str]) -> DataFrame:
    """(a, b): members of the same bucket, in different components, that can be similar enough.

    Members are dealt to blocks of about ``BLOCK``, and every two blocks of a bucket meet in a task, where they
    are held against each other by sizes, places and histograms; only what is left of that goes on.
    """
    sizes = settle(large.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    told = spread_join(large.select("key", *member, "label"), distinct.select("node", "bins"), "node", large, narrow=False)
    dealt = spread_join(told, sizes, "key", large).withColumn("own", F.pmod(F.xxhash64("node", F.lit(11)), F.col("blocks")).cast("int"))
    both = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    both = both.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n", "room", F.col("last.c").alias("c"), F.col("last.h").alias("h"), "label", "bins")

    def run(part):
        import numpy as np
        import pandas as pd

        i, j = part["i"].iloc[0], part["j"].iloc[0]
        one, other = (part[part["own"] == x].reset_index(drop=True) for x in (i, j))
        out = []
        node, n, room, c, h, label = (other[x].to_numpy() for x in ("node", "n", "room", "c", "h", "label"))
        bins = other["bins"].tolist()
        for r in one.itertuples():
            first = (r.c < c) | (r.c == c) & (r.h <= h)
            enough = np.where(first, r.room, room) * (SIMILARITY[0] + SIMILARITY[1]) >= (r.n + n) * SIMILARITY[0]
            close = np.minimum(r.n, n) * SIMILARITY[1] >= np.maximum(r.n, n) * SIMILARITY[0]
            at = np.flatnonzero((label != r.label) & enough & close & ((node > r.node) if i == j else (node != r.node)))
            if len(at):
                at = at[may_be_similar(np.full(len(at), r.n, np.int64), n[at].astype(np.int64), [r.bins] * len(at), [bins[k] for k in at])]
                out += [(min(r.node, x), max(r.node, x)) for x in node[at].tolist()]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return both.groupBy("key", "i", "j").applyInPandas(run, "a long, b long").distinct()


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL) -> DataFrame:
    """``docs`` with one row of each component, that of its smallest id (of its rows with that id, the least text).

    Defined cases: texts without words are a component; of ties and repeated rows one stays; rows of one id
    with texts of different components all stay; rows without an id stay, as nothing tells them apart; an
    empty table gives no rows; other columns are carried along.
    """
    key, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    texts = docs.select(key.cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.cast("string").alias("text"))
    found = settle(sets(texts))
    distinct = settle(found.groupBy("node").agg(F.min("th").alias("th"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bins").alias("bins"), F.first("last").alias("last"), F.first("keys").alias("keys")))
    label = components(links(distinct, texts, small))
    every = settle(distinct.select("node").join(label, "node", "left").select("node", F.coalesce("label", "node").alias("label")))
    rows = settle(spread_join(found.where("doc_id is not null").select("doc_id", "th", "node"), every, "node").select("doc_id", "th", "label"))
    least = rows.groupBy("label").agg(F.min("doc_id").alias("doc_id"))
    stay = settle(rows.join(least, ["label", "doc_id"]).groupBy("label", "doc_id", "th").agg(F.count("*").alias("rows")))
    single = stay.groupBy("label").agg(F.sum("rows").alias("all")).where(F.col("all") == 1).select("label")
    told = docs.select(F.struct("*").alias("_row"), key.cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("_text"))
    alone = told.join(stay.join(single, "label", "left_semi").select("doc_id", "th"), ["doc_id", "th"]).select("_row.*")
    several = told.join(stay.join(single, "label", "left_anti").select("doc_id", "th", "label"), ["doc_id", "th"])
    first = F.row_number().over(Window.partitionBy("label").orderBy("_text"))
    return alone.unionByName(several.withColumn("_at", first).where("_at = 1").select("_row.*")).unionByName(docs.where(key.isNull()))
