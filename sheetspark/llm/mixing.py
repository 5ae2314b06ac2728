"""Mixing sources to target weights: token weights raked to marginals, documents sampled by them.

Documents fall into cells by source, language and topic. Iterative proportional fitting scales the
cells' tokens until the sums by source, by language and by topic have the target shares of a budget
(a part ``keep`` of all tokens). No cell can give more tokens than it has, so cells are cut at that in
every round and the others make up for it as far as their own targets allow. A cell's fitted tokens over
its tokens are the probability with which each of its documents is drawn, by a hash of its id; so the
expected tokens are the fitted ones, and a document is drawn or not independently of all others.

Targets are tempered shares, ``share ** exponent``, unless given. Every source and language is a class
of its own. Up to ``LOCAL`` cells are fitted on the driver, more as a table, in the same steps. Topics are
``TOPICS`` clusters of texts by their words: spherical k-means over hashed words weighted by rarity, fitted
on all texts (those with the same counters once); every text gets its nearest cluster. What is summed over
texts are integers, so neither partitions nor where it is done have a bearing on the topics.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, settle, text_slices

TOPICS = 8
#: Counters that words are hashed to; a set of them is as many bits.
WIDTH = 2048
#: Sets of counters that are clustered on the driver, in the same steps as more of them are in tasks.
FEW = 20_000
#: Beginnings tried for each centre, sets of counters unpacked at once, and the integer that a sum's 1 is.
TRIED, CHUNK, UNIT = 6, 1000, 1 << 24
KEEP, EXPONENT = 0.6, 0.7
#: Cells that are fitted on the driver; where they are fitted has no bearing on what they are fitted to.
LOCAL = 100_000
ROUNDS, CLOSE = 500, 1e-9
AXES = ("source", "lang", "topic")
OTHER, NONE = "(other)", "(none)"


class Topics:
    """Clusters of texts; a text without words has topic 0."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights  # topics x counters, whole numbers

    def of(self, columns: np.ndarray) -> int:
        return int(self.weights[:, columns].sum(1).argmax()) if len(self.weights) else 0


def columns_of(words: set[bytes]) -> np.ndarray:
    """The counters of a text's different words."""
    return np.unique(np.fromiter(map(zlib.crc32, words), np.uint32) % WIDTH)


def packed(columns: np.ndarray) -> bytes:
    """A set of counters as bits."""
    there = np.zeros(WIDTH, bool)
    there[columns] = True
    return np.packbits(there).tobytes()


def _unpacked(sets: list[bytes]) -> np.ndarray:
    """sets x counters, 0 or 1."""
    return np.unpackbits(np.frombuffer(b"".join(sets), np.uint8)).reshape(len(sets), WIDTH).astype(np.float64)


def _units(weights: np.ndarray) -> np.ndarray:
    """Weights as whole numbers of 1 / UNIT: sums of such are exact, in any order."""
    return np.rint(weights * UNIT)


class _Sets:
    """Different, not empty sets of counters: a list, or a table of a column of bits."""

    def __init__(self, sets: list[bytes] | DataFrame):
        self.sets = sets

    def summed(self, part, size: int) -> np.ndarray:
        """The sum of the ``size`` integers that ``part`` gives for a list of sets."""
        if isinstance(self.sets, list):
            return sum((part(self.sets[i : i + CHUNK]) for i in range(0, len(self.sets), CHUNK)), np.zeros(size, np.int64))

        def run(batches):
            import pyarrow as pa

            out = np.zeros(size, np.int64)
            for sets in _chunks(batches):
                out += part(sets)
            at = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], ["at", "n"])

        found = self.sets.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(size, np.int64)
        out[found["at"].to_numpy()] = found["n"].to_numpy()
        return out

    def least(self, key, n: int) -> list[bytes]:
        """The ``n`` sets with the least numbers that ``key`` gives for a list of sets."""
        def pick(chunks):
            out = []
            for sets in chunks:
                keys = key(sets)
                some = np.flatnonzero(keys <= np.partition(keys, n - 1)[n - 1]) if len(keys) > n else range(len(keys))
                out = sorted(out + [(float(keys[i]), sets[i]) for i in some])[:n]
            return out

        if isinstance(self.sets, list):
            return [s for _, s in pick(self.sets[i : i + CHUNK] for i in range(0, len(self.sets), CHUNK))]

        def run(batches):
            import pyarrow as pa

            out = pick(_chunks(batches))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.float64()), pa.array([s for _, s in out], pa.binary())], ["key", "bits"])

        return [bytes(r["bits"]) for r in self.sets.mapInArrow(run, "key double, bits binary").orderBy("key", "bits").limit(n).collect()]


def _chunks(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, CHUNK):
            yield batch.column(0).slice(i, CHUNK).to_pylist()


def cluster(rows: list[np.ndarray], topics: int = TOPICS, rounds: int = 25) -> Topics:
    """Topics of texts given by their counters."""
    return cluster_sets(_Sets(sorted({packed(r) for r in rows if len(r)})), topics, rounds)


def cluster_sets(sets: _Sets, topics: int = TOPICS, rounds: int = 25) -> Topics:
    """Topics of different sets of counters.

    Each centre begins as one of them: ``TRIED`` are drawn by their hashes, with odds as they are unlike all
    centres before, and that which leaves the sets least unlike their nearest centre is taken (k-means++).
    """
    def count(some):
        return np.append(_unpacked(some).sum(0).astype(np.int64), len(some))

    *there, n = sets.summed(count, WIDTH + 1)
    rare = np.log((1 + n) / (1 + np.array(there, float)))

    def like(some, centres):
        """sets x counters, the sets' lengths, and sets x centres: how alike they are."""
        there = _unpacked(some)
        found = there @ np.vstack([_units(centres * rare), _units(rare**2)]).T / UNIT
        lengths = np.maximum(np.sqrt(found[:, -1]), 1e-3)
        return there, lengths, found[:, :-1] / lengths[:, None]

    def unlike(some, centres):
        return np.maximum(1 - like(some, centres)[2], 0).min(1) if len(centres) else np.ones(len(some))

    def vector(one):
        there, lengths, _ = like([one], np.zeros((0, WIDTH)))
        return there[0] * rare / lengths[0]

    centres = np.zeros((0, WIDTH))
    while len(centres) < min(topics, n):
        now, step = centres, bytes([len(centres) % 256])

        def key(some):
            chance = np.array([(zlib.crc32(s + step) + 0.5) / 2**32 for s in some])
            return -np.log(chance) / np.maximum(unlike(some, now), 1e-12)

        tried = [np.vstack([now, vector(s)]) for s in sets.least(key, TRIED)]

        def cost(some):
            each = like(some, np.vstack([now, *[t[-1:] for t in tried]]))[2]
            known = each[:, : len(now)].max(1, initial=0)
            return np.rint((1 - np.maximum(known[:, None], each[:, len(now) :])) * UNIT).astype(np.int64).sum(0)

        centres = tried[int(sets.summed(cost, len(tried)).argmin())]
    for _ in range(rounds if len(centres) else 0):
        now = centres

        def moved(some):
            there, lengths, alike = like(some, now)
            share = np.zeros((len(now), len(some)))
            share[alike.argmax(1), np.arange(len(some))] = np.rint(UNIT / lengths)
            return (share @ there).astype(np.int64).ravel()

        sums = sets.summed(moved, centres.size).reshape(centres.shape) * rare
        new = np.where(sums.any(1, keepdims=True), sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12), centres)
        if np.allclose(new, centres, atol=1e-6):
            break
        centres = new
    return Topics(_units(centres * rare))


def fit_topics(bits: DataFrame, few: int = FEW) -> Topics:
    """Topics of a settled column of sets of counters, of all that are different and not empty; ``few`` reach the driver at most."""
    sets = bits.toDF("bits").where("bits is not null").distinct()
    found = [bytes(r["bits"]) for r in sets.limit(few + 1).collect()]
    topics = cluster_sets(_Sets(sorted(found) if len(found) <= few else settle(sets)))
    del found
    give_back()
    return topics


def measure(text: str | None, topics: Topics | None = None) -> tuple[int, int]:
    """Tokens (words between ASCII white space) and topic of a text; a text without words has topic 0."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    return len(words), topics.of(columns_of(set(words))) if words and topics else 0


def counted(text):
    """A column of structs: tokens and set of counters (null without words) of a text column. It runs once a row, however often its fields are read."""
    @F.arrow_udf("tokens long, bits binary")
    def run(texts):
        import pyarrow as pa

        tokens, bits = [], []
        for part in text_slices(texts):
            for t in part.to_pylist():
                words = (t or "").encode("utf-8", "surrogatepass").split()
                tokens.append(len(words))
                bits.append(packed(columns_of(set(words))) if words else None)
        return pa.StructArray.from_arrays([pa.array(tokens, pa.int64()), pa.array(bits, pa.binary())], ["tokens", "bits"])

    return run.asNondeterministic()(text)


def topic_of(bits, topics: Topics, spark):
    """A column: the topic of a column of sets of counters; 0 for null.

    A filter that a join derives for it must not run it again: each run in a plan has a Python worker of its own.
    """
    shared = spark.sparkContext.broadcast(topics)

    @F.arrow_udf("int")
    def run(column):
        import pyarrow as pa

        weights, out = shared.value.weights, np.zeros(len(column), np.int32)
        for i in range(0, len(column) if len(weights) else 0, CHUNK):
            some = column.slice(i, CHUNK).to_pylist()
            there = np.array([s is not None for s in some])
            if there.any():
                out[i : i + CHUNK][there] = (_unpacked([s for s in some if s is not None]) @ weights.T).argmax(1)
        return pa.array(out)

    return run.asNondeterministic()(bits)


def rake(tokens: np.ndarray, targets: list[np.ndarray], keep: float, rounds: int = ROUNDS, close: float = CLOSE) -> np.ndarray:
    """Fitted tokens of each cell; ``targets`` has shares for the classes of each axis, summing to 1.

    Classes without tokens give their share to the others.
    """
    return rake_cells(tokens.ravel(), [i.ravel() for i in np.indices(tokens.shape)], targets, keep, rounds, close).reshape(tokens.shape)


def rake_cells(tokens: np.ndarray, classes: list[np.ndarray], targets: list[np.ndarray], keep: float, rounds: int = ROUNDS, close: float = CLOSE) -> np.ndarray:
    """``rake`` of the cells there are: ``classes`` has the number of each cell's class on each axis."""
    fitted, budget = tokens * float(keep), tokens.sum() * float(keep)
    wanted = []
    for at, share in zip(classes, targets):
        there = np.where(np.bincount(at, tokens, len(share)) > 0, share, 0.0)
        wanted.append(budget * there / there.sum() if there.sum() else there)
    for _ in range(rounds):
        before = fitted
        for at, want in zip(classes, wanted):
            have = np.bincount(at, fitted, len(want))
            factor = np.divide(want, have, out=np.ones_like(want), where=have > 0)
            fitted = np.minimum(fitted * factor[at], tokens)
        if np.abs(fitted - before).max(initial=0) <= close * max(1.0, budget):
            break
    return fitted


def rake_table(cells: DataFrame, keep: float, targets: dict[str, dict] | None = None, rounds: int = ROUNDS, close: float = CLOSE) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with ``fitted``: ``rake`` where the cells are rows of a table."""
    spark = cells.sparkSession
    budget = float(cells.agg(F.sum("tokens")).first()[0] or 0) * keep
    wanted = {}
    for axis in AXES:
        sums = cells.groupBy(axis).agg(F.sum("tokens").alias("n")).where("n > 0")
        given = (targets or {}).get(axis)
        if given:
            kind = "int" if axis == "topic" else "string"
            share = spark.createDataFrame([(k, float(v)) for k, v in given.items()], f"{axis} {kind}, share double")
            share = sums.join(share, axis, "left").select(axis, F.coalesce("share", F.lit(0.0)).alias("share"))
        else:
            share = sums.select(axis, F.pow(F.col("n") * keep / F.lit(budget or 1.0), F.lit(EXPONENT)).alias("share"))
        share = settle(share)
        whole = share.agg(F.sum("share")).first()[0] or 1.0
        wanted[axis] = share.select(axis, (F.col("share") / whole * budget).alias("want"))
    now = settle(cells.withColumn("fitted", F.col("tokens") * F.lit(float(keep))))
    for _ in range(rounds):
        new = now.withColumn("before", F.col("fitted"))
        for axis in AXES:
            have = new.groupBy(axis).agg(F.sum("fitted").alias("have")).where("have > 0")
            factor = have.join(wanted[axis], axis).select(axis, (F.col("want") / F.col("have")).alias("factor"))
            new = new.join(factor, axis, "left").withColumn("fitted", F.least(F.col("fitted") * F.coalesce("factor", F.lit(1.0)), F.col("tokens").cast("double"))).drop("factor")
            new = settle(new)
        moved = new.agg(F.max(F.abs(F.col("fitted") - F.col("before")))).first()[0] or 0.0
        now = new.select(*AXES, "tokens", "fitted")
        if moved <= close * max(1.0, budget):
            break
    return now


def tempered(sums: dict, exponent: float = EXPONENT) -> dict:
    """Target shares from tokens: each share to the power ``exponent``, scaled to 1."""
    total = sum(sums.values()) or 1
    raised = {k: (v / total) ** exponent if v else 0.0 for k, v in sums.items()}
    scale = sum(raised.values()) or 1
    return {k: v / scale for k, v in raised.items()}


def classed(stats: DataFrame, most: dict[str, int]) -> DataFrame:
    """``stats`` (source, lang, ...) with null classes named and rare ones as one; for summaries, plans keep all classes."""
    for column, limit in most.items():
        name = named(column)
        sizes = stats.groupBy(name.alias("name")).agg(F.sum("tokens").alias("n"))
        large = [r["name"] for r in sizes.orderBy(F.desc("n"), "name").limit(limit).collect()]  # at most ``limit`` names
        stats = stats.withColumn(column, F.when(name.isin(large), name).otherwise(F.lit(OTHER)))
    return stats


def named(column: str):
    """A source or language by name, as a class."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(NONE))


def fit(cells: list[tuple[str, str, int, int]], keep: float, targets: dict[str, dict] | None = None) -> list[tuple[str, str, int, float]]:
    """Probability of each of ``cells`` (source, lang, topic, tokens), on the driver."""
    tokens = np.array([float(c[3]) for c in cells])
    classes, shares = [], []
    for axis, column in enumerate(AXES):
        names = sorted({c[axis] for c in cells})
        index = {n: i for i, n in enumerate(names)}
        at = np.array([index[c[axis]] for c in cells], np.int64)
        share = (targets or {}).get(column) or tempered(dict(zip(names, np.bincount(at, tokens, len(names)))))
        classes.append(at)
        shares.append(np.array([float(share.get(n, 0.0)) for n in names]))
    fitted = rake_cells(tokens, classes, shares, keep) if cells else tokens
    probability = np.divide(fitted, tokens, out=np.full(tokens.shape, float(keep)), where=tokens > 0)
    return [(*c[:3], float(p)) for c, p in zip(cells, probability)]


def plan(stats: DataFrame, keep: float = KEEP, targets: dict[str, dict] | None = None, local: int = LOCAL) -> DataFrame:
    """(source_class, lang_class, topic, probability) of a table (source, lang, topic, tokens); at most ``local`` cells reach the driver."""
    import pyarrow as pa

    cells = settle(stats.groupBy(named("source").alias("source"), named("lang").alias("lang"), "topic").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")))
    few = cells.limit(local + 1).collect()
    if len(few) <= local:
        rows = fit([tuple(r) for r in few], keep, targets)
        columns = zip(("source_class", "lang_class", "topic", "probability"), (pa.string(), pa.string(), pa.int32(), pa.float64()))
        # rows as a list would go through Python workers, which stay
        return F.broadcast(stats.sparkSession.createDataFrame(pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(columns)})))
    probability = F.when(F.col("tokens") > 0, F.col("fitted") / F.col("tokens")).otherwise(F.lit(float(keep)))
    return rake_table(cells, keep, targets).select(F.col("source").alias("source_class"), F.col("lang").alias("lang_class"), "topic", probability.alias("probability"))


def with_probability(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """``rows`` (source, lang, topic, ...) with their cell's probability."""
    keyed = rows.withColumns({"source_class": named("source"), "lang_class": named("lang")})
    return keyed.join(fitted, ["source_class", "lang_class", "topic"], "left").drop("source_class", "lang_class")


def drawn(id_col: str, seed: int = 17):
    """Whether a document is drawn: its id's hash, even in [0, 1), is below its probability."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(f"`{id_col}`")), F.lit(1 << 53)) / F.lit(float(1 << 53)) < F.col("probability")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", keep: float = KEEP, targets: dict[str, dict] | None = None, seed: int = 17) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, tokens, probability, sampled (0 or 1).

    Defined cases: null sources and languages are classes of their own; a null or empty text has no tokens
    and topic 0, and is drawn with its cell's probability (``keep`` where the cell has no tokens); repeated rows
    are drawn together; null ids hash alike; an empty table gives no rows; other columns are not read.
    """
    text = F.col(f"`{text_col}`").cast("string")
    chosen = docs.select(*[F.col(f"`{c}`").alias(own) for own, c in (("doc_id", id_col), ("source", source_col), ("lang", lang_col))], counted(text).alias("m"))
    sets = settle(chosen.select("doc_id", "source", "lang", "m.bits", "m.tokens"))
    topics = fit_topics(sets.select("bits"))
    stats = settle(sets.select("doc_id", "source", "lang", topic_of("bits", topics, docs.sparkSession).alias("topic"), "tokens"))
    rows = with_probability(stats, plan(stats, keep, targets))
    return rows.select("doc_id", "source", "lang", "topic", "tokens", "probability", drawn("doc_id", seed).cast("long").alias("sampled"))


def sample(docs: DataFrame, keep: float = KEEP, targets: dict[str, dict] | None = None, seed: int = 17) -> DataFrame:
    """The drawn rows of a documents table (doc_id, text, lang, source), as they are.

    Texts are measured once: the rows are settled with what was measured. Defined cases are those of ``mix``.
    """
    text = F.col("text").cast("string")
    chosen = docs.select(F.struct("*").alias("row"), "doc_id", "source", "lang", counted(text).alias("m"))
    sets = settle(chosen.select("row", "doc_id", "source", "lang", "m.bits", "m.tokens"))
    topics = fit_topics(sets.select("bits"))
    rows = sets.withColumn("topic", topic_of("bits", topics, docs.sparkSession)).drop("bits")
    return with_probability(rows, plan(rows.drop("row"), keep, targets)).where(drawn("doc_id", seed)).select("row.*")


def reached(mixed: DataFrame, targets: dict[str, dict] | None = None, exponent: float = EXPONENT) -> DataFrame:
    """(axis, class, target, expected, drawn): each class's share of the tokens, as wanted, by probabilities, as sampled.

    Raking may miss targets where classes have fewer tokens than these ask for. ``mixed`` is what ``mix`` gives.
    """
    spark, out = mixed.sparkSession, None
    for axis in AXES:
        name = F.col("topic").cast("string") if axis == "topic" else named(axis)
        sums = mixed.groupBy(name.alias("class")).agg(F.sum("tokens").alias("all"), F.sum(F.col("tokens") * F.col("probability")).alias("e"), F.sum(F.col("tokens") * F.col("sampled")).alias("d"))
        given = (targets or {}).get(axis)
        if given:
            wish = F.broadcast(spark.createDataFrame([(str(k), float(v)) for k, v in given.items()], "class string, wish double"))
            sums = sums.join(wish, "class", "left").withColumn("wish", F.coalesce("wish", F.lit(0.0)))
        else:
            sums = sums.withColumn("wish", F.pow(F.col("all").cast("double"), F.lit(exponent)))
        whole = sums.agg(*[F.sum(c).alias(c) for c in ("wish", "e", "d")]).first()
        share = lambda c, whole=whole: F.try_divide(F.col(c).cast("double"), F.lit(float(whole[c] or 0)))
        made = sums.select(F.lit(axis).alias("axis"), "class", share("wish").alias("target"), share("e").alias("expected"), share("d").alias("drawn"))
        out = made if out is None else out.unionByName(made)
    return out
