"""Exact top-k inner-product search with an impact-ordered index, score at a time.

Vectors become integers. Candidates are indexed in blocks: the postings (row, component, value) of a
block lie in segments by quantised impact, the magnitude of the value, the highest first. A block of
queries goes through the segments in that order and adds up scores. What is left of a query's score for
a row is at most the length of the query times the length of what the row has in later segments. Once
that bound proves that only a few rows can be among the best k, the query stops; these possible members
are scored again exactly from the vectors. A query that proves nothing goes through all segments, after
which its sums are exact.

A task goes through its blocks of candidates one after the other and keeps the best k of each query, so
the k-th score so far is a bound that lets later blocks stop sooner, and what is shuffled is k rows for a
query and task. Queries reach the tasks in passes of at most ``PASS`` bytes. No block, pass or kept list
is larger than the parameters say, so memory does not grow with the data.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, settle

#: Rows of a block of candidates and of queries, bytes of either, and bytes of queries sent to tasks at once.
BLOCK, QUERIES, BYTES, PASS = 4096, 512, 4 << 20, 64 << 20
#: Rows scored again at most when a query stops early; more means that it goes on.
MEMBERS = 128
LEAST = np.iinfo(np.int64).min


def level_edges(highest: int) -> list[int]:
    """Lower edges of the quantised impacts, falling: half octaves down to 1."""
    edges, e = [], 1
    while e <= highest:
        edges += [e, e + e // 2] if e > 1 else [e]
        e *= 2
    return [e for e in sorted(set(edges), reverse=True) if e <= highest]


class Index:
    """The segments of a block of integer vectors, rows x width."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        size = np.abs(vectors)
        self.highest = int(size.max(initial=0))
        self.edges = level_edges(self.highest)
        rows, columns = np.nonzero(vectors)
        values = vectors[rows, columns]
        # level 0 has the highest impacts
        level = np.searchsorted(-np.array(self.edges), -np.abs(values)) if self.edges else np.zeros(0, int)
        order = np.argsort(level, kind="stable")
        ends = np.searchsorted(level[order], np.arange(len(self.edges)), side="right")
        self.segments, begin = [], 0
        for end in ends:
            part = order[begin:end]
            self.segments.append((rows[part], columns[part], values[part]))
            begin = end
        # the length of what each row has below each level, rounded up
        left = np.zeros(len(vectors))
        self.left = [left]
        for rows, _, values in reversed(self.segments[1:]):
            left = left + np.bincount(rows, values.astype(np.float64) ** 2, len(vectors))
            self.left.append(left)
        self.left = [np.sqrt(x) * (1 + 1e-9) for x in reversed(self.left)]
        #: Segments after which a proof is tried: those that leave less than half of the whole length.
        whole = np.sqrt((size.astype(np.float64) ** 2).sum())
        self.tried = [bool(np.sqrt((x**2).sum()) < 0.5 * whole) for x in self.left]
        self.seen = self.stops = 0

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, members: int = MEMBERS, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score): all rows of this block that can be among each query's best ``k``.

        ``own`` is queries x rows: which rows are the query's own and take no part. ``floor`` is each query's
        k-th score so far, the least integer if there is none: rows below it are left out.
        """
        if floor is None:
            floor = np.full(len(queries), LEAST)
        n, width = self.vectors.shape
        most = int(np.abs(queries).max(initial=0)) * self.highest * max(1, width)
        kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64  # sums stay exact
        q, sums = queries.astype(kind), np.zeros((len(queries), n), kind)
        lengths = np.sqrt((queries.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)
        going, found = np.arange(len(queries)), []
        self.seen += len(queries)
        for at, (rows, columns, values) in enumerate(self.segments[:-1] if self.segments else []):
            self._add(sums, q, going, rows, columns, values, kind)
            if self.tried[at]:
                i, row, proven = self._members(sums[going], lengths[going], self.left[at], own[going], floor[going], k, members)
                if proven.any():
                    score = (queries[going[i]].astype(np.int64) * self.vectors[row]).sum(1)
                    found.append((going[i], row, score))
                    self.stops += int(proven.sum())
                    going = going[~proven]
                    if not len(going):
                        break
        if len(going):
            if self.segments:
                self._add(sums, q, going, *self.segments[-1], kind)
            exact = sums[going].astype(np.int64)
            exact[own[going]] = LEAST
            least = floor[going, None]
            if n > k:
                least = np.maximum(least, np.partition(exact, n - k, axis=1)[:, n - k, None])
            i, row = np.nonzero((exact >= least) & ~own[going])
            found.append((going[i], row, exact[i, row]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(c) for c in zip(*found))

    def _add(self, sums, q, going, rows, columns, values, kind) -> None:
        """Add a segment's postings to the scores of ``going``."""
        n, width = self.vectors.shape
        some = np.unique(rows)
        if 2 * len(some) > n:
            part = np.zeros((n, width), kind)
            part[rows, columns] = values
            if len(going) == len(sums):
                sums += q @ part.T
            else:
                sums[going] += q[going] @ part.T
        else:
            part = np.zeros((len(some), width), kind)
            part[np.searchsorted(some, rows), columns] = values
            sums[np.ix_(going, some)] += q[going] @ part.T

    def _members(self, sums, lengths, left, own, floor, k, members):
        """(query, row) of the possible members of queries that have few, and which queries these are."""
        room = lengths[:, None] * left
        now = sums.astype(np.float64)
        slack = 1e-6 * (np.abs(now).max(initial=0) + room.max(initial=0)) + 1e-6  # of the floating-point sums
        bound, unknown = floor.astype(np.float64), floor == LEAST
        if unknown.any():
            if now.shape[1] <= k:
                return np.zeros(0, int), np.zeros(0, int), np.zeros(len(now), bool)
            lower = now[unknown] - room[unknown]
            lower[own[unknown]] = -np.inf
            bound[unknown] = np.partition(lower, lower.shape[1] - k, axis=1)[:, lower.shape[1] - k]
        possible = (now + room >= (bound - slack)[:, None]) & ~own
        proven = possible.sum(1) <= members
        i, row = np.nonzero(possible & proven[:, None])
        return i, row, proven


class Best:
    """The best ``k`` rows of each query so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.query, self.ids, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.floor = np.full(n, LEAST)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Keep each query's ``k`` best of these and those before; ties to the smaller id."""
        query, ids, score = (np.concatenate(x) for x in ((self.query, query), (self.ids, ids), (self.score, score)))
        order = np.lexsort((ids, -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        order, query, place = order[place < self.k], query[place < self.k], place[place < self.k]
        self.query, self.ids, self.score = query, ids[order], score[order]
        last = place == self.k - 1
        self.floor[self.query[last]] = self.score[last]


def integers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): components as integers; rows with a null id, a null vector or a null, infinite or NaN component go."""
    x = F.col("embedding")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    chosen = pick(vectors, vec_id=id_col, embedding=vector_col).where(F.col("vec_id").isNotNull() & x.isNotNull())
    chosen = chosen.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding")).where(F.forall(x, finite))
    return chosen.select("vec_id", F.transform(x, lambda c: F.floor(c * 256)).alias("v"))


def _packed(ids: np.ndarray, matrix: np.ndarray):
    """A block as a batch of one row, components in as few bytes as they need."""
    import pyarrow as pa

    highest = int(np.abs(matrix).max(initial=0))
    kind = "<i2" if highest < 1 << 15 else "<i4" if highest < 1 << 31 else "<i8"
    columns = [pa.array([ids.tobytes()]), pa.array([matrix.shape[1]], pa.int32()), pa.array([kind]), pa.array([matrix.astype(kind).tobytes()])]
    return pa.RecordBatch.from_arrays(columns, ["ids", "width", "kind", "v"])


def unpacked(ids: bytes, width: int, kind: str, v: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a block."""
    ids = np.frombuffer(ids, "<i8")
    return ids, np.frombuffer(v, kind).reshape(len(ids), width).astype(np.int64)


def blocks(rows: DataFrame, size: int, most: int = BYTES) -> DataFrame:
    """(ids, width, kind, v): rows packed as they lie in their partitions, ``size`` at most together and about ``most`` bytes; shorter vectors end in zeros."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        kept, held = [], 0  # slices not yet packed, and their rows

        def pack():
            part = pa.Table.from_batches(kept).combine_chunks()
            ids = part.column(0).to_numpy().astype(np.int64)
            lists = part.column(1).chunk(0)
            lengths = np.diff(np.asarray(lists.offsets))
            matrix = np.zeros((len(ids), int(lengths.max(initial=0))), np.int64)
            matrix[np.arange(matrix.shape[1]) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            return _packed(ids, matrix)

        for batch in batches:
            if not batch.num_rows:
                continue
            wide = max(1, max(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)))
            fit = int(max(1, min(size, most // (8 * wide))))
            begin = 0
            while begin < batch.num_rows:
                part = batch.slice(begin, max(1, fit - held))
                kept.append(part)
                held, begin = held + part.num_rows, begin + part.num_rows
                if held >= fit:
                    yield pack()
                    kept, held = [], 0
        if kept:
            yield pack()

    return rows.mapInArrow(run, "ids binary, width int, kind string, v binary")


def _numbered(packed: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Blocks with numbers from 0 and how many there are: only counts of the partitions reach the driver."""
    where = settle(packed.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    counts = sorted((r["part"], r["n"], r["low"]) for r in where.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("low")).collect())
    starts, total = [], 0
    for part, n, low in counts:
        starts.append((part, total - low))
        total += n
    begin = where.sparkSession.createDataFrame(starts or [(-1, 0)], "part int, begin long")
    return where.join(F.broadcast(begin), "part").select((F.col("at") + F.col("begin")).alias(name), "ids", "width", "kind", "v"), total


def best_of(cands: DataFrame, asked: list, k: int) -> DataFrame:
    """(q, query_id, vec_id, score): for each partition of ``cands`` (blocks) the best ``k`` rows of each query of the blocks ``asked``."""
    shared = cands.sparkSession.sparkContext.broadcast([(int(r["qb"]), bytes(r["ids"]), r["width"], r["kind"], bytes(r["v"])) for r in asked])

    def run(batches):
        import pyarrow as pa

        queries = [(qb, *unpacked(*packed)) for qb, *packed in shared.value]
        kept = [Best(len(ids), k) for _, ids, _ in queries]
        for batch in batches:
            for packed in zip(*(c.to_pylist() for c in batch.columns)):
                ids, x = unpacked(*packed)
                wide = max([x.shape[1], *(y.shape[1] for _, _, y in queries)])
                index = Index(np.pad(x, ((0, 0), (0, wide - x.shape[1]))))
                for (_, q_ids, y), best in zip(queries, kept):
                    own = np.zeros((len(q_ids), len(ids)), bool)
                    some = np.flatnonzero(np.isin(q_ids, ids))
                    own[some] = q_ids[some, None] == ids
                    i, row, score = index.search(np.pad(y, ((0, 0), (0, wide - y.shape[1]))), own, k, floor=best.floor)
                    best.add(i, ids[row], score)
        for (qb, q_ids, _), best in zip(queries, kept):
            if len(best.query):
                yield pa.RecordBatch.from_arrays([pa.array((qb << 20) + best.query), pa.array(q_ids[best.query]), pa.array(best.ids), pa.array(best.score)], ["q", "query_id", "vec_id", "score"])

    return cands.select("ids", "width", "kind", "v").mapInArrow(run, "q long, query_id long, vec_id long, score long")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, at_once: int = QUERIES, most: int = PASS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's ``k`` best rows of ``vectors``, ties to the smaller id.

    Defined cases: rows with a null id or vector, or with a null, NaN or infinite component, take no part;
    a vector shorter than another counts as ending in zeros; rows with the query's id are its own; other
    repeated rows count each; equal scores rank by id; fewer rows than ``k`` are returned as they are; an
    empty table gives no rows; other columns are not read.
    """
    cands = settle(blocks(integers(vectors, id_col, vector_col), block))
    asked, n_asked = _numbered(blocks(integers(queries, id_col, vector_col), at_once), "qb")
    each = max(1, most // BYTES)  # blocks of queries in a pass
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    out = None
    for begin in range(0, max(1, n_asked), each):
        some = asked.where((F.col("qb") >= begin) & (F.col("qb") < begin + each)).collect()  # at most ``most`` bytes
        made = ranked(best_of(cands, some, k))
        if n_asked > each:
            made = settle(made)
        out = made if out is None else out.unionByName(made)
    return out
