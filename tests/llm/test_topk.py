import math
import random

import numpy as np

from sheetspark.llm import topk


def brute(rows, queries, k):
    def ints(v):
        return [math.floor(256 * x) for x in v]

    ok = [(i, ints(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i in queries:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scored, 1)]
    return sorted(out)


def test_index_against_all_scores():
    rng = np.random.default_rng(6)
    for scale, n, width in ((1, 50, 3), (40, 400, 16), (100, 700, 64), (10**9, 30, 4), (0, 9, 5)):
        x = np.rint(rng.normal(size=(n, width)) * scale).astype(np.int64)
        x[: n // 3] = x[0]  # ties
        q = x[:7]
        own = np.arange(n) == np.arange(7)[:, None]
        for members in (0, 64):
            i, row, score = topk.Index(x).search(q, own, 5, members)
            for a in range(7):
                exact = sorted((-int(s), r) for r, s in enumerate((x * q[a]).sum(1)) if r != a)
                got = sorted((-int(s), int(r)) for b, r, s in zip(i, row, score) if b == a)
                assert got[:5] == exact[:5]


def test_table(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)]) for i in range(300)]
    rows += [(300, None), (301, [None] * 8), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (None, [1.0] * 8), (304, []), (350, [0.5, 0.5]), (306, [1e6] * 9)]
    rows += [(400 + i, rows[0][1]) for i in range(20)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, rank int").repartition(3)
    ids = {i for i, _ in rows if i is not None and i % 50 == 0}
    got = topk.search(df, df.where("vec_id % 50 = 0"), 5, block=64, at_once=4)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, ids, 5)
    few = df.where("vec_id in (50, 51, 52)")
    assert topk.search(few, few.where("vec_id = 50")).count() == 2
    assert topk.search(df.limit(0), df.limit(0)).count() == 0


def test_a_block_of_ties_keeps_k_rows_a_query():
    vectors = np.tile(np.arange(1, 9), (4096, 1))
    ids, q = np.arange(4096), np.arange(0, 4096, 80)[:50]
    best = topk.Best(50, 5)
    own = q[:, None] == ids
    i, row, score = topk.Index(vectors).search(vectors[q], own, 5)
    best.add(i, ids[row], score)
    assert len(best.query) == 250
    assert [int(x) for x in best.ids[best.query == 0]] == [1, 2, 3, 4, 5]


def test_ties_over_blocks(spark):
    df = spark.range(700).selectExpr("id as vec_id", "array(1.0D, 0.5D) as embedding").repartition(3)
    got = topk.search(df, df.where("vec_id % 50 = 0"), 5, block=64, at_once=4).collect()
    assert len(got) == 70
    for q in range(0, 700, 50):
        assert sorted(r["vec_id"] for r in got if r["query_id"] == q) == [x for x in range(6) if x != q][:5]


def test_several_passes(spark):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(4)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.search(df, df.where("vec_id % 10 = 0"), 3, block=32, at_once=3, most=1)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, {i for i in range(0, 200, 10)}, 3)


def test_a_floor_lets_blocks_stop_early():
    rng = np.random.default_rng(1)
    x = np.rint(rng.normal(size=(20_000, 64)) * 32).astype(np.int64)
    q, best, stops, seen = x[:100], topk.Best(100, 5), 0, 0
    for begin in range(0, len(x), 4096):
        part = x[begin : begin + 4096]
        index = topk.Index(part)
        own = np.arange(100)[:, None] == np.arange(begin, begin + len(part))
        i, row, score = index.search(q, own, 5, floor=best.floor)
        best.add(i, row + begin, score)
        stops, seen = stops + index.stops, seen + index.seen
    exact = q @ x.T
    exact[np.arange(100), np.arange(100)] = topk.LEAST
    assert (np.sort(exact, 1)[:, -5:] == np.sort(best.score.reshape(100, 5), 1)).all()
    assert stops > 0.9 * seen
