import numpy as np

from sheetspark.llm import mixing


def test_rake_meets_marginals_and_keeps_odds():
    rng = np.random.default_rng(1)
    tokens = rng.integers(1000, 5000, (4, 3, 2)).astype(float)
    targets = [np.array([0.4, 0.3, 0.2, 0.1]), np.array([0.5, 0.3, 0.2]), np.array([0.55, 0.45])]
    fitted = mixing.rake(tokens, targets, 0.2)
    for axis, share in enumerate(targets):
        assert np.allclose(fitted.sum(tuple(a for a in range(3) if a != axis)), share * tokens.sum() * 0.2)
    # raking leaves the cells' odds ratios as they were
    ratio = fitted / tokens
    assert np.allclose(ratio[0, 0, 0] * ratio[1, 1, 0], ratio[0, 1, 0] * ratio[1, 0, 0])
    # plain fitting without limits, step by step
    slow = tokens.copy()
    for _ in range(500):
        for axis, share in enumerate(targets):
            for i in range(tokens.shape[axis]):
                part = [slice(None)] * 3
                part[axis] = i
                slow[tuple(part)] *= share[i] * tokens.sum() * 0.2 / slow[tuple(part)].sum()
    assert np.allclose(fitted, slow)
    capped = mixing.rake(tokens, [np.array([0.97, 0.01, 0.01, 0.01]), targets[1], targets[2]], 0.5)
    assert (capped <= tokens + 1e-9).all() and np.allclose(capped[0], tokens[0])


def test_measure():
    assert mixing.measure(None) == mixing.measure(" \n") == (0, 0)
    assert mixing.measure("a b\tc\na")[0] == 4


def test_mix_table(spark):
    rows = [(i, " ".join(f"w{(i * k) % 97}" for k in range(1, 2 + i % 30)), "en" if i % 3 else "de", f"s{min(i % 7, 2)}") for i in range(4000)]
    rows += [(4000, None, None, None), (4001, "", "en", "s0"), (None, "x y", "en", "s1"), (7, rows[7][1], rows[7][2], rows[7][3])]
    df = spark.createDataFrame([(*r, 1.5) for r in rows], "doc_id long, text string, lang string, source string, probability double")
    targets = {"source": {"s0": 0.2, "s1": 0.2, "s2": 0.6}, "lang": {"en": 0.7, "de": 0.3}}
    got = mixing.mix(df, keep=0.4, targets=targets).collect()
    assert len(got) == len(rows)
    kept = [r for r in got if r.sampled]
    total = sum(r.tokens for r in got)
    assert abs(sum(r.tokens for r in kept) / total - 0.4) < 0.03
    expected = sum(r.tokens * r.probability for r in got)
    for name in ("s0", "s1", "s2"):
        share = sum(r.tokens * r.probability for r in got if r.source == name) / expected
        assert abs(share - targets["source"][name]) < 0.001
        assert abs(sum(r.tokens for r in kept if r.source == name) / sum(r.tokens for r in kept) - share) < 0.05
    assert len({r.sampled for r in got if r.doc_id == 7}) == 1
    again = {r.doc_id for r in mixing.sample(df, keep=0.4, targets=targets).collect()}
    assert again == {r.doc_id for r in kept} and mixing.sample(df, keep=0.4).columns == df.columns[:]
    assert mixing.mix(df.limit(0)).count() == 0
    few = mixing.classed(spark.createDataFrame([("a", 5), ("b", 3), ("c", 1), (None, 9)], "source string, tokens long"), {"source": 2})
    assert sorted(r.source for r in few.collect()) == [mixing.NONE, mixing.OTHER, mixing.OTHER, "a"]


def test_topics_tell_vocabularies_apart():
    import random

    rng = random.Random(4)
    kinds = [[f"{k}{i}" for i in range(60)] for k in ("sport", "law", "cook")]
    texts = [(k, " ".join(rng.choices(kinds[k] + ["the", "of", "and"], k=80))) for k in rng.choices(range(3), k=300)]
    topics = mixing.cluster([mixing.columns_of(set(t.encode().split())) for _, t in texts[:200]], 3)
    told = {(k, mixing.measure(t, topics)[1]) for k, t in texts}
    assert len(told) == 3 and len({t for _, t in told}) == 3


def test_query_against_plain_python(spark):
    """Probabilities and draws of the whole operator from its measured cells, step by step."""
    rows = [(i, f"w{i % 5} x{i % 11} y{i * i % 7} " * (1 + i % 9), "en" if i % 3 else "de", f"s{i % 4}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix(df, keep=0.5).collect()
    cells = {}
    for r in got:
        assert r.tokens == len(rows[r.doc_id][1].split())
        cells[r.source, r.lang, r.topic] = cells.get((r.source, r.lang, r.topic), 0) + r.tokens
    total = sum(cells.values())
    fitted = {c: n * 0.5 for c, n in cells.items()}
    for _ in range(500):
        for axis in range(3):
            sums = {}
            for c, n in cells.items():
                sums[c[axis]] = sums.get(c[axis], 0) + n
            raised = {k: (v / total) ** mixing.EXPONENT for k, v in sums.items()}
            have = {}
            for c, v in fitted.items():
                have[c[axis]] = have.get(c[axis], 0) + v
            fitted = {c: min(cells[c], v * raised[c[axis]] / sum(raised.values()) * total * 0.5 / have[c[axis]]) for c, v in fitted.items()}
    hashes = {r[0]: r[1] for r in spark.range(600).selectExpr("id", "pmod(xxhash64(17, id), 9007199254740992) / 9007199254740992D").collect()}
    for r in got:
        c = (r.source, r.lang, r.topic)
        assert abs(r.probability - fitted[c] / cells[c]) < 1e-6
        assert r.sampled == int(hashes[r.doc_id] < r.probability)
    told = {(r["axis"], r["class"]): r for r in mixing.reached(mixing.mix(df, keep=0.5)).collect()}
    for axis in ("source", "lang", "topic"):
        mine = [r for (a, _), r in told.items() if a == axis]
        for column in ("target", "expected", "drawn"):
            assert abs(sum(r[column] for r in mine) - 1) < 1e-9
    assert all(abs(r.target - r.expected) < 0.02 for (a, _), r in told.items() if a != "topic")
