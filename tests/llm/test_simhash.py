import random

import numpy as np

from sheetspark.llm import simhash
from sheetspark.llm.golay import golay
from sheetspark.llm.graph import components


def brute_components(pairs, nodes):
    label = {n: n for n in nodes}

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    for a, b in pairs:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_golay_keys():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 2000)
    keys, there = golay().keys(words)
    assert set(there.sum(1)) == {1, 6}
    for flips in ((3,), (0, 22), (7, 8)):
        others = words ^ sum(1 << f for f in flips)
        k2, t2 = golay().keys(others)
        for i in range(len(words)):
            assert set(keys[i][there[i]]) & set(k2[i][t2[i]])


def test_fingerprint_against_plain_count():
    import xxhash

    for text in ["", None, " \t", "One", "one two", "A b C d e", "ÄÖ ä\xa0b c", "a b c " * 30_000]:
        words = (text or "").encode().lower().split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(text) == (want if words else 0)


def test_links_against_all_pairs(spark):
    rng = random.Random(4)
    values = set()
    for _ in range(12):  # chains and balls around random centres, one of them large
        centre = rng.getrandbits(64)
        for _ in range(60 if not values else 8):
            x = centre
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    close = [(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2]
    want = {n: c for n, c in brute_components(close, signed).items() if any(n in p for p in close)}
    for small in (1, 4, 1000):
        got = simhash.links(df, small).collect()
        assert {tuple(r) for r in got} <= set(close)
        assert {r.node: r.label for r in components(simhash.links(df, small)).collect()} == want
    assert {tuple(r) for r in simhash.links(df, 1000).collect()} == set(close)


def test_long_chain(spark):
    n = 70
    df = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    assert {(r.node, r.label) for r in components(df).collect()} == {(i, 0) for i in range(n + 1)}
    assert components(df.limit(0)).count() == 0


def test_near_duplicates(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(9, base), (3, base), (4, base + " more"), (5, None), (6, ""), (7, "other words here"), (None, "x"), (8, "  ")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, component_id string")
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    assert len(got) == 8 and got[9].component_id == got[3].component_id == 3
    assert got[5].fingerprint == "0" * 16 and got[5].component_id == got[6].component_id == got[8].component_id == 5
    assert got[None].component_id is None and got[7].component_id == 7
    assert got[9].fingerprint == f"{simhash.fingerprint(base):016x}"
    assert simhash.near_duplicates(df.limit(0)).count() == 0
