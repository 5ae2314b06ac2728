import random

import pytest

import corpus_pipeline
from sheetspark.llm import neardup


def brute(rows):
    """Rows kept by all pairs' Jaccard similarity of five-word shingles."""
    def grams(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    made, label = [grams(r[1]) for r in rows], list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(made):
        for j in range(i):
            b = made[j]
            if (not a and not b) or (a and b and 5 * len(a & b) >= 4 * len(a | b)):
                label[root(i)] = root(j)
    best = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            k = root(i)
            best[k] = min(best.get(k, r), r, key=lambda x: (x[0], x[1] or ""))
    return sorted([*best.values(), *(r for r in rows if r[0] is None)], key=str)


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(5), []
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    passage = words(60)
    for g in range(30):  # copies with a few changed words, on both sides of 0.8
        base = words(rng.randint(4, 150))
        for _ in range(60 if g == 0 else 4):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = "changed"
            out.append(copy)
    for _ in range(40):  # a passage that many texts share, most of them only that
        out.append(passage + words(rng.choice([3, 8, 20, 200])))
    rows = [(i, " ".join(t)) for i, t in enumerate(out)]
    rows += [(900, None), (901, " "), (None, "x y"), (None, rows[0][1]), (5, "another text with the same id altogether"), (6, rows[6][1])]
    return rows


@pytest.mark.parametrize("small", [1, 3, neardup.SMALL])
def test_against_all_pairs(spark, rows, small):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, neardup.deduplicated(df, small=small).collect()), key=str) == brute(rows)


def test_stage_drops_near_copies(spark):
    base = " ".join(f"w{i * i % 997}" for i in range(200))
    rows = [(3, base), (1, base.replace(" w16 ", " other ")), (2, "far from it"), (2, "and of the same id")]
    df = spark.createDataFrame([(*r, "en", "s", len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_dedup_stage(spark, df, "")
    assert sorted(r.text for r in got.collect()) == sorted(r[1] for r in rows[1:]) and got.columns == df.columns
    assert corpus_pipeline.near_dedup_stage(spark, df.limit(0), "").count() == 0


def test_histograms_never_rule_out_similar_sets():
    import numpy as np

    rng = np.random.default_rng(5)
    for n in (1, 4, 60, 700, 200_000):
        base = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for share in (0.5, 0.8, 0.89, 0.95, 1.0):
            other = np.unique(np.concatenate([base[: int(len(base) * share)], rng.integers(0, 1 << 63, n - int(n * share)).astype(np.uint64)]))
            alike = neardup.similar(set(base.tolist()), set(other.tolist()))
            assert not alike or neardup.may_be_similar(np.array([len(base)]), np.array([len(other)]), [neardup.histogram(base)], [neardup.histogram(other)])[0]
    assert neardup.may_be_similar(np.array([0]), np.array([0]), [neardup.histogram(base[:0])], [neardup.histogram(base[:0])])[0]
