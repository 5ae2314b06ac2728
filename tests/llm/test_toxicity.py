import random
from collections import Counter

import numpy as np

from sheetspark.llm import toxicity
from sheetspark.llm.linear import Rows, fit, out_of_fold, sigmoid


def texts(rng, n):
    """Made-up words; a bad text has words of a bad stem or bad words, a messy one many signs."""
    out = []
    for i in range(n):
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 7))) for _ in range(rng.randint(20, 200))]
        bad, messy = rng.random() < 0.2, rng.random() < 0.2
        if messy:
            words = [w + "!!" for w in words]
        for _ in range(3 if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["zonk", "murk", "grubst" + rng.choice(words)]))
        out.append((i, " ".join(words), int(messy), int(bad)))
    return out


def test_fit_separates_and_oof_leaves_rows_out():
    rng = np.random.default_rng(0)
    columns = [np.unique(rng.integers(0, 30, 6)) for _ in range(300)]
    y = np.array([float(3 in c) for c in columns])
    w, b = fit(Rows(columns, 30), y, 0.002)
    assert ((Rows(columns, 30).times(w) + b > 0) == (y > 0)).all() and np.argmax(w) == 3
    noise = rng.integers(0, 2, 300).astype(float)
    p = out_of_fold(lambda rows: Rows([columns[i] for i in rows], 30), noise, np.arange(300) % 4, 0.0001)
    assert abs(np.corrcoef(p, noise)[0, 1]) < 0.3  # nothing to learn, so nothing known of left-out rows
    w, b = fit(Rows(columns, 30), np.zeros(300), 0.002)
    assert not w.any() and sigmoid(np.float64(b)) < 0.01


def test_held_out_accuracy_and_edge_cases(spark):
    rows = texts(random.Random(7), 900)
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _, _ in rows], "doc_id long, text string, rejected string")
    labels = spark.createDataFrame([(i, m, b) for i, _, m, b in rows[:600]] + [(None, 1, 1), (5000, 1, None)], "doc_id long, messy int, bad int")
    chain = toxicity.train(docs, labels, ["messy", "bad"])
    assert len(chain.models[1][1]) == 1  # the second model has a weight for the first category
    got = {r.doc_id: r for r in toxicity.classify(docs, chain).collect()}
    held = rows[600:]
    assert sum(got[i].rejected == b for i, _, _, b in held) >= 0.97 * len(held)
    assert sum((got[i].p_messy > 0.5) == m for i, _, m, _ in held) >= 0.97 * len(held)
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "zonk zonk"), (3, "zonk murk grubstab " * 60_000), (3, "zonk murk grubstab " * 60_000)], "doc_id long, text string")
    out = [(r.doc_id, r.rejected) for r in toxicity.classify(odd, chain).collect()]
    assert sorted(out, key=str) == sorted([(1, 0), (2, 0), (None, 1), (3, 1), (3, 1)], key=str)
    assert toxicity.classify(docs.limit(0), chain).count() == 0
    empty = toxicity.train(docs, labels.limit(0), ["messy", "bad"])
    assert {r.rejected for r in toxicity.classify(docs, empty).collect()} == {0}


def test_chain_against_plain_python(spark):
    """Features by their definition and the chain's sums, step by step."""
    import math
    import re
    import zlib

    def plain_features(text):
        words = {}
        for token in set((text or "").split()):
            mine = set()
            for core in re.findall(r"[^\W\d_]+", token.lower()):
                mine.add(zlib.crc32(core.encode()))
                mine |= {zlib.crc32(str(n).encode() + core[:n].encode()) for n in (4, 5) if len(core) >= n}
            if not token.isalpha():
                shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"[1-9]", "0", token))
                mine.add(zlib.crc32(b"s" + re.sub(r"(.)\1+", r"\1+", shape)[:16].encode()))
            elif len(token) > 2 and token.isupper():
                mine.add(zlib.crc32(b"upper"))
            for f in mine:
                words[f] = words.get(f, 0) + 1
        return {f for f in words} | {toxicity.shared(f, n) for f, c in words.items() for n in (2, 4, 8) if c >= n}

    rows = texts(random.Random(3), 400) + [(900, "É12 zonk-murk ZONK 3,4!! (zonk) a_b", 0, 1), (901, None, 0, 0)]
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, m, b) for i, _, m, b in rows], "doc_id long, messy int, bad int")
    chain = toxicity.train(docs, labels, ["messy", "bad"])
    got = {r.doc_id: r for r in toxicity.classify(docs, chain).collect()}
    for i, t, _, _ in rows:
        found, p = plain_features(t), []
        for weights, earlier, intercept in chain.models:
            x = intercept + sum(weights.get(f, 0.0) for f in found) + sum(w * q for w, q in zip(earlier, p))
            p.append(1 / (1 + math.exp(-x)))
        assert abs(got[i].p_messy - p[0]) < 1e-9 and abs(got[i].p_bad - p[1]) < 1e-9
        assert got[i].rejected == int(bool(t) and p[1] >= 0.5)


def test_categories_come_from_the_label_table(spark):
    labels = spark.createDataFrame([(1, 0, 1, 0, 1)], "doc_id long, quality int, insult int, threat int, toxic int")
    made, names = toxicity.category_labels(labels)
    assert names == ["low_quality", "insult", "threat", "toxic"] and made.first()[1:] == (1, 1, 0, 1)


def test_training_holds_little_beside_its_features():
    import tracemalloc

    rng = np.random.default_rng(3)
    rows = [np.unique(np.concatenate([rng.integers(0, 4000, 300, np.uint32), rng.integers(0, 1 << 32, 700, np.uint32)])) for _ in range(600)]
    labels = np.array([[int(7 in f)] for f in rows])
    tracemalloc.start()
    toxicity.fit_chain(rows, labels, ["toxic"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * sum(f.nbytes for f in rows)


def test_common_features_are_those_of_three_rows_and_not_nearly_all():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 5, 40):
        rows = [np.unique(rng.integers(0, 30, rng.integers(0, 25), np.uint32)) for _ in range(n)]
        counts = Counter(int(x) for f in rows for x in f)
        assert toxicity.common_features(rows).tolist() == sorted(x for x, k in counts.items() if k >= 3 and k < 0.9 * n)
