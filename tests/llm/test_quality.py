import random

import numpy as np

from sheetspark.llm import quality


def texts(rng, n):
    """(id, text, good): prose, and the same with one of several faults."""
    out = []
    for i in range(n):
        words = ["".join(rng.choices("abdeilmnorstu", k=rng.randint(2, 8))) for _ in range(rng.randint(30, 150))]
        words = [w + "." if rng.random() < 0.08 else w for w in words]
        words[-1] += "."
        good = rng.random() > 0.25
        if not good:
            words = rng.choice((lambda: [w + "***" for w in words], lambda: [w.upper() + "!!" for w in words], lambda: [w for w in words[:20] for _ in range(9)], lambda: [x for w in words for x in (w, "|")]))()
        out.append((i, " ".join(words), int(good)))
    return out


def test_em_recovers_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.7
    accuracy, speaks = [0.95, 0.85, 0.9, 0.82], [0.9, 0.6, 0.5, 0.8]
    votes = np.array([[(int(t) if rng.random() < a else int(not t)) if rng.random() < s else quality.NONE for a, s in zip(accuracy, speaks)] for t in truth])
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    posterior, got, prior = quality.estimate(patterns, counts.astype(float))
    assert np.abs(got - accuracy).max() < 0.03 and abs(prior - 0.7) < 0.03
    by = {tuple(p): q for p, q in zip(patterns, posterior)}
    assert np.mean([(by[tuple(v)] > 0.5) == t for v, t in zip(votes, truth)]) > 0.93
    assert len(quality.estimate(np.zeros((0, 4), int), np.zeros(0))[0]) == 0


def test_classify(spark):
    rows = texts(random.Random(5), 800)
    odd = [(900, None), (901, ""), (901, ""), (None, rows[0][1]), (902, "ok fine. " * 100_000)]
    df = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows] + [(*r, "clash") for r in odd], "doc_id long, text string, score string")
    got = quality.classify(df).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    assert np.mean([by[i].keep == y for i, _, y in rows]) > 0.97
    assert by[900].keep == by[901].keep == 0 and by[None].score == by[0].score
    assert quality.classify(df.limit(0)).count() == 0


def test_em_finds_a_poor_and_an_adversarial_labeller():
    rng = np.random.default_rng(2)
    truth = rng.random(30_000) < 0.7
    accuracy = [0.95, 0.88, 0.9, 0.55, 0.2]
    votes = np.array([[(int(t) if rng.random() < a else int(not t)) if rng.random() < 0.8 else quality.NONE for a in accuracy] for t in truth])
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    posterior, got, prior = quality.estimate(patterns, counts.astype(float))
    assert np.abs(got - accuracy).max() < 0.03 and abs(prior - 0.7) < 0.03
    by = {tuple(p): q for p, q in zip(patterns, posterior)}
    assert np.mean([(by[tuple(v)] > 0.5) == t for v, t in zip(votes, truth)]) > 0.93


def test_query_against_plain_python(spark):
    """EM over the documents' own patterns and the scorer, step by step in plain Python."""
    rows = texts(random.Random(8), 300)
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.classify(df).collect()}
    made = {i: quality.Text(t) for i, t, _ in rows}
    counts = {}
    for t in made.values():
        pattern = "".join("01-"[v] for v in quality.votes(t))
        counts[pattern] = counts.get(pattern, 0) + 1
    k = len(quality.LABELLERS)
    accuracy, prior, posterior = [0.8] * k, 0.8, {}
    for _ in range(300):
        for p in counts:
            odds = np.log(prior / (1 - prior)) + sum((1 if c == "1" else -1) * np.log(a / (1 - a)) for c, a in zip(p, accuracy) if c != "-")
            posterior[p] = 1 / (1 + np.exp(-odds))
        cast = [sum(n for p, n in counts.items() if p[j] != "-") for j in range(k)]
        right = [sum(n * (posterior[p] if p[j] == "1" else 1 - posterior[p]) for p, n in counts.items() if p[j] != "-") for j in range(k)]
        accuracy = [min(0.99, max(0.01, (r + 8) / (c + 10))) for r, c in zip(right, cast)]
        prior = min(0.95, max(0.05, sum(n * posterior[p] for p, n in counts.items()) / len(rows)))
    for i, t in made.items():
        assert abs(got[i].posterior - posterior["".join("01-"[v] for v in quality.votes(t))]) < 1e-6
    soft = [(posterior[got[i].votes], quality.features(t), i) for i, t in made.items()]
    order = sorted(soft, key=lambda x: (x[0], np.fromiter(x[1], "<u4").tobytes(), np.fromiter(x[1].values(), "<f4").tobytes()))
    scorer = quality.fit([(np.fromiter(f, "<u4"), np.fromiter(f.values(), "<f4")) for _, f, _ in order], np.array([p for p, _, _ in order]))
    for _, f, i in soft:
        x = scorer.intercept + sum(scorer.weights[c] * float(np.float32(v)) for c, v in f.items())
        assert abs(got[i].score - 1 / (1 + np.exp(-x))) < 1e-4 and got[i].keep == int(got[i].score >= 0.5)


def test_agreement_with_the_label_table(spark):
    folder = "/root/testdata/sf0.01"
    kept = quality.classify(spark.read.parquet(f"{folder}/documents.parquet")).select("doc_id", "keep")
    both = kept.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").select("keep", "quality").collect()
    agree = np.mean([r.keep == r.quality for r in both])
    print(f"agreement with {len(both)} labels: {agree:.4f}")
    assert len(both) > 300 and agree > 0.97
