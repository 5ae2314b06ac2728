import numpy as np

from sheetspark.llm import mixing

#: 400 sources: far more than 256, most of them equally large.
CELLS = [(f"s{i}", lang, t, 100 + 900 * (i < 20)) for i in range(400) for lang in ("en", "de") for t in (0, 1)]


def test_targets_of_all_sources_are_met(spark):
    stats = spark.createDataFrame(CELLS, "source string, lang string, topic int, tokens long")
    targets = {"source": {f"s{i}": (1 + i % 3) / 799 for i in range(400)}}
    budget = 0.1 * sum(c[3] for c in CELLS)
    weights = {k: v * budget / sum(targets["source"].values()) for k, v in targets["source"].items()}
    for local in (mixing.LOCAL, 10):  # on the driver, as a table
        got = {(r.source_class, r.lang_class, r.topic): r.probability for r in mixing.plan(stats, 0.1, targets, local).collect()}
        assert len(got) == len(CELLS)
        for i in range(400):
            drawn = sum(n * got[s, lang, t] for s, lang, t, n in CELLS if s == f"s{i}")
            assert np.isclose(drawn, weights[f"s{i}"])


def test_equal_sources_are_drawn_alike_and_table_equals_driver(spark):
    rng = np.random.default_rng(2)
    cells = [(*c[:3], int(rng.integers(50, 150)) if int(c[0][1:]) < 40 else c[3]) for c in CELLS] + [("empty", "en", 0, 0), (None, "en", 1, 70)]
    stats = spark.createDataFrame(cells, "source string, lang string, topic int, tokens long")
    one, two = ({tuple(r)[:3]: r.probability for r in mixing.plan(stats, 0.6, None, local).collect()} for local in (mixing.LOCAL, 10))
    assert one.keys() == two.keys() and all(np.isclose(one[k], two[k], rtol=1e-5) for k in one)
    assert one["empty", "en", 0] == 0.6 and (mixing.NONE, "en", 1) in one
    for t in (0, 1):
        assert len({round(one[f"s{i}", "de", t], 12) for i in range(40, 400)}) == 1
