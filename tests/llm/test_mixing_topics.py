import numpy as np

from sheetspark.llm import mixing


def texts(n):
    """Far more texts than 2000; one in 500 is of a vocabulary of its own."""
    rng = np.random.default_rng(3)
    words = [[f"{k}{i}" for i in range(60)] for k in ("sport", "law", "cook", "rare")]
    kinds = [3 if i % 500 == 7 else int(k) for i, k in enumerate(rng.integers(0, 3, n))]
    return kinds, [" ".join(rng.choice(words[k] + ["the", "of"], 40)) for k in kinds]


def test_topics_are_fitted_on_all_texts_and_alike_in_tasks(spark):
    _, made = texts(4000)
    df = spark.createDataFrame([(t,) for t in made], "text string").select(mixing.counted("text").alias("m")).select("m.bits")
    here, there = mixing.fit_topics(df, 10_000), mixing.fit_topics(df.repartition(3), 100)
    assert np.array_equal(here.weights, there.weights)
    # rarity is that of all texts: a word's weight tells in how many it is
    less = mixing.cluster([mixing.columns_of(set(t.encode().split())) for t in made[:2000]])
    assert not np.array_equal(here.weights, less.weights)


def test_queries_do_not_read_a_sample(spark):
    _, made = texts(3000)
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(made + ["", " ", None])], "doc_id long, text string, lang string, source string")
    topics = mixing.cluster([mixing.columns_of(set(t.encode().split())) for t in made])
    got = {r.doc_id: r.topic for r in mixing.mix(df).collect()}
    assert got == {i: mixing.measure(t, topics)[1] for i, t in enumerate(made + ["", " ", None])}
