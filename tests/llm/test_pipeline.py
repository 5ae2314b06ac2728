import random
import zlib
from collections import defaultdict

import pytest

import corpus_pipeline
from sheetspark.llm import mixing, neardup, pii, toxicity
from sheetspark.llm.common import settle, tokenizer_path
from sheetspark.llm.wordpiece import WordIds

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Small tables: clean, toxic, copied and personal documents, nulls, an extra column."""
    rng, rows, labels = random.Random(2), [], []
    for i in range(400):
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 8))) for _ in range(rng.randint(30, 200))]
        bad = i % 8 == 0
        for _ in range(4 if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["zonk", "murk", "grub"]))
        if i % 5 == 1:
            words.insert(3, "bo.42@m8.example.com")
        rows.append((i, " ".join(words), rng.choice(["en", "de"]), rng.choice(["s0", "s1"])))
        labels.append((i, 1, int(bad)))
    rows += [(1000 + k, rows[k][1] + (" more" if k % 2 else ""), "en", "s0") for k in range(1, 40) if k % 8]
    rows += [(2000, None, None, None), (2001, "", "en", "s0"), (3, rows[3][1], rows[3][2], rows[3][3])]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels, categories = toxicity.category_labels(spark.read.parquet(f"{folder}/labels.parquet"))
    chain = toxicity.train(docs, labels, categories)

    clean = settle(corpus_pipeline.toxicity_stage(spark, docs, folder))
    tokens = toxicity.Tokens(chain.used)
    want = sorted((tuple(r) for r in docs.collect() if not (r.text or "").strip() or chain.predict(tokens.of(r.text))[-1] < toxicity.THRESHOLD), key=str)
    assert sorted((tuple(r) for r in clean.collect()), key=str) == want and clean.columns == COLUMNS
    assert not {r[0] for r in want} & set(range(0, 400, 8)) and len(want) >= 380

    single = settle(corpus_pipeline.near_dedup_stage(spark, clean, folder))
    # the stage's contract: five-word shingles, a Jaccard similarity of 0.8 or more, one row of each component
    left = sorted(clean.collect(), key=lambda r: (r.doc_id, r.text or ""))
    grams = [set(neardup.shingles(r.text)) for r in left]
    label = list(range(len(left)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(grams):
        for j in range(i):
            b = grams[j]
            if not a and not b or a and b and 5 * len(a & b) >= 4 * len(a | b):
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    assert sorted(r.doc_id for r in single.collect()) == sorted(left[i].doc_id for i in {root(i) for i in label}) and single.columns == COLUMNS

    hidden = settle(corpus_pipeline.pii_stage(spark, single, folder))
    model = pii.train()
    texts = {r.doc_id: r.text for r in single.collect()}
    for r in hidden.collect():
        old = texts[r.doc_id]
        assert r.text == (None if old is None else pii.redact(old, pii.find([old], model)[0][1]))
        assert r.n_chars == (None if r.text is None else len(r.text))
    assert hidden.count() == len(texts) and hidden.columns == COLUMNS

    mixed = settle(corpus_pipeline.mixing_stage(spark, hidden, folder))
    drawn = {r.doc_id for r in mixing.mix(hidden).collect() if r.sampled}
    assert {r.doc_id for r in mixed.collect()} == drawn and mixed.columns == COLUMNS

    words = WordIds(tokenizer_path("word_bpe_49k.json"))
    ids = {r.doc_id: words.encode(r.text or "") + (2).to_bytes(4, "little") for r in mixed.collect()}
    spans = defaultdict(list)
    for p in corpus_pipeline.packing_stage(spark, mixed, folder).collect():
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start * 4 : (p.start + p.length) * 4])
        spans[p.doc_id].append((p.start, p.length))
    assert {i: sum(n for _, n in s) for i, s in spans.items()} == {i: len(b) // 4 for i, b in ids.items()}


def test_run_and_empty_tables(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 0
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
