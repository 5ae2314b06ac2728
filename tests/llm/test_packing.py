import itertools
import random
import unicodedata
import zlib
from collections import defaultdict

import numpy as np

from sheetspark.llm.common import tokenizer_path
from sheetspark.llm.packing import Packer, closest_multiset, pack
from sheetspark.llm.wordpiece import _ODD, Remembered, WordIds, is_odd


def check(pieces, documents, window):
    """Every id once, gapless offsets, right sums, no padding."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for doc_id, start, length, crc, total, seq, offset in pieces:
        ids = documents[doc_id]
        assert total == len(ids) // 4 and length > 0
        assert crc == zlib.crc32(ids[start * 4 : (start + length) * 4])
        by_doc[doc_id].append((start, length))
        by_seq[seq].append((offset, length))
    assert set(by_doc) == set(documents)
    for spans in [*by_doc.values(), *by_seq.values()]:
        at = 0
        for a, n in sorted(spans):
            assert a == at
            at += n
    sums = [sum(n for _, n in v) for v in by_seq.values()]
    assert max(sums, default=0) <= window
    assert all(s == window or s & (s - 1) == 0 for s in sums)


def test_closest_multiset_against_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        counts = {rng.randint(1, 20): rng.randint(1, 3) for _ in range(rng.randint(0, 5))}
        space = rng.randint(0, 60)
        taken = closest_multiset(counts, space)
        assert all(k <= counts[n] for n, k in taken.items())
        best = max(s for ks in itertools.product(*[range(c + 1) for c in counts.values()]) if (s := sum(n * k for n, k in zip(counts, ks))) <= space)
        assert sum(n * k for n, k in taken.items()) == best


def test_packer_keeps_every_id():
    rng = random.Random(3)
    for sizes in ([], [1], [64] * 9, [1] * 300, [rng.randint(1, 400) for _ in range(500)], [63] * 200):
        docs = {i: np.arange(n, dtype="<u4").tobytes() for i, n in enumerate(sizes)}
        packer = Packer(0, window=64, waiting=16)
        pieces = [p for i, ids in docs.items() for p in packer.add(i, ids)] + list(packer.finish())
        check(pieces, docs, 64)


def test_word_ids_are_the_tokenizers():
    words, rng = WordIds(tokenizer_path("word_bpe_49k.json")), random.Random(1)
    letters = "abcÉéñßÑ '’`sStTdDmM.,!?0123½²|-_\n\t\xa0\x85\x1cǆǅĀāſΣς日́"
    texts = ["", "it's WE'RE ''s", "<|endoftext|> x", "naïve café"] + ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(500)]
    for text in texts:
        assert np.frombuffer(words.encode(text), "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


def test_pack_table(spark):
    words = WordIds(tokenizer_path("word_bpe_49k.json"))
    texts = {1: "a b c " * 4000, 2: None, 3: "", 4: "Same text.", 5: "Same text.", 6: "x" * 50_000}
    rows = [(i, t, i, "clash") for i, t in texts.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int, sequence_id string")
    got = [tuple(r) for r in pack(df).collect()]
    check(got, {i: words.encode(t or "") + (2).to_bytes(4, "little") for i, t in texts.items()}, 4096)
    assert pack(df.limit(0)).count() == 0


def test_word_ids_cost_one_look_up_a_word_and_one_call_a_new_piece():
    words, asked = WordIds(tokenizer_path("word_bpe_49k.json")), []
    assert all(words.spelled[c] == chr(c) for c in range(0x21, 0x7F))
    model, words.model = words.model, type("Model", (), {"tokenize": lambda _, p: asked.append(p) or model.tokenize(p)})()
    texts = ["Heated words, heated", "words heated; é words."] * 3
    for text in texts:
        assert np.frombuffer(words.encode(text), "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids
    assert sorted(asked) == sorted(set(asked)) and len(asked) == 6
    assert {w for t in texts for w in t.lower().split()} <= set(words.known)


def test_remembered_words_are_bounded_and_right():
    learned = []
    known = Remembered(lambda k: learned.append(k) or k.encode(), 3)
    for key in "abcabcdabeabfgaxya":
        assert known[key] == key.encode()
        assert len(known) <= 3 and len(known.old) <= 3
    assert learned.count("a") == 1  # what is used stays


def test_odd_texts_are_those_of_the_pattern():
    for c in map(chr, range(0x300)):
        for text in (c, f"a{c}b", f"日{c}", f"ā{c}"):
            assert is_odd(text) == bool(_ODD.search(text))
            assert is_odd(text) or unicodedata.is_normalized("NFC", text * 2)
    assert is_odd("a <|x|>") and not is_odd("a < | b") and is_odd("\ud800")
