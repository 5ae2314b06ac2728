import hashlib
import random
import time
import re
from itertools import product

import numpy as np

from sheetspark.llm import pii
from sheetspark.llm.crf import Crf

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    """The patterns as they are written."""
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 12 <= len(digits) <= 19 and pii.luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


def test_base_spans_against_plain_patterns():
    rng = random.Random(8)
    fixed = ["", "a@b@c.com", "1.2.3.4.5", "1.2.3.256", "001.2.3.4", "+1 (988) 555-2485", "4041894974608795", "4041 8949-7460 8795", "x@y. z@w.de", "+123+4567890123", "1.2.3.4.5.6.7.8 9", "ä@b.de é.f@g.h"]
    made = ["".join(rng.choice(["a", "@", ".", "-", " ", "+", "(", "1", "23", "4041894974608795", "%", "é", "b.c", "255.1"]) for _ in range(rng.randint(1, 25))) for _ in range(4000)]
    for text in fixed + made:
        assert pii.base_spans(text) == plain(text), text
    for long in ("1" * 300_000, "a" * 300_000 + "@", "+1" + " " * 300_000, "a." * 100_000, "1 " * 100_000):
        pii.base_spans(long)
        pii.stretches("x" * 300_000 + long[:50])


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    crf = Crf(6, 3)
    crf.emit, crf.move, crf.first = rng.normal(size=(6, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    sequences = [[list(rng.integers(0, 6, 2)) for _ in range(n)] for n in (1, 4, 0, 5, 2, 4)]
    for s, labels in zip(sequences, crf.decode(sequences)):
        def score(path):
            return sum(crf.emit[f][y] for fs, y in zip(s, path) for f in fs) + sum(crf.move[a][b] for a, b in zip(path, path[1:])) + (crf.first[path[0]] if path else 0)

        assert tuple(labels) == max(product(range(3), repeat=len(s)), key=score)


def test_held_out_accuracy():
    model, rows = pii.train(), pii.labelled(seed=77, rows=400)
    decoded = model.crf.decode([model.features(t) for t, _ in rows])
    right = sum([pii.LABELS[i] for i in got] == want for got, (_, want) in zip(decoded, rows))
    assert right >= 0.95 * len(rows)


def test_added_spans_leave_base_ones():
    model = pii.train()
    text = "Call (988) 555-2485 now, or write 27.204.213.132 4116106959541135 end. In 1999 we had 3 of 4.0 left."
    (base, spans), = pii.find([text], model)
    assert base == plain(text) and set(base) <= set(spans)
    assert {text[a:b] for _, a, b in spans} == {"(988) 555-2485", "27.204.213.132", "4116106959541135"}
    assert pii.redact(text, spans).count("<") == 3
    words = "nothing personal here at all, only words and a dot or two. " * 50
    assert pii.find([words, None, ""], model)[1:] == [([], []), ([], [])]


def test_table(spark):
    rows = [(1, "mail bo.42@m8.example.com"), (2, None), (3, ""), (3, ""), (None, "1.2.3.4"), (4, "x " * 200_000 + "+1 988 555 2485")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, spans int")
    got = pii.detect(df).collect()
    assert len(got) == 6
    one = next(r for r in got if r.doc_id == 1)
    assert (one.n_email, one.spans) == (1, "email:5:25") and one.base_sha256 == hashlib.sha256(b"email:5:25").hexdigest()
    assert next(r for r in got if r.doc_id == 2).base_sha256 == hashlib.sha256(b"").hexdigest()
    assert next(r for r in got if r.doc_id == 4).n_phone == 1
    clean = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    assert clean[1] == "mail <email>" and clean[2] is None and clean[None] == "<ip>"
    assert pii.detect(df.limit(0)).count() == 0


def held_out(rows=600, seed=77):
    """Texts of other seeds than the training table's, and their true spans."""
    out = []
    for tokens, labels in pii.labelled(seed, rows):
        text, spans, at = "", [], 0
        for token, label in zip(tokens, labels):
            text += token + " "
            core = token.rstrip(".,")
            if label[0] == "B":
                spans.append([label[2:], at, at + len(core)])
            elif label[0] == "I":
                spans[-1][2] = at + len(core)
            at = len(text)
        out.append((text, [tuple(s) for s in spans]))
    return out


def test_the_field_finds_what_patterns_miss():
    rows = held_out()
    found = pii.find([t for t, _ in rows], pii.train())
    truth = sum(len(s) for _, s in rows)
    meets = lambda s, spans: any(k == s[0] and a < s[2] and s[1] < b for k, a, b in spans)
    by_patterns = sum(meets(s, base) for (_, spans), (base, _) in zip(rows, found) for s in spans)
    by_all = sum(meets(s, more) for (_, spans), (_, more) in zip(rows, found) for s in spans)
    added = [(s, spans) for (_, spans), (base, more) in zip(rows, found) for s in more if s not in base]
    right = sum(meets(s, spans) for s, spans in added)
    print(f"of {truth}: patterns {by_patterns / truth:.3f}, with the field {by_all / truth:.3f}; added {len(added)}, of these right {right / len(added):.3f}")
    assert by_all > by_patterns + 0.1 * truth and by_all > 0.95 * truth and right > 0.9 * len(added)


def test_dense_text_takes_time_in_proportion():
    line = "a{0}.x@h{0}.org 10.{1}.3.4 +1 415 555 {2} (at) 4{0} "

    def seconds(n):
        text = "".join(line.format(i, i % 256, 1000 + i % 9000) for i in range(n))
        began = time.perf_counter()
        (base, _), = pii.find([text], pii.train())
        assert len(base) == 3 * n
        return time.perf_counter() - began

    seconds(100)
    assert seconds(20_000) < 16 * seconds(2_500) + 2  # over a megabyte


def test_cover_against_all_spans():
    rng = random.Random(3)
    for _ in range(300):
        spans = sorted((("ip", a, a + rng.randint(1, 9)) for a in (rng.randrange(60) for _ in range(rng.randint(0, 8)))), key=lambda s: s[1])
        a = rng.randrange(60)
        b = a + rng.randint(1, 6)
        assert pii.Cover(spans).meets(a, b) == any(a < y and x < b for _, x, y in spans)
