"""Document quality from weak labels: heuristic labellers, their accuracies by EM, a hashed linear scorer.

Several heuristics look at a text and vote good, bad or not at all; they overlap and err. Their votes
are counted by pattern over the whole corpus, and expectation-maximisation estimates from the counts how
often each labeller is right, together with the share of good documents. That gives every pattern a
posterior probability of being good. A linear scorer on hashed features is then
trained on posteriors as soft labels, over a bounded sample of documents, and scores every document.

``SAMPLE`` bounds what training takes to the driver (hashed features, no texts). Patterns are at most
three to the power of the labellers, however large the corpus.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, settle, text_batches
from .linear import sigmoid

SAMPLE = 6000
WIDTH = 1 << 14
THRESHOLD = 0.5
GOOD, BAD, NONE = 1, 0, -1

_CLASS = bytes.maketrans(bytes(range(256)), bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 57 if 48 <= b <= 57 else 32 if b in (9, 10, 11, 12, 13, 32) else b for b in range(256)))
_SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_PLAIN = re.compile(rb"A?a+[.,;:!?]?|A[.,;:!?]?")
_RUN = re.compile(rb"(.)\1+", re.S)


class Text:
    """What labellers and features read: counts over the whole text."""

    def __init__(self, text: str | None):
        raw = (text or "").encode("utf-8", "surrogatepass")
        self.words = raw.split()
        self.n = len(self.words)
        self.distinct = len(set(self.words))
        self.repeats = sum(map(bytes.__eq__, self.words, self.words[1:]))  # a word right after itself
        classes = raw.translate(_CLASS)
        counts = np.bincount(np.frombuffer(classes, np.uint8), minlength=256) if raw else np.zeros(256, np.int64)
        self.lower, self.upper, self.digits, self.space = (int(counts[i]) for i in (97, 65, 57, 32))
        self.signs = len(raw) - self.lower - self.upper - self.digits - self.space
        self.stops = int(counts[46] + counts[63] + counts[33])
        self.pipes = int(counts[124])
        self.size = max(1, len(raw) - self.space)
        self.lines = [line for line in raw.split(b"\n") if line.strip()]
        self.shapes: dict[bytes, int] = {}
        for shape in classes.split():
            self.shapes[shape] = self.shapes.get(shape, 0) + 1
        kinds = [(c, _kind(shape)) for shape, c in self.shapes.items()]
        self.strewn, self.shouts, self.wordless, self.plain = (sum(c for c, kind in kinds if kind[i]) for i in range(4))


@lru_cache(20_000)
def _kind(shape: bytes) -> tuple[bool, bool, bool, bool]:
    """Whether a word ends in several signs, is of capitals only, has no letters or digits, is plain."""
    core = shape.strip(_SIGNS)
    tail = len(shape) - len(shape.rstrip(_SIGNS))
    return tail >= 2 and bool(core), len(core) > 1 and not core.strip(b"A"), not core, bool(_PLAIN.fullmatch(shape))


def repetition(t: Text) -> int:
    """Words that follow themselves."""
    return BAD if t.n >= 20 and t.repeats > 0.2 * t.n else NONE


def monotony(t: Text) -> int:
    """Few different words for a text of that length."""
    return BAD if t.n >= 40 and t.distinct < 0.55 * t.n**0.8 else NONE


def signs(t: Text) -> int:
    """Signs that are neither letters, digits nor spaces."""
    return BAD if t.n >= 5 and t.signs > 0.12 * t.size else NONE


def strewn(t: Text) -> int:
    """Words that end in several signs."""
    return BAD if t.n >= 5 and t.strewn > 0.2 * t.n else NONE


def capitals(t: Text) -> int:
    """Capital letters among letters."""
    return BAD if t.n >= 5 and t.upper > 0.35 * (t.lower + t.upper) else NONE


def shouts(t: Text) -> int:
    """Words of capital letters only."""
    return BAD if t.n >= 5 and t.shouts > 0.3 * t.n else NONE


def stops(t: Text) -> int:
    """Sentence ends for the number of words."""
    return BAD if t.n >= 10 and t.stops > 0.6 * t.n else NONE


def bars(t: Text) -> int:
    """Upright bars between words."""
    return BAD if t.pipes > 0.15 * t.n else NONE


def fragments(t: Text) -> int:
    """Words that are no letters at all."""
    return BAD if t.n >= 10 and t.wordless > 0.2 * t.n else NONE


def lines(t: Text) -> int:
    """Lines that are there again."""
    return BAD if len(t.lines) >= 4 and len(set(t.lines)) < 0.6 * len(t.lines) else NONE


def prose(t: Text) -> int:
    """Sentences of words of usual length, few of them strewn with signs or shouted."""
    mean = t.size / max(1, t.n)
    calm = t.strewn + t.shouts + t.wordless < 0.1 * t.n and t.repeats < 0.1 * t.n
    return GOOD if t.n and calm and 0 < t.stops < 0.35 * t.n and 2.5 < mean < 11 and t.signs < 0.08 * t.size else NONE


def varied(t: Text) -> int:
    """Different words, none right after itself, written as words are."""
    written = t.strewn + t.shouts + t.wordless < 0.1 * t.n
    return GOOD if t.n >= 5 and written and t.distinct > 0.6 * t.n**0.8 and t.repeats < 0.05 * t.n else NONE


def plain(t: Text) -> int:
    """Words of small letters, with a capital first or a stop behind, not over and over."""
    return GOOD if t.n and t.plain > 0.85 * t.n and t.repeats < 0.1 * t.n and t.distinct > 0.45 * t.n**0.8 else NONE


LABELLERS = (repetition, monotony, signs, strewn, capitals, shouts, stops, bars, fragments, lines, prose, varied, plain)


def votes(t: Text) -> list[int]:
    return [f(t) for f in LABELLERS]


def features(t: Text) -> dict[int, float]:
    """Hashed features of a text: shares of word shapes, and the sizes of its counts."""
    out: dict[int, float] = {}
    n = max(1, t.n)
    kinds: dict[bytes, int] = {}
    for s, c in t.shapes.items():
        kind = _RUN.sub(rb"\1\1", s[:40])
        kinds[kind] = kinds.get(kind, 0) + c
    for kind, c in kinds.items():
        key = zlib.crc32(kind) % WIDTH
        out[key] = out.get(key, 0.0) + (c / n) ** 0.5
    shares = {
        "repeats": t.repeats / n, "variety": t.distinct / n**0.8, "signs": t.signs / t.size, "capitals": t.upper / max(1, t.upper + t.lower), "stops": t.stops / n,
        "pipes": t.pipes / n, "lines": len(set(t.lines)) / max(1, len(t.lines)), "length": t.size / n / 10, "words": min(1.0, t.n / 1000),
    }
    for name, value in shares.items():  # how large a share is, in tenths, as steps
        for step in range(1, 1 + min(10, int(value * 10))):
            key = zlib.crc32(f"{name} {step}".encode()) % WIDTH
            out[key] = out.get(key, 0.0) + 1.0
    return out


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns: each pattern's posterior of good, each labeller's accuracy, the share of good.

    A labeller that does not vote says nothing; one that votes is right with its accuracy, whichever class
    the document is of, independently of the others given the class. All begin with an accuracy of 0.8, and
    each is smoothed by ten votes at that accuracy; it may fall as low as the votes say, below a half for one
    that is wrong more often than right, whose votes then count against themselves. The two classes are told
    apart by that beginning: if most votes came out as wrong, the classes are swapped.
    """
    n, k = patterns.shape
    accuracy, prior = np.full(k, 0.8), 0.8
    if not n:
        return np.zeros(0), accuracy, prior
    good, bad = (patterns == GOOD).astype(float), (patterns == BAD).astype(float)
    cast = counts @ (good + bad)
    posterior = np.zeros(n)
    for _ in range(rounds):
        odds = np.log(accuracy / (1 - accuracy))
        new = sigmoid(np.log(prior / (1 - prior)) + good @ odds - bad @ odds)
        right = counts @ (good * new[:, None] + bad * (1 - new[:, None]))
        accuracy = np.clip((right + 8) / (cast + 10), 0.01, 0.99)
        prior = float(np.clip((counts @ new) / counts.sum(), 0.05, 0.95))
        if np.abs(new - posterior).max() < 1e-9:
            break
        posterior = new
    if cast.sum() and (cast @ accuracy) < 0.5 * cast.sum():
        new, accuracy, prior = 1 - new, 1 - accuracy, 1 - prior
    return new, accuracy, prior


class Scorer:
    """Weights of the hashed features and an intercept."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept

    def score(self, found: dict[int, float]) -> float:
        return float(self.scores([np.array(list(found), np.int64)], [np.array(list(found.values()))])[0])

    def scores(self, cols: list[np.ndarray], values: list[np.ndarray]) -> np.ndarray:
        """The scores of documents by their features' numbers and values."""
        owner = np.repeat(np.arange(len(cols)), [len(c) for c in cols])
        flat = np.concatenate([*cols, np.zeros(0, np.uint32)]).astype(np.int64)
        weighted = self.weights[flat] * np.concatenate([*values, np.zeros(0)]).astype(np.float64)
        return sigmoid(self.intercept + np.bincount(owner, weighted, len(cols)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], soft: np.ndarray, decay: float = 1e-4, rounds: int = 200, rate: float = 0.5) -> Scorer:
    """A scorer from (feature numbers, values) and soft labels, by full-batch steps scaled per weight, classes balanced."""
    if not rows:
        return Scorer(np.zeros(WIDTH), 0.0)
    cols = np.concatenate([c for c, _ in rows]).astype(np.int64)
    values = np.concatenate([v for _, v in rows]).astype(np.float64)
    owner = np.repeat(np.arange(len(rows)), [len(c) for c, _ in rows])
    good = max(1e-9, soft.sum())
    bad = max(1e-9, len(soft) - soft.sum())
    w, b, sums, b_sum = np.zeros(WIDTH), 0.0, np.full(WIDTH, 1e-8), 1e-8
    for _ in range(rounds):
        p = sigmoid(np.bincount(owner, w[cols] * values, len(rows)) + b)
        # each class has half the weight
        miss = soft * (1 - p) / good - (1 - soft) * p / bad
        g = np.bincount(cols, miss[owner] * values, WIDTH) - decay * w
        sums += g * g
        w += rate * g / np.sqrt(sums)
        b_sum += miss.sum() ** 2
        b += rate * miss.sum() / b_sum**0.5
    return Scorer(w, float(b))


def featured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, words, pattern, cols, vals): the votes of every document as a string of 0, 1 and -, and its features."""

    def run(batches):
        import pyarrow as pa

        for batch in text_batches(batches):
            words, patterns, cols, vals = [], [], [], []
            for text in batch.column(1).to_pylist():
                t = Text(text)
                found = features(t)
                words.append(t.n)
                patterns.append("".join("01-"[v] for v in votes(t)))
                cols.append(np.fromiter(found, "<u4").tobytes())
                vals.append(np.fromiter(found.values(), "<f4").tobytes())
            columns = [pa.array(words, pa.int64()), pa.array(patterns, pa.string()), pa.array(cols, pa.binary()), pa.array(vals, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "words", "pattern", "cols", "vals"])

    chosen = pick(docs, doc_id=id_col, text=text_col).selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    return chosen.mapInArrow(run, "doc_id long, words long, pattern string, cols binary, vals binary")


def decoded(pattern: str) -> list[int]:
    return [{"0": BAD, "1": GOOD, "-": NONE}[c] for c in pattern]


def train(found: DataFrame, posterior: DataFrame, sample: int = SAMPLE) -> Scorer:
    """A scorer from a sample of ``featured`` documents by a hash of their ids: half of those whose pattern is likelier bad, if there are so many.

    Of rows with the same id one is used.
    """
    judged = found.select("doc_id", "pattern").join(F.broadcast(posterior), "pattern").where("doc_id is not null").dropDuplicates(["doc_id"])
    order = F.xxhash64(F.lit(3), "doc_id")
    half = judged.where("posterior < 0.5").orderBy(order, "doc_id").limit(sample // 2)
    rest = judged.where("posterior >= 0.5").orderBy(order, "doc_id").limit(sample - sample // 2)
    chosen = F.broadcast(half.unionByName(rest).select("doc_id", "pattern", "posterior"))  # at most ``sample`` rows
    rows = found.join(chosen, ["doc_id", "pattern"]).groupBy("doc_id").agg(F.min(F.struct("posterior", "cols", "vals")).alias("x")).select("x.*")
    rows = sorted(rows.collect(), key=tuple)
    return fit([(np.frombuffer(bytes(r[1]), "<u4"), np.frombuffer(bytes(r[2]), "<f4")) for r in rows], np.array([r[0] for r in rows]))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, votes, posterior (of its vote pattern), score (the scorer's), keep (0 or 1).

    Texts are read once: their votes and hashed features are settled, and all that follows reads those.

    Defined cases: a null or empty text has no words, so no labeller votes, and it is not
    kept; repeated rows get equal values; a null id is carried along; an empty table gives no rows; other
    columns are not read.
    """
    spark = docs.sparkSession
    found = settle(featured(docs, id_col, text_col))
    counts = sorted((r["pattern"], r["n"]) for r in found.groupBy("pattern").agg(F.count("*").alias("n")).collect())  # at most 3 ** labellers
    names = [p for p, _ in counts]
    posterior, _, _ = estimate(np.array([decoded(p) for p in names]).reshape(len(names), len(LABELLERS)), np.array([n for _, n in counts], float))
    by_pattern = dict(zip(names, map(float, posterior)))
    table = spark.createDataFrame(list(by_pattern.items()), "pattern string, posterior double")
    shared = spark.sparkContext.broadcast((train(found, table, sample), by_pattern))

    def run(batches):
        import pyarrow as pa

        scorer, known = shared.value
        for batch in batches:
            scores = scorer.scores([np.frombuffer(c, "<u4") for c in batch.column(3).to_pylist()], [np.frombuffer(v, "<f4") for v in batch.column(4).to_pylist()])
            keep = (batch.column(1).to_numpy() > 0) & (scores >= threshold)
            told = pa.array([known[p] for p in batch.column(2).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), told, pa.array(scores, pa.float64()), pa.array(keep.astype(np.int64))], ["doc_id", "votes", "posterior", "score", "keep"])

    return found.mapInArrow(run, "doc_id long, votes string, posterior double, score double, keep long")
