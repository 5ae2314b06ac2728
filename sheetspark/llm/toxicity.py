"""Toxicity by a chain of linear classifiers.

The categories are predicted one after the other. The first model sees the words of a text; each later
one sees them and the probabilities of all earlier categories. For training those come out of fold
(by models that did not see the document), so that later models learn from probabilities as they will
be, not from ones fitted to the same labels; for prediction the models fitted on all rows give them.

A text's features are the set of its words, of their first four and five letters (for words that are
put together from parts) and of the shapes of what is written with other signs than letters, and which
of these two, four or eight different words of the text share. The whole text counts, and no feature is divided by
its length, so length thins nothing out. Weights are L1-penalised, which leaves the few hundred that tell.

Training takes at most ``sample`` labelled documents (the parameter bounds what reaches the driver:
hashed features, no texts), half of them for the last category if there are so many, chosen by a hash
of their ids.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, pick, text_batches, text_slices
from .linear import Rows, fit, out_of_fold, sigmoid

#: Labelled documents used for training at most.
SAMPLE = 6000
PENALTY = 0.003
THRESHOLD = 0.5

_CORE = re.compile(r"[^\W\d_]+")
#: Signs of ASCII that are no letters.
_MARKS = "".join(c for c in map(chr, range(128)) if not c.isalpha())
_OTHER = str.maketrans({c: "0" for c in "123456789"})


def token_features(token: str) -> list[int]:
    """Hashes of a token's features."""
    out = []
    core = token.strip(_MARKS) if token.isascii() else ""
    if core.isalpha():  # a word with signs around it, as nearly all tokens are
        cores, at = (core.lower(),), token.index(core)
        framed = f"{token[:at]}a{token[at + len(core) :]}" if len(core) < len(token) else ""
    else:
        cores, framed = _CORE.findall(token.lower()), "" if token.isalpha() else token
    for core in cores:
        raw = core.encode("utf-8", "surrogatepass")
        out.append(zlib.crc32(raw))
        for n in (4, 5):
            if len(core) >= n:
                out.append(zlib.crc32(b"%d" % n + (raw[:n] if len(raw) == len(core) else core[:n].encode("utf-8", "surrogatepass"))))
    if framed:
        out.append(_shape(framed))
    elif len(token) > 2 and token.isupper():
        out.append(zlib.crc32(b"upper"))
    return out


@lru_cache(10_000)
def _shape(token: str) -> int:
    """The hash of a token's shape: words as one letter, digits as one digit, runs of signs as two."""
    shape = _CORE.sub("a", token.translate(_OTHER))
    return zlib.crc32(b"s" + re.sub(r"(.)\1+", r"\1+", shape)[:16].encode("utf-8", "surrogatepass"))


_FACTOR = 0x9E3779B1


def shared(feature: int, words: int) -> int:
    """The feature "``words`` different words have ``feature``"."""
    return (feature * _FACTOR + words) & 0xFFFFFFFF


def levels_of(feature: int) -> tuple[int, int, int, int]:
    """What a feature becomes when 1, 2, 4 or 8 words have it."""
    return feature, shared(feature, 2), shared(feature, 4), shared(feature, 8)


class Tokens:
    """Features of texts; those of tokens are remembered up to a bound. ``only`` keeps those that a model uses."""

    def __init__(self, only: set[int] | None = None, limit: int = 100_000):
        self.only, self.limit, self.known = only, limit, {}
        self.blank: set[str] = set()  # tokens without a feature that is used: nearly all, so they are taken off at once
        if only is not None:
            back = pow(_FACTOR, -1, 1 << 32)
            roots = {u for u in only} | {(u - words) * back & 0xFFFFFFFF for u in only for words in (2, 4, 8)}
            self.used = {f: tuple(x if x in only else 0 for x in levels_of(f)) for f in roots}

    def _of_token(self, token: str) -> list[tuple[int, ...]]:
        """Each feature of the token with what it becomes when 1, 2, 4 or 8 words have it; 0 where that isn't used."""
        if self.only is None:
            return [levels_of(f) for f in set(token_features(token))]
        used = self.used
        return [used[f] for f in {*token_features(token)} if f in used]

    def of(self, text: str | None) -> set[int]:
        known, counts = self.known, {}
        for token in set((text or "").split()) - self.blank:
            if (found := known.get(token)) is None:
                found = self._of_token(token)
                held = known if found else self.blank
                if len(held) >= self.limit:
                    held.clear()
                if found:
                    known[token] = found
                else:
                    self.blank.add(token)
            for levels in found:
                counts[levels] = counts.get(levels, 0) + 1
        out = {f for levels, n in counts.items() for f in levels[: min(n, 8).bit_length()]}
        out.discard(0)
        return out


class Chain:
    """Fitted models: for each category the weights by feature, of earlier probabilities, and the intercept."""

    def __init__(self, categories: list[str], models: list[tuple[dict[int, float], list[float], float]]):
        self.categories, self.models = categories, models

    @property
    def used(self) -> set[int]:
        return {f for weights, _, _ in self.models for f in weights}

    def predict(self, features: set[int]) -> list[float]:
        """The probability of each category in turn."""
        out: list[float] = []
        for weights, earlier, intercept in self.models:
            x = intercept + sum(weights.get(f, 0.0) for f in features) + sum(w * p for w, p in zip(earlier, out))
            out.append(float(sigmoid(np.float64(x))))
        return out


def common_features(features: list[np.ndarray]) -> np.ndarray:
    """Features of at least three rows and of fewer than nine tenths of them, in order; a row has a feature once."""
    everything = np.concatenate([np.zeros(0, np.uint32), *features])
    everything.sort()
    names = np.unique(everything[2:][everything[2:] == everything[:-2]])
    counts = np.searchsorted(everything, names, "right") - np.searchsorted(everything, names)
    return names[counts < 0.9 * max(1, len(features))]


def fit_chain(features: list[np.ndarray], labels: np.ndarray, categories: list[str], penalty: float = PENALTY, folds: int = 4) -> Chain:
    """A chain over rows of feature hashes; ``labels`` is rows x categories, 0 or 1.

    Features in fewer than three rows are left out. Rows with the same features are in one fold.
    """
    n, names, columns, fold = len(features), common_features(features), [], []
    for f in features:
        at = np.searchsorted(names, f)
        at[at == len(names)] = 0
        column = at[names[at] == f] if len(names) else np.zeros(0, np.int64)
        fold.append(zlib.crc32(column.tobytes()) % folds)
        columns.append(column.astype(np.int32))
    del features  # the driver holds them twice no longer than it has to
    fold = np.array(fold, int)
    earlier, models = np.zeros((n, 0)), []
    for k, _ in enumerate(categories):
        y = labels[:, k].astype(float)

        # a feature whose slope at zero is far below the penalty would not get a weight
        share = np.where(y > 0, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, len(y) - y.sum()))
        slope = np.zeros(len(names))
        for c, s in zip(columns, share * (0.5 - y)):
            slope[c] += s
        screened = np.flatnonzero(np.abs(slope) >= penalty / 2)
        place = np.full(len(names), -1)
        place[screened] = np.arange(len(screened))
        narrow = [p[p >= 0] for p in (place[c] for c in columns)]

        def x_of(rows, dense=earlier, narrow=narrow, width=len(screened)):
            return Rows([narrow[i] for i in rows], width, dense[rows])

        w, b = fit(x_of(np.arange(n)), y, penalty)
        kept = np.flatnonzero(w[: len(screened)])
        models.append(({int(names[screened[i]]): float(w[i]) for i in kept}, [float(v) for v in w[len(screened) :]], float(b)))
        if k + 1 < len(categories):
            earlier = np.column_stack([earlier, out_of_fold(x_of, y, fold, penalty)])
    return Chain(categories, models)


def train(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, penalty: float = PENALTY) -> Chain:
    """A chain from documents and a table of labels (id, one column of 0 or 1 for each category).

    Rows without text, id or a label are not used. No labelled rows: a chain that says 0 always.
    """
    labelled = pick(labels, doc_id=id_col, **{f"y{k}": c for k, c in enumerate(categories)}).dropna()
    last = f"y{len(categories) - 1}"
    order = F.xxhash64("doc_id")
    half = labelled.where(F.col(last) > 0).orderBy(order, "doc_id").limit(sample // 2)
    rest = labelled.where(F.col(last) <= 0).orderBy(order, "doc_id").limit(sample - sample // 2)
    chosen = F.broadcast(half.unionByName(rest).dropDuplicates(["doc_id"]))  # at most ``sample`` rows
    texts = pick(docs, doc_id=id_col, text=text_col).where("text is not null").join(chosen, "doc_id").select("doc_id", *[f"y{k}" for k in range(len(categories))], "text")

    def run(batches):
        import pyarrow as pa

        tokens = Tokens()
        for batch in text_batches(batches):
            packed = [np.array(sorted(tokens.of(t)), "<u4").tobytes() for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), *batch.columns[1:-1]], ["f", *batch.schema.names[1:-1]])

    fields = ", ".join(f"y{k} {labelled.schema[f'y{k}'].dataType.simpleString()}" for k in range(len(categories)))
    rows = sorted(texts.mapInArrow(run, f"f binary, {fields}").collect(), key=tuple)
    y = np.array([[int(r[1 + k] > 0) for k in range(len(categories))] for r in rows]).reshape(len(rows), len(categories))
    chain = fit_chain([np.frombuffer(bytes(rows.pop()[0]), "<u4") for _ in range(len(rows))][::-1], y, categories, penalty)
    give_back()
    return chain


def classify(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, p_<category> for each category, rejected (the last category's decision).

    Defined cases: a null or empty text has no features, so it gets the intercepts' probabilities but is
    never rejected; repeated rows get equal values; a null id is carried along; an empty table gives no
    rows; other columns are not read.
    """
    names = [f"p_{c}" for c in chain.categories]
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        import pyarrow as pa

        model = shared.value
        tokens = Tokens(model.used)
        for batch in text_batches(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                p = model.predict(tokens.of(text))
                rows.append((*p, int(bool(text and text.strip()) and p[-1] >= threshold)))
            columns = [pa.array(c, pa.float64()) for c in zip(*[r[:-1] for r in rows])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array([r[-1] for r in rows], pa.int64())], ["doc_id", *names, "rejected"])

    schema = "doc_id long, " + ", ".join(f"{n} double" for n in names) + ", rejected long"
    return pick(docs, doc_id=id_col, text=text_col).selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, schema)


def kept(docs: DataFrame, chain: Chain, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that ``classify`` would not reject, as they are.

    Defined cases: null, empty and blank texts stay; repeated rows go or stay together; an empty table gives
    no rows; other columns are carried along.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    tokens: list[Tokens] = []

    @F.arrow_udf("boolean")
    def clean(texts):
        import pyarrow as pa

        model = shared.value
        if not tokens:
            tokens.append(Tokens(model.used))
        out = [not t or not t.strip() or model.predict(tokens[0].of(t))[-1] < threshold for part in text_slices(texts) for t in part.to_pylist()]
        return pa.array(out, pa.bool_())

    return docs.where(clean(F.col(f"`{text_col}`").cast("string")))


def category_labels(labels: DataFrame, id_col: str = "doc_id", last: str = "toxic") -> tuple[DataFrame, list[str]]:
    """The columns of a label table as categories in chain order: low quality, any others, then toxic.

    Low quality is no category of toxicity; it stands first because the test tables have no other beside
    ``toxic``, and later models may learn from it. A table with more columns of 0 and 1 brings more
    categories, in the order of its columns.
    """
    more = [c for c in labels.columns if c not in (id_col, "quality", last)]
    low = [(1 - F.col("quality")).alias("low_quality")] if "quality" in labels.columns else []
    return labels.select(F.col(f"`{id_col}`").alias("doc_id"), *low, *[F.col(f"`{c}`") for c in (*more, last)]), [*(["low_quality"] if low else []), *more, last]
