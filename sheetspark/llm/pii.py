"""Personal data in texts: fixed base patterns, and further spans by a conditional random field.

Base spans are those of four patterns, leftmost and non-overlapping for each kind; a match that fails
its check is dropped and the search goes on behind it. The patterns are searched so that no text,
however long its runs of letters or digits, takes more than time in proportion.

The field reads the stretches of a text around tokens that hold a digit, an at sign or a spelled-out
one ("(at)", "[dot]", "dot"): words apart from those cannot be of these kinds. Its features are the
shapes of a token and of its neighbours; it is trained from a small labelled table that ``labelled``
makes from written forms and seeds, and decoded by Viterbi in batches. It finds data in other forms
than the patterns': phone numbers without a plus sign, spelled-out addresses. Spans that it adds never
overlap base spans, which all stay.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import DataFrame

from .common import pick, text_batches, text_slices
from .crf import Crf

#: The kinds in their order, and the parts of their patterns.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match never begins within a run of digits, as the run's first digit would have begun it
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            end = domain.end()
            out.append((begin, end))
        at = text.find("@", max(end, at + 1))
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind; code points, end exclusive."""
    found = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                found.append(("card", m.start(), m.end()))
        if "+" in text:
            found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found, key=_by_start)


def _by_start(span: tuple[str, int, int]) -> tuple[int, int]:
    return span[1], KINDS.index(span[0])


# --- the field -------------------------------------------------------------------------------------

LABELS = ("O", *[f"{p}-{k}" for k in KINDS for p in "BI"])
_MARK = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
_SPELLED = re.compile(r"[\[(](?:at|dot)[\])]|\bdot\b")
_TOKEN = re.compile(r"\S+")
_EDGES = ".,;:!?\"'"
#: Tokens between marked ones that stay in one stretch, and tokens read before and after it.
GAP, AROUND = 3, 2


def token_shape(token: str) -> str:
    """Digits as 9 and letters as a, runs as one sign, the rest as it is."""
    return re.sub(r"a+", "a", re.sub(r"9+", "9", re.sub(r"[^\W\d_]", "a", re.sub(r"[0-9]", "9", token))))[:24]


def token_class(token: str) -> str:
    """A coarse class, which neighbours see."""
    digits = sum(c.isdigit() for c in token)
    if "@" in token:
        return "@"
    if token.lower() in ("(at)", "[at]", "at"):
        return "at"
    if token.lower() in ("(dot)", "[dot]", "dot"):
        return "dot"
    if not digits:
        return "word" if token.isalpha() else "other"
    size = "1" if digits == 1 else "2" if digits == 2 else "3" if digits == 3 else "4" if digits == 4 else "8" if digits <= 8 else "11" if digits <= 11 else "19" if digits <= 19 else "20"
    kind = "d" if token.isdigit() else "p" if not any(c.isalpha() for c in token) else "x"
    return kind + size + token[0] * (token[0] in "+(")


def token_names(token: str) -> list[str]:
    """Names of a token's own features."""
    core = token.strip(_EDGES)
    digits = [c for c in core if c.isdigit()]
    out = ["any", "shape " + token_shape(core), "class " + token_class(core), f"end {token[-1] in ',.;:!?'}"]
    if core.isascii() and 12 <= len(digits) <= 19:
        out.append(f"luhn {luhn(''.join(digits))}")
    parts = core.split(".")
    if len(parts) > 2 and all(p.isdigit() for p in parts):
        out.append(f"parts {len(parts)} {all(map(_small, parts))}")
    return out


class Model:
    """The fitted field and its features' numbers."""

    def __init__(self, numbers: dict[str, int], crf: Crf):
        self.numbers, self.crf, self.known = numbers, crf, {}

    def _own(self, token: str) -> tuple[str, list[int]]:
        if token not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[token] = token_class(token.strip(_EDGES)), [self.numbers[n] for n in token_names(token) if n in self.numbers]
        return self.known[token]

    def features(self, tokens: list[str]) -> list[list[int]]:
        own = [self._own(t) for t in tokens]
        classes = ["none", *[c for c, _ in own], "none"]
        look = self.numbers.get
        return [
            f + [n for n in (look("before " + classes[i]), look("after " + classes[i + 2])) if n is not None] or [0]
            for i, (_, f) in enumerate(own)
        ]


def names_of(tokens: list[str]) -> list[list[str]]:
    """Names of all features of a sequence's tokens."""
    classes = ["none", *[token_class(t.strip(_EDGES)) for t in tokens], "none"]
    return [token_names(t) + ["before " + classes[i], "after " + classes[i + 2]] for i, t in enumerate(tokens)]


def labelled(seed: int = 11, rows: int = 1000) -> list[tuple[list[str], list[str]]]:
    """The labelled table: tokens and labels of stretches, from written forms and a seed."""
    rng = random.Random(seed)

    def digits(n):
        return "".join(rng.choice("0123456789") for _ in range(n))

    def word(low=2, high=9):
        return "".join(rng.choice("aeioubcdfghlmnprst") for _ in range(rng.randint(low, high)))

    def filler():
        return word() + rng.choice(("", "", "", ",", ".", rng.choice("*%&$#!|=-_/~") * rng.randint(1, 3)))

    def card():
        body = digits(15)
        number = next(body + c for c in "0123456789" if luhn(body + c))
        return rng.choice(([number], [number[i : i + 4] for i in range(0, 16, 4)], ["-".join(number[i : i + 4] for i in range(0, 16, 4))]))

    def email():
        user, host = word() + rng.choice(("", "." + word(), digits(2), "." + digits(2))), word() + rng.choice(("", digits(1), "." + word()))
        end = rng.choice(("com", "org", "net", "de", "fr"))
        at, dot = rng.choice((("(at)", "(dot)"), ("[at]", "[dot]"), ("at", "dot")))
        return rng.choice(([f"{user}@{host}.{end}"], [f"{user}@{host}.{end}"], [user, at, host, dot, end]))

    def phone():
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice((["+" + digits(1), f"({a})", f"{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], ["+" + digits(2), digits(3), digits(7)], [f"+{digits(11)}"]))

    def ip():
        return [".".join(str(rng.randint(0, 255)) for _ in range(4))]

    def other():
        return [rng.choice((
            str(rng.randint(1900, 2030)), f"{rng.randint(1, 9)}.{rng.randint(0, 9)}", f"{digits(1)}.{digits(1)}.{digits(2)}", f"${digits(3)}", f"{digits(2)}%",
            f"{digits(2)}:{digits(2)}", f"20{digits(2)}-{digits(2)}-{digits(2)}", digits(rng.randint(1, 9)), digits(rng.randint(20, 40)),
            "AKIA" + "".join(rng.choice("ABCDEFGHJKLMN23456789") for _ in range(16)), f"key={word()}{digits(6)}{word()}", f'"{word()}{digits(3)}{word()}{digits(7)}"',
            *(f'{a}{"".join(rng.choices("0123456789abcdef", k=rng.randint(12, 40)))}{b}' for a, b in (("", ""), ('"', '"'), ("password=", ""))),
            "@" + word(), f"{word()}{digits(2)}", f"({digits(4)})", f"{digits(1)}-{digits(1)}", f"{digits(3)}.{digits(3)}", f"{digits(2)}/{digits(2)}", "at", "dot",
        ))]

    makers, out = {"email": email, "ip": ip, "card": card, "phone": phone, "O": other}, []
    for _ in range(rows):
        tokens, labels = [filler() for _ in range(rng.randint(0, 2))], []
        labels = ["O"] * len(tokens)
        for _ in range(rng.randint(1, 3)):
            kind = rng.choice(("email", "ip", "card", "phone", "O", "O", "O"))
            made = makers[kind]()
            labels += ["O"] * len(made) if kind == "O" else [f"B-{kind}"] + [f"I-{kind}"] * (len(made) - 1)
            if rng.random() < 0.3:
                made[-1] += rng.choice(".,")
            more = [filler() for _ in range(rng.randint(0, 3))]
            tokens, labels = tokens + made + more, labels + ["O"] * len(more)
        out.append((tokens, labels))
    return out


_trained: list[Model] = []


def train(table: list[tuple[list[str], list[str]]] | None = None) -> Model:
    """The model of a labelled table; that of the table made here is kept."""
    if table is None and _trained:
        return _trained[0]
    rows = table or labelled()
    named = [names_of(tokens) for tokens, _ in rows]
    numbers = {n: i for i, n in enumerate(sorted({n for s in named for t in s for n in t}, key=lambda n: (n != "any", n)))}
    crf = Crf(len(numbers), len(LABELS)).fit([[[numbers[n] for n in t] for t in s] for s in named], [[LABELS.index(x) for x in y] for _, y in rows])
    model = Model(numbers, crf)
    if table is None:
        _trained.append(model)
    return model


def stretches(text: str) -> list[list[tuple[int, int]]]:
    """The token spans that the field reads."""
    marks = [m.span() for m in _MARK.finditer(text)] if _DIGIT.search(text) or "@" in text else []
    if "dot" in text or "at)" in text or "at]" in text:
        marks = sorted({*marks, *[m.span() for m in _SPELLED.finditer(text)]})
    out: list[list[tuple[int, int]]] = []
    for a, _ in marks:
        if out and a < out[-1][-1][1]:
            continue
        while a and not text[a - 1].isspace():
            a -= 1
        before, at = [], a  # tokens before it, back to the last stretch's end
        floor = out[-1][-1][1] if out else 0
        while len(before) <= GAP and at > floor:
            stop = at
            while stop > floor and text[stop - 1].isspace():
                stop -= 1
            at = stop
            while at > floor and not text[at - 1].isspace():
                at -= 1
            if at < stop:
                before.append((at, stop))
        own = _TOKEN.match(text, a).span()
        if out and len(before) <= GAP and at == floor:
            out[-1] += [*before[::-1], own]
        else:
            out.append([*before[:AROUND][::-1], own])
        # tokens after it belong to it unless the next mark takes them
        nexts, at = [], own[1]
        for m in _TOKEN.finditer(text, at):
            if len(nexts) == AROUND or _MARK.fullmatch(m[0]):
                break
            nexts.append(m.span())
        out[-1] += nexts
    return out


def added_spans(texts: list[str], base: list[list[tuple[str, int, int]]], model: Model) -> list[list[tuple[str, int, int]]]:
    """For each text the field's spans that overlap no base span."""
    where = [(i, s) for i, text in enumerate(texts) for s in stretches(text)]
    features = [model.features([texts[i][a:b] for a, b in s]) for i, s in where]
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    covers = [Cover(spans) for spans in base]
    for (i, spans), labels in zip(where, model.crf.decode(features)):
        found: list[list] = []
        for (a, b), label in zip(spans, labels):
            name = LABELS[label]
            if name[0] == "B" or name[0] == "I" and not (found and found[-1][3]):
                found.append([name[2:], a, b, True])
            elif name[0] == "I":
                found[-1][2] = b
            elif found:
                found[-1][3] = False
        for kind, a, b, _ in found:
            while a < b and texts[i][a] in _EDGES:
                a += 1
            while b > a and texts[i][b - 1] in _EDGES:
                b -= 1
            if a < b and not covers[i].meets(a, b):
                out[i].append((kind, a, b))
    return out


class Cover:
    """Spans by start, to ask whether one of them meets another span in steps that grow with their logarithm."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.starts = [a for _, a, _ in spans]
        self.ends = list(accumulate((b for *_, b in spans), max))  # the last end of all spans so far

    def meets(self, a: int, b: int) -> bool:
        before = bisect_left(self.starts, b)
        return before > 0 and self.ends[before - 1] > a


def find(texts: list[str | None], model: Model) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text, both in order."""
    whole = [t or "" for t in texts]
    base = [base_spans(t) for t in whole]
    return [(b, sorted(b + more, key=_by_start)) for b, more in zip(base, added_spans(whole, base, model))]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, overlapping ones as one, replaced by its kind in angle brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=_by_start):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, the numbers of base spans by kind, the base spans' digest, all spans.

    Defined cases: a null or empty text has no spans; repeated rows get equal values; a null id is carried
    along; an empty table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or train())

    def run(batches):
        import pyarrow as pa

        for batch in text_batches(batches):
            rows = []
            for base, spans in find(batch.column(1).to_pylist(), shared.value):
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            columns = [pa.array(c) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [f.split()[0] for f in SCHEMA.split(", ")])

    return pick(docs, doc_id=id_col, text=text_col).selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)


def redacted(docs: DataFrame, text_col: str = "text", model: Model | None = None) -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced by its kind.

    Defined cases: a null text stays null, an empty one empty; repeated rows become equal rows; an empty
    table gives no rows; other columns are carried along.
    """
    from pyspark.sql import functions as F

    shared = docs.sparkSession.sparkContext.broadcast(model or train())

    @F.arrow_udf("string")
    def clean(texts):
        import pyarrow as pa

        out = []
        for part in text_slices(texts):
            some = part.to_pylist()
            out += [None if t is None else redact(t, spans) for t, (_, spans) in zip(some, find(some, shared.value))]
        return pa.array(out, pa.string())

    return docs.withColumn(text_col, clean(F.col(f"`{text_col}`").cast("string")))
