"""Exact token ids of a lower-casing word BPE, with the ids of words remembered.

The vocabulary treats each word alone, so the ids of a text are those of its words in turn. Words
seen before cost one dictionary look-up; only new ones go through the tokenizer's model.
Texts with characters outside plain Latin (or with control characters, or with the strings of
special tokens) go through the tokenizer as a whole, so ids are the tokenizer's in every case.
"""

from __future__ import annotations

import re
import struct
import unicodedata

import numpy as np

#: Words and pieces remembered by one Python worker, in each of two generations. It bounds memory only.
REMEMBERED = 120_000
#: Code points handled here; whatever lies beyond goes to the tokenizer as a whole.
LATIN = 0x250

_letters = "".join(chr(c) for c in range(LATIN) if unicodedata.category(chr(c))[0] == "L")
_numbers = "".join(chr(c) for c in range(LATIN) if unicodedata.category(chr(c))[0] == "N")
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_letters}]+|[{_numbers}]|[^\\s{_letters}{_numbers}]+")
_ODD = re.compile(f"[^\\t-\\r -~\\x85\\xa0-{chr(LATIN - 1)}]|<\\||İ|ŉ|ǰ")
#: The same characters up to U+00FF.
_ODD_BYTES = bytes(c for c in range(256) if _ODD.match(chr(c)))


class Remembered(dict):
    """What ``learn`` gives for a key, in two generations: what is used stays, the rest goes when the young one is full."""

    def __init__(self, learn, limit: int):
        self.learn, self.limit, self.old = learn, limit, {}

    def __missing__(self, key: str) -> bytes:
        if (value := self.old.get(key)) is None:
            value = self.learn(key)
        if len(self) >= self.limit:
            self.old.clear()
            self.old.update(self)
            self.clear()
        self[key] = value
        return value


def is_odd(text: str) -> bool:
    """Whether the tokenizer has to take the text as a whole."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return _ODD.search(text) is not None
    return b"<|" in raw or len(raw.translate(None, _ODD_BYTES)) < len(raw)


class WordIds:
    """``WordIds(path).encode(text)``: the ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        #: Each character below LATIN as the characters that stand for its bytes in the vocabulary; those of words in ASCII stand for themselves.
        self.spelled = {c: spell(chr(c))[0][0] for c in range(LATIN)}
        #: Ids of words and of the pieces of such as have several; a piece alone is a word of one piece.
        self.known = Remembered(self._ids, REMEMBERED)

    def encode(self, text: str) -> bytes:
        if is_odd(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        # below LATIN every text is in normal form C
        return b"".join(map(self.known.__getitem__, text.lower().split()))

    def _ids(self, word: str) -> bytes:
        if not word.isalpha() and (pieces := _PIECE.findall(word)) != [word]:
            return b"".join(map(self.known.__getitem__, pieces))
        ids = [t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.spelled))]
        return struct.pack(f"<{len(ids)}I", *ids)


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One per vocabulary file and Python worker."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]
