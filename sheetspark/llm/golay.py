"""The binary Golay code of 23 bits: hash keys that words at most two bits apart share.

The code is perfect: every 23-bit word lies within three bits of exactly one codeword. The keys of a
word are the codewords within four bits of it: one, or six if the nearest is three bits away. Two
words that differ in at most two bits have a word between them, at most one bit from each; the
codeword nearest to that word is within four bits of both, so it is a key of both.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
LENGTH = 23


def remainders() -> np.ndarray:
    """The remainder of each single bit 0 to 22 by the generator polynomial: eleven bits."""
    out, now = [], 1
    for _ in range(LENGTH):
        out.append(now)
        now <<= 1
        if now >> 11 & 1:
            now ^= GENERATOR
    return np.array(out, np.int64)


def _syndromes(words: np.ndarray) -> np.ndarray:
    out = np.zeros(words.shape, np.int64)
    for bit, r in enumerate(remainders()):
        out ^= np.where(words >> bit & 1, r, 0)
    return out


def _patterns() -> np.ndarray:
    """For each syndrome the error patterns of four bits at most: 2048 x 6, -1 where there is none."""
    table, used = np.full((2048, 6), -1, np.int64), np.zeros(2048, np.int64)
    for weight in range(5):
        errors = np.array([sum(1 << b for b in bits) for bits in combinations(range(LENGTH), weight)], np.int64)
        for error, syndrome in zip(errors, _syndromes(errors)):
            table[syndrome, used[syndrome]] = error
            used[syndrome] += 1
    return table


class Golay:
    """Decoding tables; ``keys`` gives the indices of the near codewords."""

    def __init__(self):
        self.patterns = _patterns()
        # the syndrome of a word by halves
        self.low, self.high = _syndromes(np.arange(1 << 12)), _syndromes(np.arange(1 << 11) << 12)

    def keys(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Key indices of twelve bits, words x 6, and which of them there are."""
        errors = self.patterns[self.low[words & 0xFFF] ^ self.high[words >> 12]]
        return (words[:, None] ^ errors) >> 11, errors >= 0


_made: list[Golay] = []


def golay() -> Golay:
    """One for a Python worker."""
    if not _made:
        _made.append(Golay())
    return _made[0]
