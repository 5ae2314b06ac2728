"""A linear-chain conditional random field in numpy: training, and Viterbi decoding of batches.

A sequence is a list of tokens, each a list of feature numbers; a token's score for a label is the sum
of its features' weights, and neighbouring labels add a transition weight.
"""

from __future__ import annotations

import numpy as np


class Crf:
    """Weights of ``features`` x ``labels`` and transitions; fitted by ``fit``."""

    def __init__(self, features: int, labels: int):
        self.emit = np.zeros((features, labels))
        self.move = np.zeros((labels, labels))
        self.first = np.zeros(labels)

    def scores(self, tokens: list[list[int]]) -> np.ndarray:
        """Token scores, tokens x labels; a token has a feature at least."""
        flat = np.fromiter((f for t in tokens for f in t), np.int64)
        starts = np.cumsum([0] + [len(t) for t in tokens[:-1]])
        return np.add.reduceat(self.emit[flat], starts, axis=0) if tokens else np.zeros((0, len(self.first)))

    def fit(self, sequences: list[list[list[int]]], labels: list[list[int]], rounds: int = 60, rate: float = 0.5, decay: float = 1e-3) -> "Crf":
        """Maximum likelihood with an L2 penalty, by full-batch steps scaled per weight (Adagrad)."""
        n, k = len(sequences), len(self.first)
        longest = max(map(len, sequences))
        real = np.zeros((longest, n), bool)
        gold = np.zeros((longest, n), np.int64)
        place, flat_f, flat_p = {}, [], []
        for i, (s, y) in enumerate(zip(sequences, labels)):
            for t, features in enumerate(s):
                real[t, i], gold[t, i] = True, y[t]
                p = place[t, i] = t * n + i
                flat_f += features
                flat_p += [p] * len(features)
        flat_f, flat_p = np.array(flat_f), np.array(flat_p)
        total = [np.full_like(w, 1e-8) for w in (self.emit, self.move, self.first)]
        one_hot = np.eye(k)[gold] * real[:, :, None]
        for _ in range(rounds):
            e = np.stack([np.bincount(flat_p, self.emit[flat_f, j], longest * n) for j in range(k)], 1).reshape(longest, n, k)
            ahead, back = np.zeros_like(e), np.zeros_like(e)
            ahead[0] = self.first + e[0]
            for t in range(1, longest):
                step = _log_sum(ahead[t - 1][:, :, None] + self.move, 1) + e[t]
                ahead[t] = np.where(real[t][:, None], step, ahead[t - 1])
            for t in range(longest - 2, -1, -1):
                step = _log_sum(self.move + (e[t + 1] + back[t + 1])[:, None, :], 2)
                back[t] = np.where(real[t + 1][:, None], step, 0.0)
            norm = _log_sum(ahead[-1], 1)
            seen = np.exp(np.minimum(ahead + back - norm[None, :, None], 0)) * real[:, :, None]
            g_move = np.zeros_like(self.move)
            miss = (one_hot - seen).reshape(-1, k)
            g_emit = np.stack([np.bincount(flat_f, miss[flat_p, j], len(self.emit)) for j in range(k)], 1)
            for t in range(1, longest):
                both = np.exp(np.minimum(ahead[t - 1][:, :, None] + self.move + (e[t] + back[t])[:, None, :] - norm[:, None, None], 0))
                both[~real[t]] = 0
                g_move += np.einsum("na,nb->ab", one_hot[t - 1] * real[t][:, None], one_hot[t]) - both.sum(0)
            for w, g, s in zip((self.emit, self.move, self.first), (g_emit, g_move, miss.reshape(longest, n, k)[0].sum(0)), total):
                g = g - decay * n * w
                s += g * g
                w += rate * g / np.sqrt(s)
        return self

    def decode(self, sequences: list[list[list[int]]]) -> list[np.ndarray]:
        """The best labels of each sequence, all of them side by side, the longest first."""
        order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
        lengths = np.array([len(sequences[i]) for i in order])
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sequences)
        if not len(order) or not lengths[0]:
            return out
        scores = [self.scores(sequences[i]) for i in order]
        best, froms, active = None, [], None
        final = np.zeros(len(order), np.int64)
        for t in range(lengths[0]):
            active = int(np.searchsorted(-lengths, -t, side="left"))  # sequences longer than t
            e = np.stack([s[t] for s in scores[:active]])
            if best is None:
                best = self.first + e
                froms.append(None)
            else:
                paths = best[:active, :, None] + self.move
                froms.append(paths.argmax(1))
                best[:active] = paths.max(1) + e
            ends = int(np.searchsorted(-lengths, -(t + 1), side="left"))
            final[ends:active] = best[ends:active].argmax(1)
        for rank, i in enumerate(order):
            labels = np.zeros(lengths[rank], np.int64)
            at = int(final[rank])
            for t in range(lengths[rank] - 1, -1, -1):
                labels[t] = at
                if t:
                    at = int(froms[t][rank, at])
            out[i] = labels
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))
