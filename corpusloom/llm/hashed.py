"""Sparse hashed features of words and the score of a linear model over them.

A word's features are its own hash and those of its first 4, 5 and 6 bytes. A model is additive over words,
so a worker looks each different word up once and keeps its total.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np

#: Size of the hashed feature space, a power of two; its upper half is for whole words.
HALF = 1 << 18
SPACE = 2 * HALF
#: Words whose totals a worker keeps in each of two generations.
KEPT = 100_000


def word_features(word: bytes) -> tuple[int, ...]:
    """Hashes of a word, in the upper half, and of its beginnings."""
    return (HALF + (zlib.crc32(word) & HALF - 1), *(zlib.crc32(word[:n], n) & HALF - 1 for n in (4, 5, 6) if len(word) >= n))


def memoised(weights: np.ndarray, features: Callable[[bytes], tuple[int, ...]]) -> Callable[[list[bytes]], float]:
    """Sum over words of the weights of their features."""
    known: dict[bytes, float] = {}
    older: dict[bytes, float] = {}

    def fresh(w: bytes) -> float:
        nonlocal known, older
        x = older.get(w)
        if x is None:
            x = float(sum(weights[f] for f in features(w)))
        if len(known) >= KEPT:
            known, older = {}, known
        known[w] = x
        return x

    def total(words) -> float:
        try:
            return float(sum(map(known.get, words)))
        except TypeError:  # a word that isn't known
            return float(sum(x if (x := known.get(w)) is not None else fresh(w) for w in words))

    return total


def packed(weights: np.ndarray) -> bytes:
    """The weights that aren't 0 as pairs of place and value."""
    at = np.flatnonzero(weights)
    return at.astype(np.int64).tobytes() + weights[at].astype(np.float64).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    """What packed() was given."""
    n, weights = len(data) // 16, np.zeros(SPACE)
    weights[np.frombuffer(data, np.int64, n)] = np.frombuffer(data, np.float64, n, 8 * n)
    return weights


class Adam:
    """Steps of the Adam method for one array."""

    def __init__(self, x: np.ndarray, rate: float) -> None:
        self.x, self.rate, self.m, self.v, self.t = x, rate, np.zeros_like(x), np.zeros_like(x), 0

    def step(self, g: np.ndarray) -> None:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.999 * self.v + 0.001 * g * g
        self.x -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)
