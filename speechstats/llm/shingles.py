"""Sets of word shingles of whole texts, as sorted 64-bit hashes, and their MinHash signatures."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

from .common import runs

_RNG = np.random.default_rng(20240611)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = np.arange(97, 123)  # A-Z count as a-z
_STEPS, _LONG = _RNG.integers(1, 1 << 63, 8, dtype=np.uint64), 64
_PLACES = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RUN = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each stretch of ``raw``: eight bytes at a time, mixed after each, so that no algebra of the bytes gives two words
    one hash; of words of more than ``_LONG`` bytes a cryptographic digest."""
    lower = np.concatenate([_LOWER[raw], np.zeros(8, np.uint8)])
    eight = np.ndarray(len(raw) + 1, "<u8", lower, strides=(1,))
    size = end - start
    out = mix((size + 1).astype(np.uint64) * _BASE)
    rows = np.flatnonzero(size <= _LONG)
    for k in range(_LONG // 8):
        rows = rows[size[rows] > 8 * k]
        if not len(rows):
            break
        unused = np.uint64(8) * np.maximum(0, 8 * k + 8 - size[rows]).astype(np.uint64)
        part = eight[start[rows] + 8 * k] << unused
        out[rows] = mix((out[rows] ^ part) * _BASE + _STEPS[k])
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(lower[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and how many words stand before each text."""
    word = ~_SPACE[raw]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    first[edges] = word[edges]
    last[edges - 1] = word[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return _hashes(raw, start, end), np.searchsorted(start, offsets)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each text its distinct n-word shingles; all words as one shingle if they are fewer; no words, no shingle."""
    for i, j in runs(offsets, _RUN):
        words, bounds = _words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        rolled = np.zeros(max(0, len(words) - n + 1), np.uint64)
        for k in range(n):
            rolled += words[k : k + len(rolled)] * _PLACES[k]
        rolled = mix(rolled)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= n:
                own = np.sort(rolled[a : b - n + 1])
                yield own[np.r_[True, own[1:] != own[:-1]]]
            else:
                own = words[a:b]
                yield mix((own * _PLACES[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)) if b > a else own


class MinHash:
    """``k`` MinHash values (u32) of a set."""

    def __init__(self, k: int):
        rng = np.random.default_rng(97)
        self.a = rng.integers(1, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, k, dtype=np.uint64)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        out = np.full(len(self.a), (1 << 64) - 1, np.uint64)
        for k in range(0, len(values), 2048):
            np.minimum(out, (values[k : k + 2048, None] * self.a + self.b).min(axis=0), out=out)
        return (out >> np.uint64(32)).astype(np.uint32)
