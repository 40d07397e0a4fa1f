"""Hashed word shingles of whole texts, by numpy over the UTF-8 bytes."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240611)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_SPAN = 1 << 15
_AT = _RNG.integers(0, 2**64, _SPAN, dtype=np.uint64) | np.uint64(1)
_PART = _RNG.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hash of every word [^\\x20\\x09-\\x0D]+, A-Z lower-cased."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    inside = ~_SPACE[raw]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.empty(0, np.uint64)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)  # index in `at` of each word's first byte
    lengths = np.diff(first, append=len(at))
    pos = np.arange(len(at)) - np.repeat(first, lengths)
    value = _BYTE[_LOWER[raw[at]]] * _AT[pos & (_SPAN - 1)]
    if lengths.max() > _SPAN:
        value *= (2 * (pos >> 15) + 1).astype(np.uint64)
    return mix(np.add.reduceat(value, first) + lengths.astype(np.uint64))


def shingle_set(text: str | None, size: int = 4) -> np.ndarray:
    """Sorted distinct hashes of all ``size``-word shingles; with fewer words the whole sequence
    as one; no words or null: empty."""
    w = word_hashes(text or "")
    if not len(w):
        return w
    k = min(size, len(w))
    n = len(w) - k + 1
    acc = np.full(n, k, np.uint64)
    for j in range(k):
        acc += w[j : j + n] * _PART[j]
    return np.unique(mix(acc))
