"""64-bit hashes of words and of runs of words, by numpy over the bytes of a text."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
# Bytes that part words. WHITE: space, tab, line feed, vertical tab, form feed, carriage return; NOT_WORD: all of ASCII but digits and letters.
WHITE = np.array([b in (32, 9, 10, 11, 12, 13) for b in range(256)])
NOT_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: bytes, parts: np.ndarray = WHITE, lower: bool = False) -> np.ndarray:
    """One hash per word, in order; equal words have equal hashes, others differ but for one chance in 2**64."""
    a = np.frombuffer(data, dtype=np.uint8)
    if lower:
        a = LOWER[a]
    inside = ~parts[a]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    if not len(edges):
        return np.zeros(0, np.uint64)
    lengths = edges[1::2] - edges[::2]
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    power = np.cumprod(np.full(int(lengths.max()), _STEP), dtype=np.uint64)
    values = _BYTE[a[inside]] * power[place]
    return mix(np.add.reduceat(values, first) + lengths.astype(np.uint64))


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """One hash per k words in a row; fewer words, but not none, are one run."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _STEP + words[j:j + n]
    return mix(out + np.uint64(k))
