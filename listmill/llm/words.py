"""Words of many texts at once, on the UTF-8 bytes, as numpy arrays.

A word is a run of ``[^\\x20\\x09-\\x0D]``.  Space and control bytes never occur
inside a longer UTF-8 sequence, so bytes give the same words as code points.
Hashes are 64 bits: a polynomial over the bytes by prefix sums, then mixed.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LEAD = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers; a bijection."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        size = max(n, 1 << 20)
        known = np.full(size, base & (2**64 - 1), np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if size <= 1 << 22:
            _POWERS[base] = known
    return known[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; the same bytes give the same hash anywhere."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(_INVERSE, len(data) + 1)[starts])


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the index of its first word (one more at the end)."""
    n = len(data)
    solid = np.ones(n + 2, bool)
    solid[0] = solid[-1] = False
    np.logical_not(SPACE[data], out=solid[1:-1])
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | cut[:-1]))
    ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each text the index of its first word."""
    starts, ends, first = word_spans(data, offsets)
    return span_hashes(data, starts, ends), first


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows in text order, and for each text the index of its first window.

    A text with fewer than k words, but at least one, has its whole sequence as its only window.
    """
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    begin = np.concatenate(([0], np.cumsum(count)))
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], count)
    out = np.zeros(len(at), np.uint64)
    left = np.repeat(np.minimum(n, k), count)
    short = bool((n < k).any())
    for j in range(k):
        step = np.uint64((_BASE * (2 * j + 3) ** 5) & (2**64 - 1) | 1)
        if short:
            inside = left > j
            part = words[np.where(inside, at + j, 0)] if len(words) else np.zeros(len(at), np.uint64)
            out += np.where(inside, part * step, np.uint64(0))
        else:
            out += words[at + j] * step
    return mix(out ^ left.astype(np.uint64)), begin


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many true flags each text holds, by its offsets in them."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]
