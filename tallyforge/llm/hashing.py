"""64-bit hashes of words and word sequences, vectorised over a block of texts."""

from __future__ import annotations

import numpy as np

_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x = x ^ (x >> np.uint64(29))
    x = x * _M2
    return x ^ (x >> np.uint64(32))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte range, read eight bytes at a time."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    length = ends - starts
    out = length.astype(np.uint64) * _STEP
    rows, at, left = None, starts, length
    while True:
        part = eights[at]
        short = left < 8
        bits = (np.minimum(left, 8) * 8).astype(np.uint64)
        keep = np.where(
            short, (np.uint64(1) << np.where(short, bits, np.uint64(0))) - np.uint64(1),
            np.uint64(0xFFFFFFFFFFFFFFFF),
        )
        if rows is None:
            out = mix(out ^ (part & keep))
        else:
            out[rows] = mix((out[rows] + _STEP) ^ (part & keep))
        more = np.flatnonzero(left > 8)
        if not len(more):
            return out
        rows = more if rows is None else rows[more]
        at, left = at[more] + 8, left[more] - 8


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` consecutive word hashes; all words as one when fewer."""
    n = len(words)
    if n == 0:
        return words
    span = min(size, n)
    out = np.full(n - span + 1, np.uint64(span)) * _STEP
    for k in range(span):
        out = mix(out + _STEP ^ words[k : n - span + 1 + k])
    return out
