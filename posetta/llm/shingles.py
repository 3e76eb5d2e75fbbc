"""Hashes of words and of word shingles, for many texts at once."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_STEP = U(0x9E3779B97F4A7C15)
_COEF = np.random.default_rng(21).integers(1, 1 << 63, 16, dtype=np.uint64) * U(2) + U(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLDED = _BYTE[_FOLD]
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def distinct(a: np.ndarray) -> np.ndarray:
    """The values of a in order, each once; for numbers much faster than numpy's unique(), which hashes them."""
    a = np.sort(a)
    return a[np.concatenate([[True], a[1:] != a[:-1]])] if len(a) else a


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of the texts in order, offsets: text i has words offsets[i] to offsets[i + 1]).
    Words are runs of anything but white space (ASCII); A-Z count as a-z. A word's hash is a polynomial
    in a random 64-bit value for each byte."""
    buf = np.frombuffer(b" ".join([*texts, b""]), np.uint8) if texts else np.zeros(0, np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    word = ~_GAP[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
    start, stop = edge[::2], edge[1::2]
    offsets = np.concatenate([[0], np.searchsorted(start, ends)]).astype(np.int64)
    if not len(start):
        return np.zeros(0, U), offsets
    size = stop - start
    inner = _FOLDED[buf[word]]
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    at = np.arange(len(inner)) - np.repeat(first, size)
    power = np.ones(int(size.max()), U)
    power[1:] = _STEP
    power = np.multiply.accumulate(power)
    return mixed(np.add.reduceat(inner * power[at], first) + size.astype(U) * _COEF[15]), offsets


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of width words of one text, in order; of fewer words, the whole sequence as one."""
    n = len(words)
    if n == 0:
        return np.zeros(0, U)
    if n < width:
        return mixed((words * _COEF[:n]).sum(keepdims=True) + _COEF[14:15] * U(n))
    out = words[: n - width + 1] * _COEF[0]
    for k in range(1, width):
        out = out + words[k : n - width + 1 + k] * _COEF[k]
    return mixed(out + _COEF[14:15] * U(width))


def runs(texts: list[bytes], most_bytes: int = 250_000) -> list[tuple[int, int]]:
    """Bounds of slices of texts with about that many bytes at most, or one text."""
    out, lo, size = [], 0, 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > most_bytes:
            out.append((lo, i))
            lo, size = i, 0
        size += len(t)
    return [*out, (lo, len(texts))] if texts else []
