"""Hashes of words, shingles and byte groups of many texts at once, as numpy vectors.

A word's hash is a polynomial over its bytes modulo 2^64, from one running sum over all bytes, then mixed; a shingle's
hash combines its words' hashes in order. The same on every machine and in every run.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
#: ASCII white space, and upper-case letters to lower case.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(_BASE, -1, 1 << 64)
        for k, base in enumerate((_BASE, inverse)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[k] = np.multiply.accumulate(x)
    return _POWERS[0][:n], _POWERS[1][:n]


def spans(raw: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end: maximal runs of bytes outside ``gap``."""
    out = np.concatenate([[True], gap[raw], [True]])
    return np.flatnonzero(out[:-1] & ~out[1:]), np.flatnonzero(~out[:-1] & out[1:])


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(raw))
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power)])
        return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Of each run of ``k`` words; a shorter text is one shingle of all its words."""
    k = min(k, len(words))
    if not k:
        return np.zeros(0, np.uint64)
    n = len(words) - k + 1
    with np.errstate(over="ignore"):
        h = np.full(n, k, np.uint64)
        for j in range(k):
            h = mix(h * np.uint64(_BASE) + words[j : j + n])
    return h


def batches_of(texts: list[str], size: int = 1 << 17):
    """Runs of texts of about ``size`` characters, an empty text counted as 512: (first, end)."""
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > size:
            yield start, i
            start, total = i, 0
        total += max(len(t), 512)
    if start < len(texts):
        yield start, len(texts)


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts, a newline after each, A-Z in lower case; where each text begins, and the end."""
    parts = [t.encode("utf-8", "surrogatepass").translate(LOWER) for t in texts]
    begins = np.cumsum([0, *[len(p) + 1 for p in parts]])
    return np.frombuffer(b"\n".join([*parts, b""]), np.uint8), begins


def _words(texts: list[str]):
    """Yields, of runs of texts, all word hashes and where each text's begin, and the end."""
    for a, b in batches_of(texts):
        raw, begins = joined(texts[a:b])
        starts, ends = spans(raw)
        yield word_hashes(raw, starts, ends), np.searchsorted(starts, begins).tolist()


def shingle_sets(texts: list[str], k: int):
    """Yields each text's distinct shingle hashes, ascending; a run of texts is hashed at once."""
    for h, cut in _words(texts):
        every = shingle_hashes(h, k)
        for a, b in zip(cut, cut[1:]):
            s = np.sort(every[a : b - k + 1]) if b - a >= k else shingle_hashes(h[a:b], k)
            yield s if len(s) < 2 else s[np.concatenate([[True], s[1:] != s[:-1]])]
