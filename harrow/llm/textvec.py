"""Words, word hashes and shingles of many texts at once, in numpy over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

R = np.uint64(0x9E3779B97F4A7C15)
R_INV = np.uint64(pow(int(R), -1, 1 << 64))
#: A random 64-bit value for each byte, from a fixed seed.
BYTE_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)

_identity = np.arange(256, dtype=np.uint8)
LOWER = _identity.copy()
LOWER[65:91] += 32
#: Bytes of words: all but white space, or ASCII letters, digits and all that isn't ASCII.
NOT_SPACE = ~np.isin(_identity, [0x20, *range(0x09, 0x0E)])
ALNUM = (_identity >= 0x80) | ((_identity >= 0x30) & (_identity <= 0x39)) | ((_identity | 32) >= 0x61) & ((_identity | 32) <= 0x7A)

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i modulo 2**64 for i up to n."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 20)
        for k, base in enumerate((R, R_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and for each document the index of its first word (one more at the end)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    m = is_word[buf]
    first = m.copy()
    first[1:] &= ~m[:-1]
    last = m.copy()
    last[:-1] &= ~m[1:]
    full = offs[:-1][offs[1:] > offs[:-1]]
    first[full] = m[full]
    ends = full[1:] - 1
    last[ends] = m[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each span's bytes, the same wherever the span stands."""
    p, inv = powers(len(buf))
    values = BYTE_VALUE[LOWER] if lower else BYTE_VALUE
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(values[buf] * p[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words, from each word on (the last n - 1 are left out)."""
    k = len(h) - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64)
    out = h[:k].copy()
    for i in range(1, n):
        out = out * R + h[i : i + k]
    return mix(out)
