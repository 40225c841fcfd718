"""Vectorised hashing of bytes, words and shingles."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240613)
#: A random 64-bit number for each byte, and an odd base with its inverse modulo 2^64.
BYTE = _RNG.integers(0, 1 << 64, 256, np.uint64)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    h = h ^ np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)]), dtype=np.uint64) for x in (BASE, INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def prefixes(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i], times the inverse base to the i, a hash of bytes i to j."""
    up, _ = powers(len(data) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[data] * up[: len(data)], dtype=np.uint64)])


def spans(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte spans, by content and length."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingles(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each distinct shingle, sorted. A-Z are lower-cased, words lie
    between blanks; a text with fewer words is one shingle, one without words has none."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank]).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    h = spans(prefixes(data), start, end)
    owner = np.searchsorted(np.cumsum(sizes + 1), start, side="right")
    count = np.bincount(owner, minlength=len(texts))
    out = np.zeros(len(h), np.uint64)
    for k in range(words):
        out[: len(h) - k or None] += mix(h[k:], k) if k else mix(h, 0)
    ok = np.zeros(len(h), bool)
    if len(h) >= words:
        ok[: len(h) - words + 1] = owner[: len(h) - words + 1] == owner[words - 1 :]
    own, values = [owner[ok]], [mix(out[ok], words)]
    first = np.cumsum(count) - count
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        total = np.array([mix(np.array([sum(int(mix(h[first[d] + k : first[d] + k + 1], k)[0]) for k in range(count[d])) & 0xFFFFFFFFFFFFFFFF], np.uint64), int(count[d]))[0] for d in short], np.uint64)
        own.append(short)
        values.append(total)
    own, values = np.concatenate(own), np.concatenate(values)
    order = np.lexsort((values, own))
    own, values = own[order], values[order]
    keep = np.ones(len(own), bool)
    keep[1:] = (own[1:] != own[:-1]) | (values[1:] != values[:-1])
    return own[keep], values[keep]
