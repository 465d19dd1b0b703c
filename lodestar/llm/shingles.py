"""Word shingles as 64-bit hashes, computed for whole texts at once with numpy."""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Two independent hashes: a base each, and a random odd number for each byte, from a fixed seed.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_OF_BYTE = np.random.default_rng(20).integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The base to the powers 0 to n and their inverses, modulo 2^64."""
    if which not in _POWERS or len(_POWERS[which][0]) <= n:
        size = max(1 << 16, 1 << (n + 1).bit_length())
        inverse = pow(_BASES[which], -1, 1 << 64)
        _POWERS[which] = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (_BASES[which], inverse))
    return _POWERS[which]


def prefix_hashes(raw: np.ndarray, which: int = 0) -> np.ndarray:
    """h with h[j] - h[i], times the inverse power i, hashing raw[i:j]."""
    up, _ = powers(len(raw), which)
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_OF_BYTE[which][raw] * up[: len(raw)], out=out[1:], dtype=np.uint64)
    return out


def range_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    _, down = powers(len(prefix), which)
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word [^\\x20\\x09-\\x0D]+, in order."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    inside = np.concatenate([[False], ~((raw == 32) | ((raw >= 9) & (raw <= 13))), [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return range_hashes(prefix_hashes(raw), edges[::2], edges[1::2])


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every window of size words; of all words, if fewer; nothing without words."""
    if not len(words):
        return words
    n = min(size, len(words))
    m = len(words) - n + 1
    h = np.full(m, n, np.uint64)
    for j in range(n):
        h = mix(h + words[j : j + m])
    return h
