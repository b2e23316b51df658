"""Hashes of words and of word shingles for many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

CHUNK = 256 << 10  # bytes hashed at a time; their arrays fit into a core's cache
U = np.uint64
_random = np.random.default_rng(20240607)
_BYTE = _random.integers(1, 1 << 63, 256, np.uint64) * U(2) + U(1)
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ODD = _random.integers(1, 1 << 63, 8, np.uint64) * U(2) + U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FOLDED = _BYTE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_powers = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers.get("n", 0) < n:
        both = [np.multiply.accumulate(np.full(n, b, np.uint64)) for b in (_BASE, _INVERSE)]
        _powers.update(n=n, both=both)
    return tuple(p[:n] for p in _powers["both"])


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of each run of bytes that are not white space, A to Z taken as a to z."""
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        while end < len(data) and data[end] not in b" \t\n\v\f\r":
            end += 1
        part = np.frombuffer(data, np.uint8, end - at, at)
        inside = np.r_[False, ~_SPACE[part], False]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        first, last = edge[::2], edge[1::2]
        if len(first):
            power, inverse = _power(len(part))
            total = np.r_[U(0), np.cumsum(_FOLDED[part] * power, dtype=np.uint64)]
            starts.append(first + at)
            hashes.append(mix((total[last] - total[first]) * inverse[first] + (last - first).astype(np.uint64)))
        at = end
    return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's begin: one number more than there are texts."""
    start, found = word_hashes(b"\n".join(texts))
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    begin = np.r_[0, np.cumsum(lengths)]
    return found, np.searchsorted(start, begin)


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of ``size`` words; of the whole sequence if it has fewer."""
    found, begin = words(texts)
    if len(found) >= size:
        runs = sum((found[i : len(found) - size + 1 + i] * _ODD[i] for i in range(size)), U(0))
        runs = mix(runs)
    out = []
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            out.append(mix(np.array([sum((int(found[a + i]) * int(_ODD[i]) for i in range(b - a)), (b - a) * 77)  & ((1 << 64) - 1)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
