"""Vectorised polynomial hashes of byte strings, shared by the shingle and the substring operators."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


@lru_cache(1)
def byte_values() -> np.ndarray:
    """A fixed odd 64-bit value for each byte."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


_tables: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of BASE, or of its inverse; grown as needed."""
    key = "inverse" if inverse else "base"
    have = _tables.get(key)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16) * 5 // 4, pow(BASE, -1, 1 << 64) if inverse else BASE, np.uint64)
        step[0] = 1
        have = _tables[key] = np.cumprod(step, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(raw: bytes) -> np.ndarray:
    """Running sums from which `substrings` takes hashes."""
    x = np.frombuffer(raw, np.uint8)
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(byte_values()[x] * powers(len(x)), out=out[1:])
    return out


def substrings(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each raw[begin:end]."""
    return mix((sums[end] - sums[begin]) * powers(len(sums), inverse=True)[begin] + (end - begin).astype(np.uint64))


def windows(sums: np.ndarray, size: int) -> np.ndarray:
    """Hash of every raw[i:i+size]."""
    n = len(sums) - size
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix((sums[size:] - sums[:n]) * powers(len(sums), inverse=True)[:n] + np.uint64(size))
