"""Item identity and hashes of the sketches: FNV over an item's canonical JSON, in 64-bit unsigned arithmetic."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

# The FNV offset basis and prime.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
MASK = (1 << 64) - 1


def canonical(value) -> bytes:
    """JSON with sorted keys, no spaces, UTF-8, and <, >, & escaped."""
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        value = int(value)
    out = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    for ch in "<>&  ":
        out = out.replace(ch, f"\\u{ord(ch):04x}")
    return out.encode()


def fnv1a(data: bytes, h: int = FNV_BASIS) -> int:
    for b in data:
        h = (h ^ b) * FNV_PRIME & MASK
    return h


def fnv1(data: bytes, h: int = FNV_BASIS) -> int:
    for b in data:
        h = (h * FNV_PRIME & MASK) ^ b
    return h


def splitmix(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & MASK
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def columns_of(items: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes as a matrix, lengths, longest): items side by side for column-wise hashing."""
    lengths = np.array([len(x) for x in items], np.int64)
    width = int(lengths.max()) if len(items) else 0
    joined = b"".join(x.ljust(width, b"\0") for x in items)
    return np.frombuffer(joined, np.uint8).reshape(len(items), width).astype(np.uint64), lengths, np.arange(width)


def hash_all(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(FNV-1a, FNV-1) of every item, a byte position at a time over all items."""
    matrix, lengths, places = columns_of(items)
    a = np.full(len(items), FNV_BASIS, np.uint64)
    b = a.copy()
    prime = np.uint64(FNV_PRIME)
    for k in places.tolist():
        live = lengths > k
        a[live] = (a[live] ^ matrix[live, k]) * prime
        b[live] = (b[live] * prime) ^ matrix[live, k]
    return a, b


def item_json(col: Column, kind: str) -> Column:
    """Canonical JSON of a scalar column: kind text, int, num or bool."""
    if kind == "text":
        quoted = F.to_json(F.struct(col.alias("v")))
        out = F.substring(quoted, 6, F.length(quoted) - 6)
        for ch in "<>&  ":
            out = F.replace(out, F.lit(ch), F.lit(f"\\u{ord(ch):04x}"))
        return F.when(col.isNull(), "null").otherwise(out)
    if kind == "num":
        return F.coalesce(F.regexp_replace(col.cast("string"), r"\.0$", ""), F.lit("null"))
    return F.coalesce(col.cast("string"), F.lit("null"))


def _hash_batch(item: pd.Series) -> pd.DataFrame:
    a, b = hash_all([x.encode() for x in item])
    return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})


def item_hash(item: Column | str) -> Column:
    """(FNV-1a, FNV-1) of canonical JSON text, as signed longs a and b."""
    return F.pandas_udf(_hash_batch, "struct<a:long,b:long>")(item)


def places(count: int, modulus: int):
    """A function of (a, b): the `count` places a + i * (b | 1) modulo `modulus`, unsigned."""

    @F.pandas_udf("array<long>")
    def at(a: pd.Series, b: pd.Series) -> pd.Series:
        first, step = a.to_numpy(np.int64).view(np.uint64), b.to_numpy(np.int64).view(np.uint64) | np.uint64(1)
        grid = (first[:, None] + np.arange(count, dtype=np.uint64)[None] * step[:, None]) % np.uint64(modulus)
        return pd.Series(list(grid.astype(np.int64)))

    return at
