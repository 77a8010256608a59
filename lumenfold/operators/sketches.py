"""Mergeable sketches as distributed aggregations: their state is a small relation, merged by a group-by.

Items are columns of canonical JSON text (functions.hashing.item_json). Every sketch takes grouping columns, so a
hundred thousand filters build in one pass; partial aggregation runs before the shuffle, which hot groups need.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import hash_all, item_hash, places, splitmix


@dataclass(frozen=True)
class BloomShape:
    bits: int
    hashes: int

    @staticmethod
    def of(items: int = 10_000, rate: float = 0.01) -> "BloomShape":
        bits = max(64, math.ceil(-items * math.log(rate) / math.log(2) ** 2))
        return BloomShape(bits, min(64, max(1, math.ceil(bits / items * math.log(2)))))


def bloom_build(items: DataFrame, item: Column, shape: BloomShape, by: list[str] = ()) -> DataFrame:
    """Rows (by.., bit) of the set bits."""
    at = places(shape.hashes, shape.bits)
    hashed = items.select(*by, item_hash(item).alias("h")).select(*by, F.explode(at("h.a", "h.b")).alias("bit"))
    return hashed.distinct()


def bloom_probe(items: DataFrame, item: Column, bits: DataFrame, shape: BloomShape, by: list[str] = ()) -> DataFrame:
    """items with `member`: all of an item's bits are set (perhaps falsely, never missing one)."""
    at = places(shape.hashes, shape.bits)
    keyed = items.withColumn("_item", item)
    asked = keyed.select(*by, "_item").distinct().withColumn("_h", item_hash("_item")).select(*by, "_item", F.explode(F.array_distinct(at("_h.a", "_h.b"))).alias("bit"))
    found = asked.join(bits.withColumn("_set", F.lit(1)), [*by, "bit"], "left").groupBy(*by, "_item").agg((F.count("*") == F.count("_set")).alias("member"))
    return keyed.join(found, [*by, "_item"]).drop("_item")


def bloom_info(bits: DataFrame, shape: BloomShape, by: list[str] = ()) -> DataFrame:
    fill = F.col("set_bits") / shape.bits
    return bits.groupBy(*by).agg(F.count("*").alias("set_bits")).withColumns({"bit_count": F.lit(shape.bits), "hash_count": F.lit(shape.hashes), "fill_ratio": fill, "estimated_false_positive_rate": F.pow(fill, F.lit(shape.hashes))})


def cms_build(items: DataFrame, item: Column, width: int = 2048, depth: int = 4, count: Column | None = None, by: list[str] = ()) -> DataFrame:
    """Rows (by.., row, col, n) of the counters, saturating at 2**32 - 1. Items are hashed where they are read: only counters are shuffled."""
    at = places(depth, width)
    each = items.select(*by, (F.lit(1) if count is None else count).cast("long").alias("_n"), item_hash(item).alias("_h"))
    cells = each.select(*by, "_n", F.posexplode(at("_h.a", "_h.b")).alias("row", "col"))
    return cells.groupBy(*by, "row", "col").agg(F.least(F.sum("_n"), F.lit((1 << 32) - 1)).alias("n"))


def cms_estimate(items: DataFrame, item: Column, cells: DataFrame, width: int = 2048, depth: int = 4, by: list[str] = ()) -> DataFrame:
    """Rows (by.., item, estimate) of the distinct items: the smallest counter, never below the true count."""
    at = places(depth, width)
    asked = items.select(*by, item.alias("item")).distinct().withColumn("_h", item_hash("item")).select(*by, "item", F.posexplode(at("_h.a", "_h.b")).alias("row", "col"))
    return asked.join(cells, [*by, "row", "col"], "left").groupBy(*by, "item").agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def hll_build(items: DataFrame, item: Column, precision: int = 14, by: list[str] = ()) -> DataFrame:
    """Rows (by.., register, rank): the register is the hash's low bits, the rank the leading zeros of the rest, plus 1."""

    @F.pandas_udf("struct<register:int,rank:int>")
    def observe(a: pd.Series) -> pd.DataFrame:
        h = a.to_numpy(np.int64).view(np.uint64)
        rest = h >> np.uint64(precision)
        width = 64 - precision
        bits = np.zeros(len(h), np.int64)
        left = rest.copy()
        for step in (32, 16, 8, 4, 2, 1):  # bit length by halving
            big = left >= (np.uint64(1) << np.uint64(step))
            bits[big] += step
            left[big] >>= np.uint64(step)
        bits += left.astype(np.int64)
        return pd.DataFrame({"register": (h & np.uint64((1 << precision) - 1)).astype(np.int32), "rank": (width - bits + 1).astype(np.int32)})

    seen = items.select(*by, observe(item_hash(item)["a"]).alias("o"))  # only registers are shuffled
    return seen.groupBy(*by, F.col("o.register").alias("register")).agg(F.max("o.rank").alias("rank"))


def hll_count(registers: DataFrame, precision: int = 14, by: list[str] = ()) -> DataFrame:
    """Rows (by.., estimate): the harmonic mean, or linear counting while registers are empty and the estimate is small."""
    m = 1 << precision
    alpha = {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))
    raw = F.lit(alpha * m * m) / F.col("_sum")
    out = registers.groupBy(*by).agg(F.count("*").alias("_used"), F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("rank"))), F.lit(0.0)).alias("_part"))
    out = out.withColumn("_sum", F.col("_part") + (m - F.col("_used")))
    small = (raw <= 2.5 * m) & (F.col("_used") < m)
    return out.select(*by, F.round(F.when(small, m * F.log(m / (m - F.col("_used")))).otherwise(raw)).cast("long").alias("estimate"))


def top_k(items: DataFrame, item: Column, k: int = 100, count: Column | None = None) -> DataFrame:
    """Rows (item, count, error) of the k heaviest items: exact, so the error is 0; ties go by item."""
    return items.groupBy(item.alias("item")).agg(F.sum(F.lit(1) if count is None else count).alias("count")).withColumn("error", F.lit(0).cast("long")).orderBy(F.col("count").desc(), "error", "item").limit(k)


def reservoir(items: DataFrame, item: Column, sequence: str, k: int = 128) -> DataFrame:
    """Rows (item, priority, sequence) of a sample of k: the smallest hashes of (sequence, item), a mergeable bottom-k.

    The same rows give the same sample however they are partitioned.
    """

    @F.pandas_udf("long")
    def priority(seq: pd.Series, value: pd.Series) -> pd.Series:
        keys = [int(s).to_bytes(8, "little", signed=True) + v.encode() for s, v in zip(seq, value)]
        return pd.Series(hash_all(keys)[0].view(np.int64))

    # Signed order with the top bit flipped is unsigned order.
    flipped = F.expr("priority ^ (-9223372036854775807L - 1L)")
    return items.select(item.alias("item"), F.col(sequence).alias("sequence")).withColumn("priority", priority("sequence", "item")).orderBy(flipped, "sequence").limit(k)


def quantiles(items: DataFrame, value: Column, at: list[float], epsilon: float = 0.01, by: list[str] = ()) -> DataFrame:
    """Rows (by.., quantile, value): rank error at most epsilon; values that aren't finite are left out."""
    v = value.cast("double")
    finite = items.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    points = [min(1.0, max(0.0, q)) for q in at]
    found = finite.groupBy(*by).agg(F.percentile_approx(v, points, math.ceil(1 / epsilon)).alias("_v"))
    return found.select(*by, F.posexplode("_v").alias("_i", "value")).withColumn("quantile", F.element_at(F.array(*map(F.lit, at)), F.col("_i") + 1)).drop("_i")


# ---- filters built in shards: bounded work for each task, whatever the filter's size ----

SHARD_ITEMS = 16_384


def shards_for(items: int) -> int:
    return max(1, -(-items // SHARD_ITEMS))


def sharded(items: DataFrame, item: Column, shards: int) -> DataFrame:
    """Rows (shard, item, a): distinct items by a slice of their hash."""
    out = items.select(item.alias("item")).distinct().withColumn("a", item_hash("item")["a"])
    return out.withColumn("shard", F.pmod(F.xxhash64("a"), F.lit(shards)).cast("int"))


class Cuckoo:
    """Buckets of four fingerprints of `bits` bits; a fingerprint lies in one of two buckets."""

    SLOTS, KICKS = 4, 500

    def __init__(self, capacity: int = 10_000, rate: float = 0.01):
        self.buckets = 1 << max(0, math.ceil(capacity / self.SLOTS / 0.95) - 1).bit_length()
        self.bits = min(16, max(4, math.ceil(math.log2(2 * self.SLOTS / rate))))
        self.table = np.zeros((self.buckets, self.SLOTS), np.uint16)
        self.count = 0

    def place(self, h: int) -> tuple[int, int, int]:
        mark = (splitmix(h) & ((1 << self.bits) - 1)) or 1
        one = h & (self.buckets - 1)
        return mark, one, self.other(one, mark)

    def other(self, bucket: int, mark: int) -> int:
        return (bucket ^ splitmix(mark)) & (self.buckets - 1)

    def has(self, h: int) -> bool:
        mark, one, two = self.place(h)
        return bool((self.table[one] == mark).any() or (self.table[two] == mark).any())

    def add(self, h: int) -> bool | None:
        """True: added; False: such a fingerprint is there; None: full, and nothing is changed."""
        if self.has(h):
            return False
        mark, one, two = self.place(h)
        for bucket in (one, two):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                self.count += 1
                return True
        before, bucket, state = [], one, h
        for _ in range(self.KICKS):
            state = splitmix(state)
            slot = state % self.SLOTS
            before.append((bucket, slot, self.table[bucket, slot]))
            mark, self.table[bucket, slot] = int(self.table[bucket, slot]), mark
            bucket = self.other(bucket, mark)
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                self.count += 1
                return True
        for bucket, slot, old in reversed(before):
            self.table[bucket, slot] = old
        return None

    def remove(self, h: int) -> bool:
        mark, one, two = self.place(h)
        for bucket in (one, two):
            at = np.flatnonzero(self.table[bucket] == mark)
            if len(at):
                self.table[bucket, at[0]] = 0
                self.count -= 1
                return True
        return False


class Xor:
    """Three blocks of 8-bit fingerprints, built once by peeling; a membership test is three lookups."""

    SEEDS = 128

    def __init__(self, hashes: list[int]):
        keys = np.array(sorted(set(hashes)), np.uint64)
        self.items = len(keys)
        self.block = max(1, math.ceil((1.23 * self.items + 32) / 3))
        for self.seed in range(self.SEEDS):
            order = self.peel(keys)
            if order is not None:
                break
        else:
            raise ValueError("xor filter construction failed")
        self.table = np.zeros(3 * self.block, np.uint8)
        for i, slot in reversed(order):
            spots, mark = self.spots(int(keys[i]))
            self.table[slot] = mark ^ self.table[spots[0]] ^ self.table[spots[1]] ^ self.table[spots[2]] ^ self.table[slot]

    def spots(self, key: int) -> tuple[list[int], int]:
        h = splitmix((key + self.seed * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
        parts = [(h >> s | h << (64 - s)) & 0xFFFFFFFF if s else h & 0xFFFFFFFF for s in (0, 21, 42)]
        return [k * self.block + (p * self.block >> 32) for k, p in enumerate(parts)], (h ^ h >> 32) & 0xFF

    def peel(self, keys: np.ndarray):
        spots = [self.spots(int(k))[0] for k in keys]
        owners: list[set[int]] = [set() for _ in range(3 * self.block)]
        for i, s in enumerate(spots):
            for x in s:
                owners[x].add(i)
        queue, order = [x for x, o in enumerate(owners) if len(o) == 1], []
        while queue:
            x = queue.pop()
            if len(owners[x]) != 1:
                continue
            i = owners[x].pop()
            order.append((i, x))
            for y in spots[i]:
                owners[y].discard(i)
                if len(owners[y]) == 1:
                    queue.append(y)
        return order if len(order) == len(keys) else None

    def has(self, key: int) -> bool:
        spots, mark = self.spots(key)
        return int(self.table[spots[0]] ^ self.table[spots[1]] ^ self.table[spots[2]]) == mark


def probe_sharded(members: DataFrame, member: Column, asked: DataFrame, item: Column, kind: str, shards: int, rate: float = 0.01) -> DataFrame:
    """Rows (item, member) of the distinct asked items: each shard's filter is built and probed in one task.

    kind is cuckoo or xor. No false negatives; cuckoo's false positives are near `rate`, xor's near 1/256.
    """

    def run(built: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        own = built["a"].to_numpy(np.int64).view(np.uint64).tolist()
        if kind == "xor":
            f = Xor(own)
        else:
            size = max(16, len(own))
            while True:
                f = Cuckoo(size, rate)
                if all(f.add(h) is not None for h in own):
                    break
                size *= 2
        hits = [f.has(h) for h in wanted["a"].to_numpy(np.int64).view(np.uint64).tolist()]
        return pd.DataFrame({"item": wanted["item"], "member": hits})

    a, b = sharded(members, member, shards), sharded(asked, item, shards)
    return a.groupBy("shard").cogroup(b.groupBy("shard")).applyInPandas(run, "item string, member boolean")
