"""Exact sets, ordered maps, prefix sums and keyed collections as relational operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

ARRAY_CONTAINER = 4096  # ids up to which a 16-bit container is an array


# ---- bitmaps: distinct ids ----


def bitmap(items: DataFrame, value: Column, by: list[str] = (), wide: bool = False) -> DataFrame:
    """Rows (by.., id): unsigned 32-bit ids, or 64-bit ones (wide) as DECIMAL(20,0); ids outside fail."""
    most = F.lit(str((1 << 64) - 1 if wide else (1 << 32) - 1)).cast("decimal(20,0)")
    v = value.cast("decimal(20,0)")
    checked = F.when(v.isNull() | (v < 0) | (v > most), F.raise_error(F.lit("id out of range"))).otherwise(v)
    return items.select(*by, (checked if wide else checked.cast("bigint")).alias("id")).distinct()


def bitmap_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def bitmap_count(ids: DataFrame, by: list[str] = ()) -> DataFrame:
    return ids.groupBy(*by).agg(F.count("*").alias("cardinality"))


def bitmap_containers(ids: DataFrame, by: list[str] = (), wide: bool = False) -> DataFrame:
    """Rows (by.., cardinality, containers, array_containers, bitmap_containers): ids share a container by their high bits."""
    high = F.floor(F.col("id") / 65536)
    each = ids.groupBy(*by, high.alias("_high")).agg(F.count("*").alias("_n"))
    small = F.col("_n") <= ARRAY_CONTAINER
    return each.groupBy(*by).agg(F.sum("_n").alias("cardinality"), F.count("*").alias("containers"), F.count_if(small).alias("array_containers"), F.count_if(~small).alias("bitmap_containers"))


def bitmap_count_packed(ids: DataFrame) -> DataFrame:
    """Cardinality through packed bitmaps: a bitmap of 32,768 ids per bucket is merged, then counted."""
    each = ids.groupBy(F.expr("bitmap_bucket_number(id)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(id))").alias("bits"))
    return each.agg(F.coalesce(F.sum(F.expr("bitmap_count(bits)")), F.lit(0)).alias("cardinality"))


# ---- prefix index ----


def prefix_scan(entries: DataFrame, subkey: str, prefix: str) -> DataFrame:
    """Entries whose subkey starts with prefix, in byte order; the condition reaches the scan."""
    return entries.where(F.col(subkey).startswith(prefix)).orderBy(subkey)


# ---- prefix sums ----


def prefix_sums(cells: DataFrame, index: str, delta: str, block: int = 65_536) -> DataFrame:
    """Rows (index, value, prefix_sum) of the cells that have updates. Blocks are summed in parallel; the running sum
    over whole blocks has one row per block."""
    points = cells.groupBy(index).agg(F.sum(delta).alias("value")).withColumn("_block", F.floor(F.col(index) / block))
    totals = points.groupBy("_block").agg(F.sum("value").alias("_total"))
    before = totals.select("_block", F.coalesce(F.sum("_total").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_block").orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    return points.join(before, "_block").select(index, "value", (F.sum("value").over(inside) + F.col("_before")).alias("prefix_sum"))


def range_sum(cells: DataFrame, index: str, delta: str, first: int, last: int) -> DataFrame:
    """The inclusive range's sum; the range reaches the scan."""
    return cells.where(F.col(index).between(first, last)).agg(F.coalesce(F.sum(delta), F.lit(0)).alias("range_sum"))


# ---- keyed collections ----


def queue_order(items: DataFrame, key: str, priority: str, sequence: str) -> DataFrame:
    """items with `place`: the order in which a priority queue gives them, smallest priority first, first in first out."""
    return items.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(priority, sequence)))


def deque_ends(items: DataFrame, key: str, sequence: str, value: str) -> DataFrame:
    """Rows (key, head, tail, size), without sorting."""
    return items.groupBy(key).agg(F.min_by(value, sequence).alias("head"), F.max_by(value, sequence).alias("tail"), F.count("*").alias("size"))


def latest(items: DataFrame, key: list[str], sequence: str) -> DataFrame:
    """The last write of each key; pre-aggregated, so a hot key's writes meet as one row per task."""
    rest = [c for c in items.columns if c not in key]
    return items.groupBy(*key).agg(F.max_by(F.struct(*rest), sequence).alias("_row")).select(*key, "_row.*")


def live(items: DataFrame, expires: str, now: Column) -> DataFrame:
    """Rows that haven't expired."""
    return items.where(F.col(expires).isNull() | (F.col(expires) > now))


def counters(items: DataFrame, key: str, delta: Column) -> DataFrame:
    """Sums of increments as 32-bit counters; overflow fails the query."""
    total = F.sum(delta)
    fits = total.between(-(1 << 31), (1 << 31) - 1)
    return items.groupBy(key).agg(F.when(fits, total.cast("int")).otherwise(F.raise_error(F.lit("counter overflow")).cast("int")).alias("counter"))
