"""Shared helpers of the training-data operators: shared folders, spools, Arrow batches."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..workers import reach

#: Rows in an Arrow batch sent to Python: a batch of long texts stays at tens of megabytes.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds (texts can be long); see that workers find the package."""
    reach(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only for a local master without one (tests)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = own.get() if own.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lumenfold-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder name under the shared root."""
    return f"{shared_root(spark)}/lumenfold-{label}-{uuid.uuid4().hex}"


_scopes: list[set[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables spooled inside are deleted at its end, but those that `keep` hands to the scope around it."""
    _scopes.append(set())
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)


def keep(df: DataFrame) -> DataFrame:
    """Let a spooled table outlive the innermost scope."""
    if _scopes:
        _scopes[-1].discard(df._spool_path)
        if len(_scopes) > 1:
            _scopes[-2].add(df._spool_path)
    return df


def spool(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    if _scopes:
        _scopes[-1].add(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._spool_path = path
    return out


def drop_spool(df: DataFrame) -> None:
    """Delete a spooled table that no later plan reads."""
    for own in _scopes:
        own.discard(df._spool_path)
    remove(df.sparkSession, df._spool_path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def ensure_dir(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(jpath)


def open_fs(uri: str):
    """(pyarrow filesystem, path in it) of a shared-folder URI; works on executors."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = uri[5:]
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def blocks(batches: Iterator, columns: list[str], most_bytes: int, sized: str) -> Iterator[tuple[list, ...]]:
    """Regroup Arrow batches into column lists of about most_bytes of column `sized` (always at least a row)."""
    held: list[list] = [[] for _ in columns]
    at, size = columns.index(sized), 0
    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns]
        for row in zip(*cols):
            for h, v in zip(held, row):
                h.append(v)
            size += len(row[at] or "")
            if size >= most_bytes:
                yield tuple(held)
                held, size = [[] for _ in columns], 0
    if held[0]:
        yield tuple(held)


class Memo(dict):
    """A bounded memo of a function of strings: two generations of `most` entries, the older dropped when the newer
    is full; strings longer than `longest` aren't kept."""

    def __init__(self, function, most: int, longest: int):
        super().__init__()
        self.function, self.most, self.longest, self.old = function, most, longest, {}

    def keep(self, key, value):
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.function(key)
        self.keep(key, value)
        return value


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies; LUMENFOLD_TOKENIZERS overrides the folder."""
    folder = os.environ.get("LUMENFOLD_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def connected(spark: SparkSession, edges: DataFrame, label: str, rounds: int = 60) -> DataFrame:
    """Smallest vertex reachable from each vertex of `edges` (src, dst long): rows (id, component).

    Alternates large-star and small-star steps; each edge set is written to the shared folder. The minima of a step are
    written too before they are joined back: a join of two plain tables is one that AQE can split at a hub. The number of
    steps grows with the logarithm of the number of vertices; beyond `rounds` an error is raised, never a partial result.
    """
    e = spool(edges.where("src is not null and dst is not null and src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), f"{label}-edges")
    before = None
    for _ in range(rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = spool(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{label}-least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = spool(large, f"{label}-large")
        low = spool(large.groupBy("u").agg(F.min("v").alias("m")), f"{label}-low")
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new = spool(small, f"{label}-edges")
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for old in (e, least, large, low):
            drop_spool(old)
        e = new
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    found = e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    out = spool(found, f"{label}-found")
    drop_spool(e)
    return out
