"""Relations by key: DataFrames, files and JSON documents; KEYS lists them."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

ROW = "_row"  # ordinal of a JSON document's row, from 1; hidden from queries


def json_rows(document) -> list[dict]:
    """An object is one row, an array of objects one row each; null or empty is no row."""
    if document in (None, "", []):
        return []
    rows = [document] if isinstance(document, dict) else document
    if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
        raise ValueError("a JSON source must be an object or an array of objects")
    return rows


def json_type(values: list) -> T.DataType:
    """Numbers are doubles, as in JSON; nested or mixed values stay JSON text."""
    kinds = {bool if isinstance(v, bool) else float if isinstance(v, (int, float)) else type(v) for v in values if v is not None}
    return {frozenset([bool]): T.BooleanType(), frozenset([float]): T.DoubleType()}.get(frozenset(kinds), T.StringType())


class Catalog:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.frames: dict[str, DataFrame] = {}
        self.info: dict[str, tuple[str, dt.datetime | None]] = {}

    def register(self, key: str, frame: DataFrame, kind: str = "table", expires: dt.datetime | None = None) -> None:
        self.frames[key], self.info[key] = frame, (kind, expires)

    def register_path(self, key: str, path: str, format: str = "parquet", **options) -> None:
        """A dataset read lazily: filters and column choices reach its scan."""
        self.register(key, self.spark.read.format(format).options(**options).load(path))

    def register_folder(self, folder: str, names: list[str]) -> None:
        for name in names:
            self.register_path(name, f"{folder}/{name}.parquet")

    def register_json(self, key: str, document, expires: dt.datetime | None = None) -> None:
        """A small JSON document, given as text or as Python values."""
        rows = json_rows(json.loads(document) if isinstance(document, str) and document else document)
        fields = list(dict.fromkeys(f for r in rows for f in r))
        types = {f: json_type([r.get(f) for r in rows]) for f in fields}

        def cell(v, t):
            if v is None or isinstance(t, T.BooleanType):
                return v
            if isinstance(t, T.DoubleType):
                return float(v)
            return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"))

        schema = T.StructType([T.StructField(f, types[f]) for f in fields] + [T.StructField(ROW, T.LongType())])
        self.register(key, self.spark.createDataFrame([(*(cell(r.get(f), types[f]) for f in fields), i + 1) for i, r in enumerate(rows)], schema), "string", expires)

    def get(self, key: str) -> DataFrame | None:
        """The relation, or None; an expired key is gone."""
        expires = self.info.get(key, ("", None))[1]
        if expires is not None and expires <= dt.datetime.now(dt.timezone.utc):
            self.frames.pop(key), self.info.pop(key)
        return self.frames.get(key)

    def keys(self) -> DataFrame:
        """key, type, ttl_ms, on_disk, size_bytes, value_preview; live keys, in key order."""
        now = dt.datetime.now(dt.timezone.utc)
        rows = []
        for key in sorted(self.frames, key=str.encode):
            if self.get(key) is None:
                continue
            kind, expires = self.info[key]
            frame = self.frames[key]
            preview = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema if f.name != ROW)[:80]
            on_disk = bool(frame.inputFiles())
            rows.append((key, kind, None if expires is None else int((expires - now).total_seconds() * 1000), on_disk, None, preview))
        return self.spark.createDataFrame(rows, "key string, type string, ttl_ms bigint, on_disk boolean, size_bytes bigint, value_preview string")

    def cluster(self, key: str, columns: list[str], path: str, files: int = 64) -> None:
        """Rewrite a relation in the order of columns: equality, range and leading-column filters on them then skip files
        and row groups by their minima and maxima."""
        if not columns or any(c not in self.frames[key].columns for c in columns) or len(set(columns)) < len(columns):
            raise ValueError("name existing columns, each once")
        self.frames[key].repartitionByRange(files, *columns).sortWithinPartitions(*columns).write.mode("errorifexists").parquet(path)
        self.register_path(key, path)

    def statistics(self, key: str, *columns: str) -> DataFrame:
        """rows and the distinct values of a column combination."""
        frame = self.frames[key]
        return frame.agg(F.count("*").alias("rows"), F.count_distinct(*columns).alias("distinct_keys"))
