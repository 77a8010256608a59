"""Recursive CTEs as a loop over levels, with SEARCH BREADTH FIRST and CYCLE columns."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .tree import Expr, Item


def kept(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder; a local one only for a local master without one (tests)."""
    spark: SparkSession = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        root = context.getConf().get("spark.checkpoint.dir")
        if not root:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = tempfile.mkdtemp(prefix="lumenfold-")
        context.setCheckpointDir(root)
    return df.checkpoint()


class Levels:
    def __init__(self, lowering, cte, seed: DataFrame, step: Callable[[DataFrame], DataFrame], ctes: dict):
        self.lowering, self.cte, self.step, self.ctes = lowering, cte, step, ctes
        self.columns = seed.columns
        self.distinct = cte.query.op == "UNION"
        self.seed = seed.distinct() if self.distinct else seed

    def numbered(self, level: DataFrame, n: int) -> DataFrame:
        """search: places within the level, after those of the levels before."""
        by, name = self.cte.search
        order = Window.orderBy(*(F.col(f"`{c}`").asc_nulls_first() for c in by))
        return level.withColumn(name, (F.row_number().over(order) + n).cast("bigint"))

    def run(self) -> DataFrame:
        cycle, search = self.cte.cycle, self.cte.search
        path, mark = "_path", cycle[1] if cycle else "_cycle"
        level = self.seed
        place = F.to_json(F.array(*(F.col(f"`{c}`").cast("string") for c in cycle[0]))) if cycle else None
        if cycle:
            # A row carries the keys on its way from the seed; one that repeats a key is kept, marked, and goes no further.
            level = level.withColumn(mark, F.lit(False)).withColumn(path, F.array(place))
        total, depth, out, seen = 0, 0, None, None
        options = self.lowering.options
        while True:
            level = kept(level)
            count = level.count()
            if not count:
                break
            if depth > options.max_recursion:
                raise self.lowering.fault(f"recursive CTE {self.cte.name} exceeds the depth limit of {options.max_recursion}; its rows may form a cycle", self.cte.at)
            if options.max_recursion_rows is not None and total + count > options.max_recursion_rows:
                raise self.lowering.fault(f"recursive CTE {self.cte.name} exceeds {options.max_recursion_rows} rows", self.cte.at)
            shown = level.drop(path) if cycle else level
            shown = self.numbered(shown, total) if search else shown
            out = shown if out is None else out.union(shown)
            total += count
            depth += 1
            if self.distinct:
                seen = level.select(*self.columns) if seen is None else kept(seen.union(level.select(*self.columns)))
            work = level.where(~F.col(f"`{mark}`")).drop(mark) if cycle else level
            if cycle:
                level = self.stepped(work, path, place, mark)
            else:
                level = self.step(work)
                if level.columns != self.columns:
                    level = level.toDF(*self.columns)
                level = self.lowering.unify(self.seed.select(*self.columns), level)[1]
                if self.distinct:
                    same = [F.col(f"n.`{c}`").eqNullSafe(F.col(f"s.`{c}`")) for c in self.columns]
                    level = level.distinct().alias("n").join(seen.alias("s"), same, "left_anti")
        return out if out is not None else self.empty(mark if cycle else None, search[1] if search else None)

    def empty(self, mark: str | None, order: str | None) -> DataFrame:
        out = self.seed.limit(0)
        out = out.withColumn(mark, F.lit(False)) if mark else out
        return out.withColumn(order, F.lit(0).cast("bigint")) if order else out

    def stepped(self, work: DataFrame, path: str, place, mark: str) -> DataFrame:
        """A level by the recursive term, each row with its way: the term runs over a working table whose way rides in a
        hidden column, which the term's own projection must pass on."""
        q = self.cte.query.right
        alias = next(s.alias for s in (q.source, *(j.source for j in q.joins)) if s.kind == "name" and s.key == self.cte.name)
        carried = replace(q, items=(*q.items, Item(Expr("col", path, table=alias), path)))
        level = self.lowering.query(carried, self.ctes | {self.cte.name: work})
        level = level.toDF(*self.columns, path)
        level = level.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.seed.schema if f.name in self.columns), path)
        return level.withColumn(mark, F.array_contains(path, place)).withColumn(path, F.concat(path, F.array(place)))
