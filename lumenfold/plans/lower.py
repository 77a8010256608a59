"""Lowering: query tree to DataFrame operations. Catalyst plans and runs them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import scalar
from ..functions.scalar import Typed
from ..functions.udf import Registry
from ..sources.catalog import ROW, Catalog
from .tokens import Diagnostic
from .tree import OFFSETS, RANKINGS, Cte, Expr, Item, Join, Query, Sort, Source, grouped, is_aggregate, walk


@dataclass
class Options:
    """parity: NOT NULL is TRUE, as two-valued logic has it. The limits fail a query that exceeds them; None is no limit."""

    parity: bool = False
    max_source_rows: int | None = None
    max_result_rows: int | None = None
    max_recursion: int = 1000
    max_recursion_rows: int | None = None
    timeout_seconds: float | None = None


@dataclass
class Scope:
    """A DataFrame whose columns are `alias|name`, and the order in which aliases bind."""

    frame: DataFrame
    sources: list[tuple[str, list[str]]]
    keys: dict[Expr, Typed] = field(default_factory=dict)  # after grouping: expressions that are columns now

    def find(self, table: str | None, name: str) -> str | None:
        for alias, columns in self.sources:
            if table is not None and alias.upper() != table.upper():
                continue
            if name in columns:
                return f"{alias}|{name}"
            same = next((c for c in columns if c.upper() == name.upper()), None)
            if same is not None:
                return f"{alias}|{same}"
        return None


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


class Lowering:
    def __init__(self, spark: SparkSession, catalog: Catalog, functions: Registry, source: str, options: Options):
        self.spark, self.catalog, self.functions, self.source, self.options = spark, catalog, functions, source, options
        self.memo: dict = {}

    def fault(self, message: str, at=None) -> Diagnostic:
        return Diagnostic(message, self.source, *((at.line, at.column, at.column + max(1, len(at.text))) if at else (1, 1)))

    # ---- queries ----

    def query(self, q: Query, ctes: dict[str, DataFrame] | None = None) -> DataFrame:
        ctes = dict(ctes or {})
        for cte in q.ctes:
            ctes[cte.name] = self.cte(cte, ctes)
        out = self.block(q, ctes)
        if q.op:
            out = self.combine(q.op, out, self.query(q.right, ctes))
        return out

    def combine(self, op: str, left: DataFrame, right: DataFrame) -> DataFrame:
        if [c.upper() for c in left.columns] != [c.upper() for c in right.columns]:
            raise self.fault(f"the sides of {op} differ in columns: {', '.join(left.columns)} and {', '.join(right.columns)}")
        left, right = self.unify(left, right.toDF(*left.columns))
        return {"UNION ALL": left.union, "UNION": lambda r: left.union(r).distinct(), "INTERSECT": left.intersect, "EXCEPT": left.subtract}[op](right)

    def unify(self, a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Columns of two relations on common types."""
        x, y = [], []
        for f, g in zip(a.schema, b.schema):
            p, q = scalar.kind_of(f.dataType), scalar.kind_of(g.dataType)
            kind = p if p == q or q == "null" else q if p == "null" else "num" if {p, q} <= {"int", "num"} else "text"
            cast = (lambda c, k, t: scalar.text(Typed(c, k)).col if t == "text" else c.cast(scalar.SQL_TYPE[t]))
            if p == q:
                x.append(quoted(f.name))
                y.append(quoted(g.name).alias(f.name))
                continue
            x.append(cast(quoted(f.name), p, kind).alias(f.name))
            y.append(cast(quoted(g.name), q, kind).alias(f.name))
        return a.select(*x), b.select(*y)

    def block(self, q: Query, ctes: dict[str, DataFrame]) -> DataFrame:
        scope = self.scan(q.source, ctes)
        for join in q.joins:
            scope = self.join(scope, join, ctes)
        if q.where:
            self.no_aggregates(q.where, "WHERE")
            scope.frame = scope.frame.where(self.truth(q.where, scope))
        if grouped(q):
            scope = self.group(q, scope)
        if q.having:
            scope.frame = scope.frame.where(self.truth(q.having, scope))
        return self.project(q, scope)

    def no_aggregates(self, e: Expr, clause: str) -> None:
        bad = next((x for x in walk(e) if is_aggregate(x) or x.op == "window"), None)
        if bad is not None:
            raise self.fault(f"{bad.value} isn't allowed in {clause}", bad.at)

    def project(self, q: Query, scope: Scope) -> DataFrame:
        named: dict[str, Column] = {}
        for k, item in enumerate(q.items):
            if item.expr.op == "star":
                named.update(self.star(item.expr, scope))
                continue
            named[self.name_of(item, k)] = self.top(item.expr, scope).col
        # What ORDER BY needs and the projection lacks rides along.
        upper = {n.upper(): n for n in named}
        order, extra = [], {}
        for k, s in enumerate(q.order):
            e = s.expr
            if e.op == "col" and e.table is None and e.value.upper() in upper:
                col = quoted(upper[e.value.upper()])
            else:
                extra[f"_order{k}"] = self.value(e, scope).col
                col = F.col(f"_order{k}")
            order.append(col.desc_nulls_last() if s.descending else col.asc_nulls_first())
        out = scope.frame.select(*(c.alias(n) for n, c in (named | extra).items()))
        if q.distinct:
            out = out.dropDuplicates([*named])
        if order:
            out = out.orderBy(*order)
        if q.offset:
            out = out.offset(q.offset)
        if q.limit is not None:
            out = out.limit(q.limit)
        return out.drop(*extra) if extra else out

    def name_of(self, item: Item, k: int) -> str:
        if item.alias:
            return item.alias
        e = item.expr
        return e.value if e.op == "col" else e.value.lower() if e.op in ("call", "window") else f"column{k + 1}"

    def star(self, e: Expr, scope: Scope) -> dict[str, Column]:
        """All sources in one row; a later source wins a name."""
        if scope.keys:
            raise self.fault("SELECT * can't be grouped", e.at)
        if e.table is not None and e.table.upper() not in (a.upper() for a, _ in scope.sources):
            raise self.fault(f'unknown source "{e.table}"', e.at)
        return {c: quoted(f"{alias}|{c}") for alias, columns in scope.sources if e.table is None or alias.upper() == e.table.upper() for c in columns}

    # ---- sources ----

    def scan(self, s: Source, ctes: dict[str, DataFrame]) -> Scope:
        frame = self.relation(s, ctes)
        if s.columns and s.kind == "query":
            frame = self.renamed(frame, s.columns, s.at)
        if self.options.max_source_rows is not None and s.kind in ("cache", "keys"):
            most = self.options.max_source_rows
            if frame.limit(most + 1).count() > most:
                raise self.fault(f"source {s.alias} has more than {most} rows", s.at)
        columns = [c for c in frame.columns if c != ROW]
        return Scope(frame.select(*(quoted(c).alias(f"{s.alias}|{c}") for c in columns)), [(s.alias, columns)])

    def renamed(self, frame: DataFrame, columns: tuple[str, ...], at) -> DataFrame:
        if len(columns) != len(frame.columns):
            raise self.fault(f"{len(columns)} columns are named, the query has {len(frame.columns)}", at)
        return frame.toDF(*columns)

    def relation(self, s: Source, ctes: dict[str, DataFrame]) -> DataFrame:
        if s.kind == "query":
            return self.query(s.query, ctes)
        if s.kind == "values":
            return self.values(s.rows, s.columns)
        if s.kind == "keys":
            return self.catalog.keys()
        if s.kind == "name":
            if s.key not in ctes:
                raise self.fault(f'unknown relation "{s.at.text}"', s.at)
            return ctes[s.key]
        key = s.key.value if isinstance(s.key, Expr) else s.key
        if ("cache", key) not in self.memo:
            self.memo["cache", key] = self.catalog.get(key)
        frame = self.memo["cache", key]
        if frame is None:
            frame = self.spark.createDataFrame([], "value string").drop("value") if not s.types else self.spark.createDataFrame([], ", ".join(f"`{n}` string" for n, _ in s.types))
        return self.typed(frame, s, key) if s.types else frame

    def typed(self, frame: DataFrame, s: Source, key: str) -> DataFrame:
        """Declared fields are checked and converted; a bad cell fails the query and is named."""
        row = F.col(ROW) if ROW in frame.columns else F.monotonically_increasing_id() + 1
        declared, kinds = dict(s.types), {f.name: scalar.kind_of(f.dataType) for f in frame.schema}
        out = []
        for c in frame.columns:
            if c in declared:
                said = lambda got, c=c: F.concat(F.lit(f'CACHE("{key}") row '), row.cast("string"), F.lit(f' field "{c}": expected {declared[c]}, got '), got)
                out.append(scalar.strict(Typed(quoted(c), kinds[c]), declared[c], said).col.alias(c))
            else:
                out.append(quoted(c))
        missing = [F.lit(None).cast({"INTEGER": "bigint", "NUMBER": "double", "DECIMAL": "decimal(38,18)", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp"}.get(t, "string")).alias(n) for n, t in s.types if n not in frame.columns]
        return frame.select(*out, *missing)

    def values(self, rows: tuple[tuple[Expr, ...], ...], columns: tuple[str, ...]) -> DataFrame:
        names = columns or tuple(f"column{i + 1}" for i in range(len(rows[0])))
        kinds = []
        for i in range(len(rows[0])):
            have = {r[i].kind for r in rows} - {"null"}
            kinds.append("num" if have == {"int", "num"} else have.pop() if len(have) == 1 else "null" if not have else "text")
        schema = ", ".join(f"`{n}` {scalar.SQL_TYPE[k] if k != 'null' else 'void'}" for n, k in zip(names, kinds))

        def cell(e: Expr, kind: str):
            if e.value is None:
                return None
            return float(e.value) if kind == "num" else str(e.value) if kind == "text" else e.value

        return self.spark.createDataFrame([tuple(cell(e, k) for e, k in zip(r, kinds)) for r in rows], schema)

    def join(self, left: Scope, j: Join, ctes: dict[str, DataFrame]) -> Scope:
        right = self.scan(j.source, ctes)
        if j.source.alias.upper() in (a.upper() for a, _ in left.sources):
            raise self.fault(f'source alias "{j.source.alias}" is used twice', j.source.at)
        both = left.sources + right.sources
        if j.kind == "CROSS":
            return Scope(left.frame.crossJoin(right.frame), both)
        self.no_aggregates(j.on, "ON")
        # Types of both sides are needed to lower ON: an unresolved cross join gives the schema and isn't run.
        on = self.truth(j.on, Scope(left.frame.crossJoin(right.frame), both))
        return Scope(left.frame.join(right.frame, on, {"INNER": "inner", "LEFT": "left", "RIGHT": "right", "FULL": "full"}[j.kind]), both)

    # ---- grouping ----

    def group(self, q: Query, scope: Scope) -> Scope:
        """Group columns, aggregates and first values become columns; `keys` maps their expressions to them."""
        keys = [(f"g{i}", e, self.value(e, scope)) for i, e in enumerate(q.group)]
        wanted: dict[Expr, tuple[str, Column, str]] = {}
        taken = {e for _, e, _ in keys}
        ordinal: list[bool] = []

        def visit(e: Expr) -> None:
            if e in taken or e in wanted:
                return
            if is_aggregate(e):
                col, kind = self.aggregate(e, scope)
                wanted[e] = (f"a{len(wanted)}", col, kind)
            elif e.op == "col":
                found = self.column(e, scope, False)
                if found is not None:
                    same = next((k for _, k, v in keys if k.op == "col" and scope.find(k.table, k.value) == scope.find(e.table, e.value)), None)
                    if same is not None:
                        return
                    wanted[e] = (f"a{len(wanted)}", F.min_by(found.col, F.col("_ordinal")), found.kind)
                    ordinal.append(True)
            else:
                for a in (*e.args, *((*e.over.partition, *(s.expr for s in e.over.order)) if e.over else ())):
                    visit(a)

        names = {i.alias.upper() for i in q.items if i.alias}
        for e in (*(i.expr for i in q.items), *((q.having,) if q.having else ()), *(s.expr for s in q.order if not (s.expr.op == "col" and s.expr.table is None and s.expr.value.upper() in names))):
            if e.op == "star":
                raise self.fault("SELECT * can't be grouped", e.at)
            visit(e)
        # An ungrouped column has its value in the group's first row, in the order of partitions and of rows in them.
        frame = scope.frame.withColumn("_ordinal", F.monotonically_increasing_id()) if ordinal else scope.frame
        frame = frame.groupBy(*(v.col.alias(n) for n, _, v in keys))
        aggregates = [c.alias(n) for n, c, _ in wanted.values()] or [F.count("*").alias("a_none")]
        out = Scope(frame.agg(*aggregates), scope.sources)
        out.keys = {e: Typed(F.col(n), v.kind) for n, e, v in keys} | {e: Typed(F.col(n), k) for e, (n, _, k) in wanted.items()}
        for n, k, v in keys:  # other spellings of a key column
            if k.op == "col":
                for e in {x for i in (*(i.expr for i in q.items), *((q.having,) if q.having else ()), *(s.expr for s in q.order)) for x in walk(i)}:
                    if e.op == "col" and e not in out.keys and scope.find(e.table, e.value) == scope.find(k.table, k.value) is not None:
                        out.keys[e] = Typed(F.col(n), v.kind)
        return out

    def aggregate(self, e: Expr, scope: Scope) -> tuple[Column, str]:
        """COUNT of rows or non-null values; the others over numbers as doubles, NULL where there are none."""
        if e.value == "COUNT":
            if not e.args or e.args[0].op == "star":
                return F.count("*"), "int"
            return F.count(self.value(e.args[0], scope).col), "int"
        v = self.value(e.args[0], scope)
        col = v.col.cast("double") if v.kind in scalar.NUMERIC else F.lit(None).cast("double")
        return {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[e.value](col), "num"

    # ---- expressions ----

    def truth(self, e: Expr, scope: Scope) -> Column:
        return scalar.truth(self.value(e, scope))

    def top(self, e: Expr, scope: Scope) -> Typed:
        """A select item: windows are allowed here, at the top."""
        return self.window(e, scope) if e.op == "window" else self.value(e, scope)

    def column(self, e: Expr, scope: Scope, must: bool = True) -> Typed | None:
        name = scope.find(e.table, e.value)
        if name is None:
            if not must:
                return None
            if e.table is not None and e.table.upper() not in (a.upper() for a, _ in scope.sources):
                raise self.fault(f'unknown source "{e.table}"', e.at)
            return scalar.literal(None, "null")
        return Typed(quoted(name), scalar.kind_of(scope.frame.schema[name].dataType))

    def value(self, e: Expr, scope: Scope) -> Typed:
        if e in scope.keys:
            return scope.keys[e]
        if e.op == "lit":
            return scalar.literal(e.value, e.kind)
        if e.op == "col":
            return self.column(e, scope) if not scope.keys else scalar.literal(None, "null")
        if e.op == "window":
            raise self.fault(f"{e.value} OVER is only allowed as a select item of its own", e.at)
        if e.op == "star":
            raise self.fault("* is only allowed in SELECT and COUNT", e.at)
        if e.op == "param":
            raise self.fault(f"parameter ${e.value} has no value", e.at)
        if e.op == "call":
            if is_aggregate(e):
                raise self.fault(f"{e.value} isn't allowed here", e.at)
            if e.value in RANKINGS + OFFSETS:
                raise self.fault(f"{e.value} without OVER", e.at)
            f = self.functions.get(e.value)
            if f is None:
                raise self.fault(f"unknown SQL function {e.value}", e.at)
            try:
                return f.call([self.value(a, scope) for a in e.args])
            except Diagnostic:
                raise
            except ValueError as x:
                raise self.fault(str(x), e.at) from None
        args = [self.value(a, scope) for a in e.args]
        if e.op in ("AND", "OR"):
            a, b = map(scalar.truth, args)
            return Typed(a & b if e.op == "AND" else a | b, "bool")
        if e.op == "not":
            c = scalar.truth(args[0])
            return Typed(~(F.coalesce(c, F.lit(False)) if self.options.parity else c), "bool")
        if e.op == "isnull":
            return Typed(args[0].col.isNull(), "bool")
        if e.op == "notnull":
            return Typed(args[0].col.isNotNull(), "bool")
        if e.op == "like":
            return scalar.like(*args)
        if e.op == "neg":
            return scalar.negate(args[0])
        if e.op == "cast":
            place = f" at line {e.at.line}, column {e.at.column}" if e.at else ""
            return scalar.strict(args[0], e.value, lambda got: F.concat(F.lit(f"cannot cast '"), got, F.lit(f"' to {e.value}{place}")))
        if e.op in "+-*/%":
            return scalar.arithmetic(e.op, *args)
        out = scalar.compare(e.op, *args)
        if out is None:
            raise self.fault(f"cannot compare {args[0].kind} with {args[1].kind}", e.at)
        return out

    def ordering(self, order: tuple[Sort, ...], scope: Scope) -> list[Column]:
        cols = [(self.value(s.expr, scope).col, s.descending) for s in order]
        return [c.desc_nulls_last() if d else c.asc_nulls_first() for c, d in cols]

    def window(self, e: Expr, scope: Scope) -> Typed:
        """Frames count rows; the default reaches from the partition's start to the current row."""
        over = e.over
        partition = [self.value(p, scope).col for p in over.partition]
        order = self.ordering(over.order, scope)
        if e.value in ("RANK", "DENSE_RANK") and not order:
            return Typed(F.lit(1).cast("bigint"), "int")
        w = Window.partitionBy(*partition).orderBy(*(order or [F.lit(0)]))
        if e.value in RANKINGS:
            return Typed({"ROW_NUMBER": F.row_number, "RANK": F.rank, "DENSE_RANK": F.dense_rank}[e.value]().over(w).cast("bigint"), "int")
        if e.value in OFFSETS:
            v = self.value(e.args[0], scope)
            n = e.args[1].value if len(e.args) > 1 else 1
            out = (F.lag if e.value == "LAG" else F.lead)(v.col, n).over(w)
            if len(e.args) > 2:
                default = self.value(e.args[2], scope)
                pair = (v.col, default.col)
                there = (F.lag if e.value == "LAG" else F.lead)(F.lit(1), n).over(w).isNotNull()
                if default.kind != v.kind and {default.kind, v.kind} <= {"int", "num"}:
                    out, pair, v = out.cast("double"), (v.col, default.col.cast("double")), Typed(v.col, "num")
                out = F.when(there, out).otherwise(pair[1])
            return Typed(out, v.kind)
        low, high = over.frame if over.frame is not None else (None, 0)
        w = w.rowsBetween(Window.unboundedPreceding if low is None else low, Window.unboundedFollowing if high is None else high)
        v = self.value(e.args[0], scope)
        col = v.col.cast("double") if v.kind in scalar.NUMERIC else F.lit(None).cast("double")
        return Typed({"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[e.value](col).over(w), "num")

    # ---- CTEs ----

    def cte(self, c: Cte, ctes: dict[str, DataFrame]) -> DataFrame:
        if c.rows:
            return self.values(c.rows, c.columns)
        if c.recursive:
            return self.recursive(c, ctes)
        out = self.query(c.query, ctes)
        return self.renamed(out, c.columns, c.at) if c.columns else out

    def recursive(self, c: Cte, ctes: dict[str, DataFrame]) -> DataFrame:
        """Level by level: the working table is the previous level. Each level is checkpointed, so a level's plan doesn't
        hold the levels before it. Visited rows are removed by an anti-join, never collected."""
        from .recursion import Levels

        seed = replace(c.query, op=None, right=None)
        shape = lambda d: self.renamed(d, c.columns, c.at) if c.columns else d
        inner = dict(ctes)
        for own in c.query.ctes:
            inner[own.name] = self.cte(own, inner)
        first = shape(self.block(seed, inner))
        return Levels(self, c, first, lambda work: shape(self.query(c.query.right, inner | {c.name: work})), inner).run()


def lower(spark, catalog, functions, source, q: Query, options: Options) -> DataFrame:
    return Lowering(spark, catalog, functions, source, options).query(q)


__all__ = ["Lowering", "Options", "lower"]
