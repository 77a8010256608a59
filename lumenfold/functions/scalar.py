"""Scalar semantics as Column expressions: arithmetic, comparison, LIKE, truth and strict casts.

A typed column is (Column, kind); kinds: int, num, dec, text, bool, date, ts, json, null.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, functions as F, types as T


class Typed(NamedTuple):
    col: Column
    kind: str


def kind_of(t: T.DataType) -> str:
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return "num"
    for cls, kind in ((T.DecimalType, "dec"), (T.StringType, "text"), (T.BooleanType, "bool"), (T.DateType, "date"), (T.TimestampType, "ts"), (T.TimestampNTZType, "ts"), (T.NullType, "null")):
        if isinstance(t, cls):
            return kind
    return "json"


SQL_TYPE = {"int": "bigint", "num": "double", "dec": "decimal(38,18)", "text": "string", "bool": "boolean", "date": "date", "ts": "timestamp", "json": "string", "null": "string"}
NUMERIC = ("int", "num")


def literal(value, kind: str) -> Typed:
    if kind == "null":
        return Typed(F.lit(None), kind)
    if kind == "ts":
        return Typed(F.lit(value.isoformat()).cast("timestamp"), kind)
    return Typed(F.lit(value).cast(SQL_TYPE[kind]), kind)


def null_number() -> Typed:
    return Typed(F.lit(None).cast("double"), "num")


def arithmetic(sign: str, a: Typed, b: Typed) -> Typed:
    """Integers stay integers and divide towards zero; a zero divisor gives NULL; `%` needs two integers; anything that
    isn't a number gives NULL. Integer overflow is an error."""
    if a.kind not in NUMERIC or b.kind not in NUMERIC:
        return null_number()
    if a.kind == b.kind == "int":
        x, y = a.col.cast("bigint"), b.col.cast("bigint")
        if sign in "/%":
            y = F.nullif(y, F.lit(0).cast("bigint"))
            return Typed(F.call_function("div", x, y) if sign == "/" else x % y, "int")
        return Typed({"+": x + y, "-": x - y, "*": x * y}[sign], "int")
    if sign == "%":
        return null_number()
    x, y = a.col.cast("double"), b.col.cast("double")
    if sign == "/":
        return Typed(x / F.nullif(y, F.lit(0.0)), "num")
    return Typed({"+": x + y, "-": x - y, "*": x * y}[sign], "num")


def negate(a: Typed) -> Typed:
    return arithmetic("-", Typed(F.lit(0).cast("bigint"), "int"), a)


def comparable(a: Typed, b: Typed) -> tuple[Column, Column] | None:
    """Both sides on common ground, or None where the kinds never compare."""
    if a.kind == b.kind or "null" in (a.kind, b.kind):
        return a.col, b.col
    kinds = {a.kind, b.kind}
    if kinds <= {"int", "num"}:
        return a.col.cast("double"), b.col.cast("double")
    if kinds <= {"int", "num", "dec"}:
        return a.col.cast("decimal(38,18)"), b.col.cast("decimal(38,18)")
    if kinds <= {"text", "date"}:
        return a.col.cast("string"), b.col.cast("string")
    if kinds <= {"date", "ts"}:
        return a.col.cast("timestamp"), b.col.cast("timestamp")
    return None


def compare(sign: str, a: Typed, b: Typed) -> Typed | None:
    pair = comparable(a, b)
    if pair is None:
        return None
    x, y = pair
    return Typed({"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[sign], "bool")


def like(a: Typed, pattern: Typed) -> Typed:
    """Only % is a wildcard."""
    p = pattern.col.cast("string")
    for ch in ("\\", "_"):
        p = F.replace(p, F.lit(ch), F.lit("\\" + ch))
    return Typed(F.call_function("like", text(a).col, p), "bool")


def truth(a: Typed) -> Column:
    """A condition; a value that isn't boolean holds unless it is NULL."""
    return a.col if a.kind == "bool" else F.lit(None).cast("boolean") if a.kind == "null" else a.col.isNotNull()


def number_text(col: Column) -> Column:
    """A double without a trailing .0."""
    return F.regexp_replace(col.cast("string"), r"\.0$", "")


def text(a: Typed) -> Typed:
    if a.kind == "num":
        return Typed(number_text(a.col), "text")
    if a.kind == "ts":
        whole = F.date_format(a.col.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
        part = F.rtrim(F.date_format(a.col.cast("timestamp"), "SSSSSS"), F.lit("0"))
        return Typed(F.concat(whole, F.when(part != "", F.concat(F.lit("."), part)).otherwise(""), F.lit("Z")), "text")
    if a.kind == "dec":
        return Typed(F.regexp_replace(F.regexp_replace(a.col.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", ""), "text")
    if a.kind == "json":
        return Typed(F.to_json(a.col), "text")
    return Typed(a.col.cast("string"), "text")


DATE_FORM, STAMP_FORM = r"^\d{4}-\d{2}-\d{2}$", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})$"
DECIMAL_FORM = r"^[+-]?\d+(\.\d+)?$"


def strict(a: Typed, to: str, fault) -> Typed:
    """CAST: NULL stays NULL; a value that doesn't fit fails the query with fault(text of the value)."""

    def need(ok: Column, out: Column) -> Column:
        return F.when(a.col.isNull(), F.lit(None)).when(F.coalesce(ok, F.lit(False)), out).otherwise(F.raise_error(fault(text(a).col)))

    kind = {"TEXT": "text", "NUMBER": "num", "INTEGER": "int", "DECIMAL": "dec", "BOOLEAN": "bool", "DATE": "date", "TIMESTAMP": "ts", "JSON": "json"}[to]
    if a.kind == "null":
        return Typed(F.lit(None).cast(SQL_TYPE[kind]), kind)
    never = need(F.lit(False), F.lit(None).cast(SQL_TYPE[kind])).cast(SQL_TYPE[kind])
    if kind in ("text", "json"):
        return text(a) if kind == "text" else Typed(a.col, a.kind)
    if a.kind == kind:
        return a
    string = F.trim(a.col) if a.kind == "text" else a.col
    if kind == "num":
        if a.kind in ("int", "dec"):
            return Typed(a.col.cast("double"), "num")
        if a.kind == "text":
            v = string.try_cast("double")
            return Typed(need(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")), v), "num")
    elif kind == "int":
        if a.kind in ("num", "dec"):
            v = a.col.cast("double")
            return Typed(need((v == F.floor(v)) & (F.abs(v) < 9.2233720368547e18), a.col.cast("decimal(38,0)").try_cast("bigint")), "int")
        return Typed(never, kind)
    elif kind == "dec":
        if a.kind == "int":
            return Typed(a.col.cast("decimal(38,18)"), "dec")
        form = text(a).col
        v = form.try_cast("decimal(38,18)")
        if a.kind in ("text", "num"):
            return Typed(need(form.rlike(DECIMAL_FORM) & v.isNotNull(), v), "dec")
    elif kind == "bool":
        if a.kind == "text":
            low = F.lower(string)
            return Typed(need(low.isin("true", "false"), low == "true"), "bool")
        if a.kind in NUMERIC:
            return Typed(need((a.col == 0) | (a.col == 1), a.col == 1), "bool")
    elif kind == "date":
        if a.kind == "ts":
            return Typed(a.col.cast("date"), "date")
        if a.kind == "text":
            v = a.col.try_cast("date")
            return Typed(need(a.col.rlike(DATE_FORM) & v.isNotNull(), v), "date")
    elif kind == "ts":
        if a.kind == "date":
            return Typed(a.col.cast("timestamp"), "ts")
        if a.kind == "text":
            v = a.col.try_cast("timestamp")
            return Typed(need(a.col.rlike(STAMP_FORM) & v.isNotNull(), v), "ts")
    return Typed(never, kind)
