"""Attribute filters: a small condition language compiled to a Column.

    price >= 10 and (kind = "O" or not_before < '2020-01-31 00:00:00')

Operators are >= <= != = > <, joined by and / or (any case, and binds first) and
brackets. The column's type decides: strings compare without case and know
only = and !=; doubles count as equal within 1e-9; booleans and bytes know = and !=;
dates, timestamps, decimals and integers all six; other types are refused. A literal that cannot be cast counts as the
type's zero value.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOAT_ZERO = 1e-9
_TOKEN = re.compile(r"""\s*(?:(>=|<=|!=|=|>|<)|([()])|("[^"]*"|'[^']*')|([^\s()<>=!"']+))""")


def tokens(text: str) -> list[str]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"cannot read the condition at: {text[at:]!r}")
        out.append(m[0].strip())
        at = m.end()
    return out


def literal(text: str, kind: T.DataType) -> Column:
    """The text as a value of a type; zero value if it is none."""
    if len(text) > 1 and text[0] in "\"'":
        text = text[1:-1]
    if isinstance(kind, T.StringType):
        return F.lit(text)
    zero = {
        T.BooleanType: F.lit(False),
        T.DateType: F.lit("1970-01-01"),
        T.TimestampType: F.lit("1970-01-01"),
        T.TimestampNTZType: F.lit("1970-01-01"),
        T.BinaryType: F.lit(""),
    }
    return F.coalesce(F.lit(text).try_cast(kind), zero.get(type(kind), F.lit(0)).cast(kind))


def compare(column: Column, op: str, text: str, kind: T.DataType) -> Column:
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        raise ValueError(f"no comparison is defined for {kind.simpleString()}")
    if isinstance(kind, (T.StringType, T.BooleanType, T.BinaryType)) and op not in ("=", "!="):
        raise ValueError(f"{op} is not defined for {kind.simpleString()}")
    value = literal(text, kind)
    if isinstance(kind, T.StringType):
        column, value = F.lower(column), F.lower(value)
    if isinstance(kind, (T.DoubleType, T.FloatType)) and op in ("=", "!="):
        near = F.abs(column - value) < FLOAT_ZERO
        return near if op == "=" else ~near
    return {"=": column == value, "!=": column != value, ">": column > value, "<": column < value, ">=": column >= value, "<=": column <= value}[op]


def condition(text: str, schema: T.StructType) -> Column:
    """The Column of a condition over a schema; field names are found in any case."""
    names = {f.name.lower(): f for f in schema.fields}
    todo = tokens(text)

    def either() -> Column:
        out = both()
        while todo and todo[0].lower() == "or":
            todo.pop(0)
            out = out | both()
        return out

    def both() -> Column:
        out = one()
        while todo and todo[0].lower() == "and":
            todo.pop(0)
            out = out & one()
        return out

    def one() -> Column:
        if not todo:
            raise ValueError("the condition ends too early")
        if todo[0] == "(":
            todo.pop(0)
            out = either()
            if not todo or todo.pop(0) != ")":
                raise ValueError("a bracket is not closed")
            return out
        if len(todo) < 3:
            raise ValueError("a comparison is incomplete")
        name, op, value = todo.pop(0), todo.pop(0), todo.pop(0)
        field = names.get(name.lower())
        if field is None:
            raise ValueError(f"unknown field {name}")
        return compare(F.col(f"`{field.name}`"), op, value, field.dataType)

    out = either()
    if todo:
        raise ValueError(f"left over: {' '.join(todo)}")
    return out


def where(df: DataFrame, text: str | None) -> DataFrame:
    return df.where(condition(text, df.schema)) if text and text.strip() else df
