"""Predicates: comparisons with typed literals, LIKE, and boolean combinators."""

from __future__ import annotations

import datetime as dt
import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPARE = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def typed(value, kind: T.DataType):
    """A literal of a column's type, from a value or its text; raises early on text that isn't of the type."""
    if not isinstance(value, str) or isinstance(kind, T.StringType):
        return F.lit(value)
    if isinstance(kind, T.DateType):
        return F.lit(dt.date.fromisoformat(value))
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        return F.lit(dt.datetime.fromisoformat(value)).cast(kind)
    return F.lit(float(value) if isinstance(kind, (T.DoubleType, T.FloatType)) else int(value)).cast(kind)


def compare(col: Column, op: str, value, kind: T.DataType | None = None) -> Column:
    return COMPARE[op](col, value if isinstance(value, Column) else typed(value, kind) if kind else F.lit(value))


def like_pattern(pattern: str) -> list[str | None]:
    r"""The pattern as characters, with None for %, and '' for _; a backslash escapes any character and is itself at the end."""
    out: list[str | None] = []
    it = iter(range(len(pattern)))
    for i in it:
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out.append(pattern[next(it)])
        else:
            out.append(None if c == "%" else "" if c == "_" else c)
    return out


def like(col: Column, pattern: str) -> Column:
    r"""SQL LIKE.  Patterns with only % go to equality, prefix, suffix and substring tests, and with more inner pieces
    to a chain of leftmost searches, which is linear; others to the built-in LIKE with normalised escapes."""
    parts = like_pattern(pattern)
    if "" in parts:
        quoted = "".join("%" if c is None else "_" if c == "" else "\\" + c if c in "%_\\" else c for c in parts)
        return col.like(quoted)
    pieces = [""]
    for c in parts:
        if c is None:
            pieces.append("")
        else:
            pieces[-1] += c
    if len(pieces) == 1:
        return col == pieces[0]
    first, *inner, last = pieces
    inner = [p for p in inner if p]
    tests = ([col.startswith(first)] if first else []) + ([col.endswith(last)] if last else [])
    if len(inner) <= 1 and not (first and last) and not (inner and (first or last)):
        return (tests + [col.contains(p) for p in inner] + [col.isNotNull()])[0]
    # Characters from which on the next piece may begin.
    at: Column = F.lit(len(first) + 1)
    for p in inner:
        found = F.call_function("locate", F.lit(p), col, at)
        tests.append(found > 0)
        at = F.when(found > 0, found + len(p)).otherwise(F.lit(1))
    tests.append(F.length(col) - len(last) + 1 >= at)
    return functools.reduce(operator.and_, tests)


def not_like(col: Column, pattern: str) -> Column:
    return ~like(col, pattern)


def in_(col: Column, values: list) -> Column:
    if not values:
        raise ValueError("IN needs a value")
    return col.isin(*values)


def not_empty(col: Column) -> Column:
    return col != ""


def between(col: Column, low, high) -> Column:
    return (col >= low) & (col <= high)


def xor(a: Column, b: Column) -> Column:
    return a != b


def all_of(*conditions: Column) -> Column:
    return functools.reduce(operator.and_, conditions)


def any_of(*conditions: Column) -> Column:
    return functools.reduce(operator.or_, conditions)


def build_predicate(items: list) -> Column:
    """A condition from prefix notation: "and", "or", "xor" before two conditions, "not" before one."""
    rest = iter(items)

    def take() -> Column:
        item = next(rest, None)
        if item is None:
            raise ValueError("a condition is missing")
        if isinstance(item, Column):
            return item
        if item == "not":
            return ~take()
        return {"and": operator.and_, "or": operator.or_, "xor": xor}[item](take(), take())

    out = take()
    if next(rest, None) is not None:
        raise ValueError("there are conditions behind the end")
    return out
