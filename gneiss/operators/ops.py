"""Relational operators, each a function from DataFrames to a DataFrame; Catalyst plans them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scan(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The named columns of a table (all, if None is given; none, for an empty list)."""
    return df if columns is None else df.select(*columns)


def project(df: DataFrame, columns: list[str], names: list[str | None] | None = None) -> DataFrame:
    """Columns in this order, renamed where a name is given."""
    return df.select(*(F.col(c).alias(n or c) for c, n in zip(columns, names or [None] * len(columns), strict=True)))


def where(df: DataFrame, condition: Column) -> DataFrame:
    return df.filter(condition)


#: An aggregate without a place in a dict: its function, its argument (a column's name, an expression, None for none) and perhaps its name.
Call = tuple[Callable[..., Column], str | Column | None] | tuple[Callable[..., Column], str | Column | None, str | None]


def _keys(keys: dict[str, Column] | Sequence[str | Column]) -> list[Column]:
    """Group keys under their names; of those in a list a plain column keeps its own, and an expression is group_ and its place from 0."""
    if isinstance(keys, dict):
        return [k.alias(n) for n, k in keys.items()]
    return [F.col(k).alias(k) if isinstance(k, str) else k.alias(f"group_{i}") for i, k in enumerate(keys)]


def _aggs(aggs: dict[str, Column] | Sequence[Call]) -> list[Column]:
    """Aggregates under their names; of those in a list one without has its plain column's, and else aggregation_ and its place from 0."""
    if isinstance(aggs, dict):
        return [a.alias(n) for n, a in aggs.items()]
    out = []
    for i, (function, argument, *name) in enumerate(aggs):
        plain = isinstance(argument, str)
        value = function() if argument is None else function(F.col(argument) if plain else argument)
        out.append(value.alias(next(filter(None, name), None) or (argument if plain else f"aggregation_{i}")))
    return out


def global_agg(df: DataFrame, aggs: dict[str, Column] | Sequence[Call]) -> DataFrame:
    """One row, also for no input."""
    return df.agg(*_aggs(aggs))


def group_agg(df: DataFrame, keys: dict[str, Column] | Sequence[str | Column], aggs: dict[str, Column] | Sequence[Call]) -> DataFrame:
    return df.groupBy(*_keys(keys)).agg(*_aggs(aggs))


def top_k(df: DataFrame, order: list[Column], n: int | None = None, offset: int = 0) -> DataFrame:
    """Rows in an order, the first n behind offset; with n this is a bounded heap per partition, never a full sort."""
    out = df.orderBy(*order)
    out = out.offset(offset) if offset else out
    return out if n is None else out.limit(n)


def limit(df: DataFrame, n: int, offset: int = 0) -> DataFrame:
    """Any n rows behind offset."""
    return (df.offset(offset) if offset else df).limit(n)


def top_groups(df: DataFrame, keys: dict[str, Column], aggs: dict[str, Column], by: str, where: Column | None = None, having: Column | None = None, n: int | None = 10, offset: int = 0) -> DataFrame:
    """Filter, group, HAVING, and the first n groups by one output column from the largest on.

    Ties are ordered by the keys, so that results are the same on each run.
    """
    out = group_agg(df if where is None else df.filter(where), keys, aggs)
    out = out if having is None else out.filter(having)
    return top_k(out, [F.col(by).desc(), *(F.col(k).asc() for k in keys if k != by)], n, offset)


def top_rows(df: DataFrame, columns: list[str], order: list[Column], where: Column | None = None, n: int | None = 10, offset: int = 0) -> DataFrame:
    """Filter, the first n rows, then the columns: sort keys needn't be among them."""
    return top_k(df if where is None else df.filter(where), order, n, offset).select(*columns)
