"""Aggregates with fixed semantics: sums of nothing are 0, averages of integers are integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_all() -> Column:
    return F.count(F.lit(1))


def count(expr: Column) -> Column:
    return F.count(expr)


def sum0(x: Column) -> Column:
    """Sum of integers in 64 bits, 0 for no rows; an overflow is an error under ANSI."""
    return F.coalesce(F.sum(x.cast("bigint")), F.lit(0).cast("bigint"))


def int_avg(x: Column, kind: str) -> Column:
    """Average of integers of a type, truncated toward zero, in that type; null for no rows.

    64-bit inputs are summed in 38 digits, as sums of ids overflow; sums of smaller ones fit 64 bits.
    """
    wide = "decimal(38,0)" if kind in ("bigint", "long") else "bigint"
    return F.call_function("div", F.sum(x.cast(wide)), F.count(x)).cast(kind)


min_, max_ = F.min, F.max


def count_distinct(x: Column) -> Column:
    """Exact."""
    return F.count_distinct(x)
