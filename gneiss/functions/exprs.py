"""Scalar expressions with fixed semantics: 64-bit integer arithmetic, lengths in bytes, linear-time regex dialect."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(value, kind: str | None = None) -> Column:
    """A literal, cast to a declared type where one is given."""
    return F.lit(value) if kind is None else F.lit(value).cast(kind)


def add(a: Column, b: Column | int) -> Column:
    """Integer sum in 64 bits, so that small types don't overflow."""
    return a.cast("bigint") + (b if isinstance(b, Column) else F.lit(b)).cast("bigint")


def sub(a: Column, b: Column | int) -> Column:
    """Integer difference in 64 bits."""
    return a.cast("bigint") - (b if isinstance(b, Column) else F.lit(b)).cast("bigint")


def add_double(a: Column, b: Column | float) -> Column:
    return a.cast("double") + (b if isinstance(b, Column) else F.lit(b)).cast("double")


def sub_double(a: Column, b: Column | float) -> Column:
    return a.cast("double") - (b if isinstance(b, Column) else F.lit(b)).cast("double")


def byte_length(s: Column) -> Column:
    return F.octet_length(s).cast("bigint")


def minute(ts: Column) -> Column:
    return F.minute(ts).cast("tinyint")


def trunc_minute(ts: Column) -> Column:
    return F.date_trunc("minute", ts).cast("timestamp_ntz")


def trunc_hour(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def java_replacement(text: str) -> str:
    r"""A replacement with \1-style groups in Java's style: \N becomes $N, and a plain $ is escaped."""
    return re.sub(r"\\(\d)|\\(.)|\$", lambda m: f"${m[1]}" if m[1] else (f"\\{m[2]}" if m[2] else r"\$"), text, flags=re.S)


def java_pattern(text: str) -> str:
    r"""A pattern whose ``$`` is the end of the text only, as \z in Java; escaped ones and those in classes stay."""
    out, i, in_class = [], 0, False
    while i < len(text):
        c = text[i]
        if c == "\\":
            out.append(text[i : i + 2])
            i += 2
            continue
        in_class = c == "[" or (in_class and c != "]")
        out.append(r"\z" if c == "$" and not in_class else c)
        i += 1
    return "".join(out)


def regexp_replace(s: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(s, java_pattern(pattern), java_replacement(replacement))


def case_when(branches: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the first condition that holds, else ``otherwise``."""
    (first, value), *rest = branches
    out = F.when(first, value)
    for condition, value in rest:
        out = out.when(condition, value)
    return out.otherwise(otherwise)
