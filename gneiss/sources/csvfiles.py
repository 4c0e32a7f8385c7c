"""CSV in and out, without nulls: a missing integer is 0 and a missing text is ''.

Integers are read leniently (leading digits count, anything else or too large is 0); dates, timestamps and
doubles strictly, so a bad one is an error.
"""

from __future__ import annotations

import csv
import datetime as dt
import io
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss import session

_INT = r"^-?[0-9]+"
_STRICT = {"date": (r"^\d{4}-\d{2}-\d{2}$", T.DateType()), "timestamp": (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", T.TimestampNTZType())}


def _strict(raw: Column, kind: T.DataType, name: str, pattern: str | None = None) -> Column:
    value = raw.try_cast(kind)
    good = value.isNotNull() if pattern is None else value.isNotNull() & raw.rlike(pattern)
    message = F.concat(F.lit(f"column {name}: not of type {kind.simpleString()}: "), F.coalesce(raw, F.lit("")))
    return F.when(good, value).otherwise(F.raise_error(message).cast(kind))


def cell(raw: Column, kind: T.DataType, name: str = "?") -> Column:
    """The value of a CSV cell in a type."""
    if isinstance(kind, T.StringType):
        return F.coalesce(raw, F.lit(""))
    if isinstance(kind, T.DateType):
        return _strict(raw, kind, name, _STRICT["date"][0])
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        return _strict(raw, kind, name, _STRICT["timestamp"][0])
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return _strict(raw, kind, name)
    # 38-digit integers are read as 64-bit ones too.
    plain = T.LongType() if isinstance(kind, T.DecimalType) else kind
    return F.coalesce(F.nullif(F.regexp_extract(raw, _INT, 0), F.lit("")).try_cast(plain), F.lit(0).cast(plain)).cast(kind)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", multi_line: bool = True) -> DataFrame:
    """A CSV file or folder without header: quotes are ", doubled inside; a byte-order mark is skipped.

    multi_line: quoted cells may hold line breaks.  A file is then read by one task, so import large data as many
    files, or without it.
    """
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    raw = spark.read.csv(path, schema=text, sep=sep, quote='"', escape='"', header=False, multiLine=multi_line, enforceSchema=True, mode="FAILFAST", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, maxCharsPerColumn=-1)
    return raw.select(*(cell(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in schema))


def as_text(df: DataFrame) -> DataFrame:
    """All columns as CSV text: dates YYYY-MM-DD, timestamps YYYY-MM-DD HH:MM:SS, integers in full."""
    def text(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)):
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        return c.cast("string")

    return df.select(*(text(f).alias(f.name) for f in df.schema))


def write_csv(df: DataFrame, path: str, header: bool = False, sep: str = ",", mode: str = "errorifexists") -> None:
    """A folder of CSV files, written in parallel, with quotes only where needed."""
    as_text(df).write.mode(mode).csv(path, header=header, sep=sep, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def csv_lines(names: list[str], rows: Iterable, header: bool = True, sep: str = ",") -> Iterable[str]:
    """CSV text of rows, with quotes only where needed."""
    out = io.StringIO()
    writer = csv.writer(out, delimiter=sep, lineterminator="\n")

    def line(values) -> str:
        out.seek(0)
        out.truncate()
        # The csv module quotes a lone empty cell, which is a bare line here.
        writer.writerow(values) if list(values) != [""] else out.write("\n")
        return out.getvalue()

    if header:
        yield line(names)
    for row in rows:
        yield line(["" if v is None else v.strftime("%Y-%m-%d %H:%M:%S") if isinstance(v, dt.datetime) else str(v) for v in row])


def write_csv_file(df: DataFrame, path: str, header: bool = True, sep: str = ",") -> int:
    """One CSV file on the driver's disk, for results of queries; the number of rows. The header is there also without rows."""
    n = 0

    def counted():
        nonlocal n
        for n, row in enumerate(df.toLocalIterator(), 1):
            yield row

    with open(path, "w", encoding="utf-8", newline="") as f:
        f.writelines(csv_lines(df.columns, counted(), header, sep))
    return n


def csv_to_table(spark: SparkSession, source: str, schema: T.StructType, target: str, sep: str = ",", multi_line: bool = True) -> None:
    read_csv(spark, source, schema, sep, multi_line).write.parquet(target)


def table_to_csv(spark: SparkSession, source: str, target: str, header: bool = False) -> None:
    write_csv(spark.read.parquet(source), target, header)


def round_trip(df: DataFrame, sep: str = ",") -> DataFrame:
    """The table written as CSV and read back, by way of the shared folder."""
    path = session.scratch(df.sparkSession, "csv")
    write_csv(df, path, sep=sep)
    return read_csv(df.sparkSession, path, df.schema, sep)
