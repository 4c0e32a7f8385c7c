"""Tables in Parquet, and what their footers tell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A table, or some columns of it; an empty list reads no column, only the rows' number."""
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*columns)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def schema_of(spark: SparkSession, path: str) -> T.StructType:
    return spark.read.parquet(path).schema


def rows_count(spark: SparkSession, path: str) -> int:
    """Number of rows; with spark.sql.parquet.aggregatePushdown and the v2 reader from footers only."""
    return spark.read.parquet(path).count()


def in_memory(spark: SparkSession, rows: list[tuple], schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
