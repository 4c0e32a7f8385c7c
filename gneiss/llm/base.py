"""Helpers shared by the corpus operators.

Operators first narrow their input to the columns they are told to use and give
those internal names, so extra columns never clash with what an operator adds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.session import remove, scratch, shared_dir  # noqa: F401

#: ASCII white space: space and tab to carriage return, the bytes ``bytes.split()`` splits at.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """A column by its plain name, which may hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with underscores put before it until no column of ``taken`` has it."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def kind(df: DataFrame, column: str) -> str:
    """The type of a column, as in a schema's text."""
    return next(f.dataType.simpleString() for f in df.schema if f.name.lower() == column.lower())


def id_key(df: DataFrame, id_col: str) -> Column:
    """An id as a long: integers are kept, other ids are hashed (xxhash64); null stays null."""
    c = quoted(id_col)
    return c.cast("long") if kind(df, id_col) in ("tinyint", "smallint", "int", "bigint") else F.when(c.isNotNull(), F.xxhash64(c))


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def words(col: Column) -> Column:
    """Runs of characters other than ASCII white space; a null text has none."""
    return F.array_remove(F.split(F.coalesce(col, F.lit("")), WHITE_RUN), "")


def fold(col: Column, n: int) -> Column:
    """crc32 of a value as text, modulo n; a null counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def checkpoint(df: DataFrame) -> DataFrame:
    """Compute once, into the shared folder: later reads neither repeat the work nor depend on an executor.

    A checkpoint keeps the size that was estimated for its plan.  As a join's estimate is the product of its sides', it would have
    more and more digits in loops over joins, up to gigabytes of them; so the result forgets it.
    """
    spark = df.sparkSession
    shared_dir(spark)
    done = df.checkpoint()._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done.queryExecution().toRdd(), done.schema(), False), spark)


#: Rows of a table that may be broadcast, the bytes of its texts and binaries, and rows of a shuffle's partition that may be hashed in memory.
SMALL, SMALL_BYTES, HASHED = 200_000, 1 << 25, 500_000


def sized(df: DataFrame) -> DataFrame:
    """A narrow table for the smaller side of a join: computed and measured, then broadcast if it has SMALL rows and SMALL_BYTES
    bytes at most, hashed by the shuffle's partitions if these are small enough, and else sorted, which spills."""
    df = checkpoint(df)
    wide = sum((F.coalesce(F.octet_length(quoted(f.name)), F.lit(0)).cast("long") for f in df.schema if f.dataType.typeName() in ("string", "binary")), F.lit(0).cast("long"))
    n, size = df.select(F.count(F.lit(1)), F.coalesce(F.sum(wide), F.lit(0))).first()
    if n <= SMALL and size <= SMALL_BYTES:
        return F.broadcast(df)
    return df.hint("shuffle_hash" if n <= HASHED * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else "merge")


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Arrow batches of this size for what is computed inside, to leave a worker's memory to its model."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)
