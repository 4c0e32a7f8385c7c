"""Page views per minute (the last of the 43 queries) over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def views_per_minute(hits: DataFrame, time_col: str = "EventTime", late: str = "10 minutes") -> DataFrame:
    """(M, PageViews) for each minute; a minute ends once events ``late`` behind it have come, so state is bounded.

    Works on streams and, with the same result, on tables.
    """
    timed = hits.filter(F.col(time_col).isNotNull()).select(F.col(time_col).cast("timestamp").alias("t"))
    timed = timed.withWatermark("t", late) if hits.isStreaming else timed
    return timed.groupBy(F.window("t", "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("PageViews")).select(F.col("w.start").alias("M"), "PageViews")
