"""Statistics per event-time window, appended when a window is complete."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_statistics(
    stream: DataFrame, keys: Sequence[str], ts: str, value: str, size: str, slide: str | None = None,
    delay: str | None = None,
) -> DataFrame:
    """keys, window_start, window_end, n, mean, std, min, max per window of ``size``.

    With ``slide`` windows overlap. On a stream, ``delay`` says how far rows may come out of
    order: a window is given out once, when the watermark has passed its end, and rows that come
    after that are left out of it (``late_entries`` counts them). Without ``delay`` the same
    table is computed from a batch. Missing values (null or NaN) are not counted; a window
    that has none else is given out with n = 0. Rows without a time are in no window.
    """
    at = F.col(ts).cast("timestamp")
    rows = stream.select(
        *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], at.alias("at"),
        F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double")).alias("v"),
    )
    if delay:
        rows = rows.withWatermark("at", delay)
    window = F.window("at", size, slide) if slide else F.window("at", size)
    found = rows.groupBy(*[f"k{i}" for i in range(len(keys))], window.alias("w")).agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"), F.count("*").alias("entries"),
    )
    return found.select(
        *[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)],
        F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("w.end").cast("timestamp_ntz").alias("window_end"),
        "n", "mean", "std", "min", "max", "entries",
    )


def open_entries(spark: SparkSession, checkpoint: str) -> int:
    """Entries of the windows that a stopped stream still holds, read from its checkpoint."""
    # The aggregation buffers in the order of the aggregates above; names repeat, so by position.
    buffers = "struct<n:long,s:double,c:long,m0:double,m1:double,m2:double,lo:double,hi:double,entries:long>"
    state = spark.read.format("statestore").load(checkpoint)
    return state.agg(F.sum(F.col("value").cast(buffers)["entries"])).first()[0] or 0


def late_entries(fed: int, found: DataFrame, spark: SparkSession, checkpoint: str) -> int:
    """Entries (a row counts once per window it lies in) that came after their window was given out.

    ``fed`` is the number of entries fed so far, ``found`` what the stream has given out.
    """
    given = found.agg(F.sum("entries")).first()[0] or 0
    return fed - given - open_entries(spark, checkpoint)
