"""The follow-up join as a stream: starts and later events of a key, within a bounded time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_followups(starts: DataFrame, later: DataFrame, key: str, days: int = 14, late: str = "1 hour") -> DataFrame:
    """key, id, at, next_id, next_at of streams (key, id, at timestamp); both sides' state is dropped once the interval is over."""
    a = starts.select(F.col(key).alias("k"), "id", "at").withWatermark("at", late)
    b = later.select(F.col(key).alias("k2"), F.col("id").alias("next_id"), F.col("at").alias("next_at")).withWatermark("next_at", late)
    on = (F.col("k") == F.col("k2")) & (F.col("next_at") >= F.col("at")) & (F.col("next_at") < F.col("at") + F.expr(f"interval {days} days"))
    return a.join(b, on).select(F.col("k").alias(key), "id", "at", "next_id", "next_at")


def windowed_counts(events: DataFrame, kind: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """kind, start, n of a stream of events (at timestamp), a row for each window that its watermark has closed."""
    counted = events.withWatermark("at", late).groupBy(F.window("at", width), kind).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(kind, F.col("window.start").alias("start"), "n")
