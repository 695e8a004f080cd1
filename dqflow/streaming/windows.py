"""Windowed and stateful stream operators with bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_time(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    """Watermark on ``ts``; a zone-less time is read in the session's zone."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def tumbling(stream: DataFrame, ts: str, width: str, delay: str, keys=(), value: str | None = None) -> DataFrame:
    """Counts (and sums) per window and key; state older than ``delay`` is dropped."""
    aggs = [F.count(F.lit(1)).alias("n")]
    if value:
        aggs.append(F.sum(value).alias("total"))
    out = event_time(stream, ts, delay).groupBy(F.window(ts, width), *keys).agg(*aggs)
    return out.select(F.col("window.start").alias("window_start"), *keys, *[a for a in out.columns if a not in ("window", *keys)])


def sliding(stream: DataFrame, ts: str, width: str, step: str, delay: str, keys=()) -> DataFrame:
    out = event_time(stream, ts, delay).groupBy(F.window(ts, width, step), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("window_start"), *keys, "n")


def first_seen(stream: DataFrame, keys, ts: str, delay: str) -> DataFrame:
    """First row per key within the delay: duplicate claims, repeated alerts."""
    return event_time(stream, ts, delay).dropDuplicatesWithinWatermark(list(keys))


def late_flag(event_ts: str, arrival_ts: str, limit_days: int):
    """Rows that arrived more than the allowed days after their event."""
    return F.col(arrival_ts) > F.date_add(F.col(event_ts), limit_days)
