"""Event-time windows with watermarks; the same column expressions serve batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Counts and sums of tumbling (or sliding) windows; a streaming frame drops rows later than the watermark."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("ts", late)
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = e.groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.unix_seconds("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour", by: str = "user_id") -> DataFrame:
    """Sessions of a key that end after `gap` without an event."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("ts", late)
    g = e.groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(by, F.unix_micros("w.start").alias("start"), F.unix_micros("w.end").alias("end"), "n", "total")


def rolling_counters(df: DataFrame, by: list[str], seconds: str, span: int, value: str) -> DataFrame:
    """df with orders and turnover of (now - span, now]: the lower bound is strict, rows of this very second count."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(seconds).rangeBetween(1 - span, 0)
    return df.withColumns({"orders": F.count(F.lit(1)).over(w), "turnover": F.sum(F.abs(value)).over(w)})
