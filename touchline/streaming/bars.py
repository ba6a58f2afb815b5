"""Bars from a stream of prices: event-time windows with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(prices: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(ts, open, high, low, close, volume) per window of a stream or table of (ts, key, price).

    State holds one row per open window, not the prices.  Rows later than the watermark are
    left out; the same expression over a table gives the bars of a batch.
    """
    rows = prices.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", late)
    order = F.struct("ts", "key")
    bars = rows.groupBy(F.window("event_time", window)).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.count("*").cast("double").alias("volume"),
    )
    return bars.select(F.col("window.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")
