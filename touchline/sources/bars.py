"""Price bars: built from event tables, or read from files with the same column contract.

A panel has the columns history_id, rep_id (0 is observed), bar_idx, ts and open, high, low,
close, volume; every missing or non-finite number is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PANEL = ("history_id", "rep_id", "bar_idx", "ts", "open", "high", "low", "close", "volume")


def indexed(bars: DataFrame, history_id: str) -> DataFrame:
    """Numbers the bars of one history by time from 0; bars are few next to what they summarise."""
    w = Window.partitionBy("history_id").orderBy("ts")
    out = bars.withColumn("history_id", F.lit(history_id)).withColumn("rep_id", F.lit(0))
    return out.withColumn("bar_idx", (F.row_number().over(w) - 1).cast("long")).select(*PANEL)


def price_bars(rows: DataFrame, ts: Column, key: Column, amount: Column, bucket: str, k: float, n0: float, history_id: str) -> DataFrame:
    """A pseudo-price from cumulative amounts, in bars of one ``bucket`` (day or hour).

    The running sums over the whole table are two-level: totals per bucket are summed over
    the few buckets, and only rows of one bucket are ordered together.  All sums are of
    integers, and prices are rounded to 4 places, so any partitioning gives the same bars.
    """
    rows = rows.select(F.date_trunc(bucket, ts).cast("timestamp_ntz").alias("b"), ts.alias("t"), key.alias("key"), F.round(amount * 100).cast("long").alias("c"))
    sums = rows.groupBy("b").agg(F.sum("c").alias("bc"), F.count("*").alias("bn"))
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = sums.select(
        "b", F.coalesce(F.sum("bc").over(before), F.lit(0)).alias("c0"), F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("n_before"),
        F.sum("bc").over(every).cast("double").alias("mc"), F.sum("bn").over(every).cast("double").alias("n"),
    )
    own = Window.partitionBy("b").orderBy("t", "key")
    rows = rows.withColumn("s", F.sum("c").over(own)).withColumn("m", F.row_number().over(own)).join(sums, "b")
    s, m = (F.col("c0") + F.col("s")).cast("double"), (F.col("n_before") + F.col("m")).cast("double")
    raw = F.lit(100.0) * F.exp(F.lit(k) * F.sqrt(F.lit(n0) / F.col("n")) * (s * F.col("n") / F.col("mc") - m))
    priced = rows.withColumn("p", F.round(F.lit(10000.0) * raw).cast("long") / F.lit(10000.0))
    order = F.struct("t", "key")
    bars = priced.groupBy(F.col("b").alias("ts")).agg(
        F.min_by("p", order).alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", order).alias("close"),
        F.count("*").cast("double").alias("volume"),
    )
    return indexed(bars, history_id)


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars from orders."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return price_bars(orders, F.col("o_orderdate"), F.col("o_orderkey"), F.col("o_totalprice"), "day", 0.01, 15000.0, "daily")


def bars_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars from events."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return price_bars(events, F.col("ts"), F.col("event_id"), F.col("value"), "hour", 0.004, 10000.0, "hourly")


def auxiliary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily external series (ts, vix, tnx, dxy) from lineitem, with a gap on every seventh day of month."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where(F.dayofmonth("l_shipdate") % 7 != 0)
    n = F.count("*")
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("long")).cast("double")
    return items.groupBy(F.col("l_shipdate").alias("ts")).agg(
        (F.sum("l_quantity") / n).alias("vix"), (cents("l_discount") / n).alias("tnx"), (cents("l_extendedprice") / n / 100).alias("dxy"),
    )
