"""Readers of price files: Parquet, CSV and JSON, with the column contract of a feed.

Every reader projects the columns it needs (so the scan is pruned), lower-cases and renames
them, brings timestamps to naive UTC, nulls what is not a finite number, and keeps the order
of arrival in ``arrival`` for the keep-last rule.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..config import OHLCV


def finite(c: Column) -> Column:
    """The number, or NULL where it is NaN or infinite (NaN would compare as the largest value)."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def naive_utc(c: Column) -> Column:
    """Timestamps with or without an offset as naive UTC; the session's time zone does not matter."""
    text = c.cast("string")
    has_zone = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.try_to_timestamp(text).cast("timestamp_ntz"))
    return F.when(has_zone, utc).otherwise(text.try_cast("timestamp_ntz"))


def feed(df: DataFrame, columns: dict[str, str], ts: str, bucket: str | None = None) -> DataFrame:
    """Renames source columns to panel names, normalises time, and numbers rows by arrival."""
    stamp = naive_utc(F.col(f"`{ts}`"))
    if bucket:
        stamp = F.date_trunc(bucket, stamp).cast("timestamp_ntz")
    picked = [finite(F.col(f"`{source}`")).alias(name.lower()) for source, name in columns.items()]
    return df.select(stamp.alias("ts"), *picked, F.monotonically_increasing_id().alias("arrival"))


def flattened(df: DataFrame) -> DataFrame:
    """Two-level columns (field, then symbol) of one symbol as plain columns named by the field."""
    out = []
    for f in df.schema.fields:
        inner = getattr(f.dataType, "fields", None)
        if inner is not None and len(inner) != 1:
            raise ValueError(f"column {f.name} holds {len(inner)} symbols")
        out.append(F.col(f"`{f.name}`").getField(inner[0].name).alias(f.name) if inner else F.col(f"`{f.name}`"))
    return df.select(*out)


def read_ohlcv(spark: SparkSession, path: str, kind: str = "parquet", ts: str = "ts", columns: dict[str, str] | None = None, bucket: str | None = None) -> DataFrame:
    """A price feed from a file; ``columns`` maps its column names to open, high, low, close, volume."""
    columns = columns or {c: c for c in OHLCV}
    if kind == "parquet":
        df = spark.read.parquet(path)
    elif kind == "csv":
        # numbers are parsed by the scan (what is none becomes NULL), times below, since they come with and without offsets
        header = spark.read.option("header", True).csv(path).columns
        lacking = [c for c in (ts, *columns) if c not in header]
        if lacking:
            raise ValueError(f"the file lacks the columns {', '.join(lacking)}")
        schema = StructType([StructField(c, DoubleType() if c in columns else StringType()) for c in header])
        df = spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)
    elif kind == "json":
        df = spark.read.json(path)
    else:
        raise ValueError(f"unknown kind of file: {kind}")
    return feed(flattened(df), columns, ts, bucket)


def read_pages(fetch: Callable[[str], dict], url: str) -> list[dict]:
    """All rows of a paginated JSON service: follows next_page_url, refuses a repeated or empty page."""
    seen, rows = set(), []
    while url:
        if url in seen:
            raise ValueError(f"the page {url} repeats")
        seen.add(url)
        page = fetch(url)
        if not page.get("data"):
            raise ValueError(f"the page {url} is empty")
        rows += page["data"]
        url = page.get("next_page_url")
    return rows


def pages_frame(spark: SparkSession, rows: Iterable[dict], ts: str, metrics: list[str]) -> DataFrame:
    """Metrics of paginated rows as an auxiliary series; missing values stay NULL."""
    schema = ", ".join(f"`{c}` string" for c in (ts, *metrics))
    data = [tuple(None if r.get(c) is None else str(r[c]) for c in (ts, *metrics)) for r in rows]
    return feed(spark.createDataFrame(data, schema), {m: m for m in metrics}, ts)


def load_panel(loader: Callable[[SparkSession, tuple[str, ...]], DataFrame], spark: SparkSession, sources: tuple[str, ...]) -> DataFrame:
    """Calls a panel loader; sources must be distinct and begin with ohlcv."""
    if not sources or sources[0] != "ohlcv" or len(set(sources)) != len(sources):
        raise ValueError("sources must be distinct, ohlcv first")
    return loader(spark, sources)


def with_defaults(df: DataFrame) -> DataFrame:
    """Columns of a close-only panel: open is close, high and low enclose both, volume is 1."""
    has = set(df.columns)
    out = df if "open" in has else df.withColumn("open", F.col("close"))
    if "high" not in has:
        out = out.withColumn("high", F.greatest("open", "close"))
    if "low" not in has:
        out = out.withColumn("low", F.least("open", "close"))
    return out if "volume" in has else out.withColumn("volume", F.lit(1.0))
