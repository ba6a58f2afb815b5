"""Cleaning, alignment and validation of panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import OHLCV


def dedup_keep_last(feed: DataFrame) -> DataFrame:
    """One row per timestamp: the one that arrived last.  A pre-aggregated max_by, no window over the feed."""
    columns = [c for c in feed.columns if c != "ts"]
    best = feed.groupBy("ts").agg(F.max_by(F.struct(*columns), "arrival").alias("r"))
    return best.select("ts", *[F.col("r")[c].alias(c) for c in columns])


def clean_bars(feed: DataFrame, start: str | None = None) -> DataFrame:
    """Bars from ``start`` on without duplicates; bars that lack any of OHLCV are dropped, never repaired."""
    rows = feed if start is None else feed.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    return dedup_keep_last(rows).dropna("any", subset=list(OHLCV))


def last_known(rows: DataFrame, columns: list[str], order: tuple[str, ...] = ("ts",), span: str = "month") -> DataFrame:
    """``rows`` with each column's last value that is not NULL at or before the row; its first order column is a time.

    Two levels: rows are only ordered within a ``span`` of time, and what a span inherits comes from
    one row per earlier span.  So no task orders the whole series, and hot spans can be made shorter.
    """
    rows = rows.withColumn("__span", F.date_trunc(span, order[0]))
    place = F.struct(*order)
    ends = rows.groupBy("__span").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in columns])
    before = Window.orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)  # one row a span
    given = ends.select(F.col("__span").alias("__own"), *[F.last(c, ignorenulls=True).over(before).alias(f"__{c}") for c in columns])
    inside = Window.partitionBy("__span").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumns({c: F.last(c, ignorenulls=True).over(inside) for c in columns})
    filled = own.join(given, F.col("__span").eqNullSafe(F.col("__own")))
    return filled.withColumns({c: F.coalesce(c, f"__{c}") for c in columns}).drop("__span", "__own", *[f"__{c}" for c in columns])


def ffill(series: DataFrame, columns: list[str]) -> DataFrame:
    """Carries the last known value forward along ts; nothing is filled backwards."""
    return last_known(series.select("ts", *columns), columns)


def asof_join(panel: DataFrame, aux: DataFrame, columns: list[str]) -> DataFrame:
    """Backward as-of left join: each bar gets the last auxiliary row at or before it, nulls included.

    The distinct bar times and the auxiliary rows are filled once as tagged rows, whatever
    the number of histories; bars then join by time.  A struct keeps "a row that says NULL"
    apart from "no row", so missing values are not filled from further back.
    """
    value = F.struct(*columns)
    right = aux.select("ts", F.lit(0).alias("tag"), value.alias("v"))
    left = panel.select("ts").distinct().select("ts", F.lit(1).alias("tag"), F.lit(None).cast(right.schema["v"].dataType).alias("v"))
    known = last_known(left.unionByName(right), ["v"], ("ts", "tag")).where("tag = 1").drop("tag")
    return panel.join(known, "ts", "left").select(*panel.columns, *[F.col("v")[c].alias(c) for c in columns])


def violations(panel: DataFrame, auxiliary: tuple[str, ...] = (), require_volume: bool = True) -> DataFrame:
    """One row per rule with the number of bars that break it; the contract rejects, it never repairs."""
    ohlc = ["open", "high", "low", "close"]
    need = [*ohlc, "volume"] if require_volume else ohlc
    missing = [c for c in ("ts", *need) if c not in panel.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    if len(set(panel.columns)) != len(panel.columns):
        raise ValueError("columns repeat")
    types = dict(panel.dtypes)
    wrong = [c for c in (*need, *auxiliary) if types[c] not in ("double", "float", "int", "bigint", "smallint", "tinyint") and not types[c].startswith("decimal")]
    if wrong:
        raise ValueError(f"columns are not real numbers: {', '.join(wrong)}")
    if types["ts"] != "timestamp_ntz":
        raise ValueError("timestamps must be naive")
    bad = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c)) == float("inf"))
    none = lambda x: F.coalesce(x, F.lit(False))
    inf = lambda c: none(F.abs(F.col(c)) == float("inf"))
    any_of = lambda xs: sum((x.cast("int") for x in xs), F.lit(0)) > 0
    by = [c for c in ("history_id", "rep_id") if c in panel.columns]
    ordered = "bar_idx" if "bar_idx" in panel.columns else "arrival" if "arrival" in panel.columns else "ts"
    w = Window.partitionBy(*by).orderBy(ordered)
    marked = panel.withColumn("__before", F.lag("ts").over(w))
    rules = {
        "empty": F.when(F.count("*") == 0, 1).otherwise(0),
        "null_timestamp": F.count_if(F.col("ts").isNull()),
        "not_increasing": F.count_if(none(F.col("__before") >= F.col("ts"))),
        "not_finite": F.count_if(any_of([bad(c) for c in need])),
        "price_not_positive": F.count_if(any_of([none(F.col(c) <= 0) for c in ohlc])),
        "negative_volume": F.count_if(none(F.col("volume") < 0)) if "volume" in panel.columns else F.lit(0),
        "low_above_body": F.count_if(none(F.col("low") > F.least("open", "close"))),
        "high_below_body": F.count_if(none(F.col("high") < F.greatest("open", "close"))),
        "low_above_high": F.count_if(none(F.col("low") > F.col("high"))),
        "auxiliary_infinite": F.count_if(any_of([inf(c) for c in auxiliary])) if auxiliary else F.lit(0),
    }
    one = marked.agg(*[v.cast("long").alias(k) for k, v in rules.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("n_bars")) for k in rules])).alias("x")).select("x.rule", "x.n_bars")


def check_panel(panel: DataFrame, auxiliary: tuple[str, ...] = (), require_volume: bool = True) -> DataFrame:
    """The panel as it is, or ValueError with the rules that it breaks."""
    broken = {r.rule: r.n_bars for r in violations(panel, auxiliary, require_volume).collect() if r.n_bars}
    if broken:
        raise ValueError(f"the panel breaks the market-data contract: {broken}")
    return panel
