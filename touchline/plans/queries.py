"""One query per operator, over the bars derived from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT_GRID, Grid, Node
from ..functions.features import default_registry, kept_features, wide_features
from ..operators.cleaning import asof_join, clean_bars, dedup_keep_last, ffill, violations
from ..operators.ensemble import Ensemble
from ..operators.inference import missing_nodes, monte_carlo, path_scores, selection, skipped_bins
from ..operators.null_model import log_components, null_fit, null_paths
from ..operators.reporting import bin_sheet, heatmap, node_status, null_histogram, null_markers, pivoted, selected_tests, selection_summary, status_by_family
from ..operators.scoring import barrier_pairs, bin_scores, economic_filter, inspection_target, shift_surface, strongest
from ..operators.surface import assign_bins, baseline_rates, excursions, excursions_wide, fixed_edges, measure, node_coverage, on_history, quantile_edges
from ..sources.bars import auxiliary, bars_daily, bars_hourly
from ..sources.readers import with_defaults
from ..shared import fresh_path, materialise
from ..store import Store
from ..streaming.bars import stream_bars
from .catalogue import catalogue_nodes

Query = Callable[[SparkSession, str], DataFrame]

GRID = Grid((-0.10, -0.05, -0.03, -0.01, 0.0, 0.01, 0.03, 0.05, 0.10), (1, 5, 20))
N_BINS = 5
REPLICATES = 20
CATALOGUE_BINS = 10
MIN_DEV, FILTER_BIN_N, MIN_RUN = 0.02, 30, 2
NODES = (
    Node("roc_5", "roc", {"period": 5}, "momentum"),
    Node("rsi_14", "rsi", {"period": 14}, "rsi"),
    Node("weekday", "day_of_week", {}, "calendar"),
)
#: Parameters of the query of each feature.
FEATURES: dict[str, dict] = {
    "constant": {},
    "ma_ratio": {"period": 20},
    "ma_cross": {"fast": 10, "slow": 50},
    "roc": {"period": 5},
    "roc_spread": {"fast": 5, "slow": 20},
    "drawdown": {"period": 50},
    "drawdown_recovery": {"short": 20, "long": 50},
    "rsi": {"period": 14},
    "rsi_spread": {"fast": 7, "slow": 14},
    "macd": {"fast": 12, "slow": 26},
    "macd_histogram": {"fast": 12, "slow": 26, "signal": 9},
    "realized_vol": {"period": 20},
    "vol_ratio": {"fast": 10, "slow": 50},
    "atr": {"period": 14},
    "bb_pct": {"period": 20, "std_dev": 2},
    "bb_width": {"period": 20, "std_dev": 2},
    "volume_ratio": {"period": 20},
    "stoch_k": {"k_period": 14},
    "stoch_d": {"k_period": 14, "d_period": 3},
    "williams_r": {"period": 14},
    "wr_spread": {"fast": 7, "slow": 28},
    "vix_level": {},
    "vix_ma_ratio": {"period": 20},
    "vix_ret": {"period": 5},
    "tnx_level": {},
    "tnx_ma_ratio": {"period": 20},
    "tnx_ret": {"period": 5},
    "dxy_ma_ratio": {"period": 20},
    "dxy_ret": {"period": 5},
    "day_of_week": {},
    "mvrv": {},
    "hash_rate_ma_ratio": {"period": 20},
    "adr_act_ma_ratio": {"period": 20},
    "cycle_phase": {},
    "days_to_halving": {},
    "days_since_halving": {},
}


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars with the auxiliary series joined as of each day; on-chain columns are stand-ins from them."""
    bars = asof_join(bars_daily(spark, sf_dir), auxiliary(spark, sf_dir), ["vix", "tnx", "dxy"])
    return bars.withColumns({"mvrv": F.col("vix") / 25, "hash_rate": F.col("dxy"), "adr_act_cnt": F.col("vix") * 100})


def _messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed with repeated and incomplete rows: the bars, then every fifth again with no or another volume."""
    bars = bars_daily(spark, sf_dir).select("ts", "open", "high", "low", "close", "volume", "bar_idx")
    first = bars.withColumn("arrival", F.col("bar_idx"))
    volume = F.when(F.col("bar_idx") % 10 == 0, F.lit(None).cast("double")).otherwise(F.col("volume") + 1)
    again = bars.where("bar_idx % 5 = 0").withColumn("volume", volume).withColumn("arrival", F.col("bar_idx") + 1_000_000)
    return first.unionByName(again).drop("bar_idx")


def _feature(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        registry = default_registry()
        bars = panel(spark, sf_dir) if registry.get(name).needs else bars_daily(spark, sf_dir)
        wide = wide_features(bars, [Node("value", name, FEATURES[name])], registry)
        return wide.select("bar_idx", F.col("value").cast("double").alias("value"))

    return query


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars, written once: what follows reads them several times."""
    return materialise(bars_daily(spark, sf_dir), "bars")


def _measured(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return measure(_bars(spark, sf_dir), list(NODES), default_registry(), GRID, N_BINS)


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_features(bars_daily(spark, sf_dir), list(NODES), default_registry())


def _shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shift_surface(*_measured(spark, sf_dir))


def conditional_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    surface, _ = _measured(spark, sf_dir)
    return surface.select("node_id", "bin", "horizon", "barrier_idx", "barrier", "n_obs", "n_hit", F.round("p", 9).alias("p"))


def touch_rate_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = baseline_rates(excursions(bars_daily(spark, sf_dir), GRID.horizons), GRID)
    return rows.select("horizon", "barrier_idx", "barrier", "n_obs", "n_hit", F.round("p", 9).alias("p"))


def forward_excursions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = excursions(bars_hourly(spark, sf_dir), tuple(range(1, 31)))
    return rows.select("bar_idx", "horizon", F.round("down", 9).alias("down"), F.round("up", 9).alias("up"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quantile_edges(_features(spark, sf_dir), N_BINS)
    return found.select("node_id", F.posexplode("edges").alias("edge_idx", "edge"))


def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = _features(spark, sf_dir)
    return assign_bins(values, quantile_edges(values, N_BINS)).select("node_id", "bar_idx", "value", "bin")


def shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _shifts(spark, sf_dir)
    return rows.select("node_id", "bin", "horizon", "barrier", "n_obs", F.round("base_p", 9).alias("base_p"), F.round("shift", 9).alias("shift"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_scores(_shifts(spark, sf_dir), GRID).select("node_id", "bin", F.round("score", 6).alias("score"), "supported")


def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = economic_filter(_shifts(spark, sf_dir), MIN_DEV, FILTER_BIN_N, MIN_RUN)
    return rows.select("node_id", "horizon", "bin", "barrier", F.round("dev", 9).alias("dev"), "run", "n_obs", "n_hit")


def strongest_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = strongest(economic_filter(_shifts(spark, sf_dir), MIN_DEV, FILTER_BIN_N, MIN_RUN))
    return rows.select("node_id", "horizon", "bin", "barrier", F.round("dev", 9).alias("dev"), "run")


def target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspection_target(baseline_rates(excursions(bars_daily(spark, sf_dir), GRID.horizons), GRID), 5)


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log_components(bars_daily(spark, sf_dir))
    return rows.select("bar_idx", *[F.round(c, 9).alias(c) for c in ("g_open", "g_close", "g_high", "g_low")])


def fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = null_fit(log_components(bars_daily(spark, sf_dir)))
    return rows.select(*[F.round(c, 9).alias(c) for c in rows.columns if c != "history_id"])


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = bars_daily(spark, sf_dir)
    rows = null_paths(bars, null_fit(log_components(bars)), REPLICATES)
    return rows.select("rep_id", "bar_idx", "open", "high", "low", "close", "volume")


def _tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = path_scores(_bars(spark, sf_dir), list(NODES), default_registry(), GRID, N_BINS, REPLICATES)
    return monte_carlo(found, REPLICATES)


def tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tests(spark, sf_dir)
    return rows.select(
        "node_id", "bin", F.round("bin_score", 6).alias("bin_score"), F.round("monte_carlo_p_value", 9).alias("monte_carlo_p_value"), "cleared",
        F.round("null_p95", 6).alias("null_p95"), "n_null_replicates", "n_supported_null",
    )


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 58 conditions of the catalogue by 41 barriers, 30 horizons and 10 bins, measured and compared."""
    rows = shift_surface(*measure(materialise(panel(spark, sf_dir), "panel"), catalogue_nodes(), default_registry(), DEFAULT_GRID, CATALOGUE_BINS))
    return rows.select("node_id", "bin", "horizon", "barrier_idx", "n_obs", "n_hit", F.round("shift", 9).alias("shift"))


def _found(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, "node_id", "bin", F.round("bin_score", 6).alias("bin_score"), F.round("monte_carlo_p_value", 9).alias("monte_carlo_p_value"), F.round("null_p95", 6).alias("null_p95"), "n_supported_null")


def two_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily and hourly bars as two histories, with nodes of their own, tested in one run."""
    groups = [(_bars(spark, sf_dir), [NODES[0], NODES[2]]), (materialise(bars_hourly(spark, sf_dir), "bars"), [NODES[1]])]
    scores = Ensemble(Store(spark, fresh_path(spark, "ensemble"))).scores(groups, default_registry(), GRID, N_BINS, REPLICATES)
    return _found(monte_carlo(scores, REPLICATES), "history_id")


def extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ensemble of one node and one block of replicates, then of a further node and twice as many: what is kept is not made again."""
    ensemble, bars = Ensemble(Store(spark, fresh_path(spark, "ensemble"))), materialise(bars_hourly(spark, sf_dir), "bars")
    ensemble.scores([(bars, [NODES[0]])], default_registry(), GRID, N_BINS, REPLICATES)
    return _found(monte_carlo(ensemble.scores([(bars, list(NODES[:2]))], default_registry(), GRID, N_BINS, 2 * REPLICATES), 2 * REPLICATES))


def _loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests with a threshold that some bins clear with few replicates."""
    found = path_scores(_bars(spark, sf_dir), list(NODES), default_registry(), GRID, N_BINS, REPLICATES)
    return monte_carlo(found, REPLICATES, 0.5)


def selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = selection(_loose(spark, sf_dir))
    return rows.select("selection_number", "node_id", "bin", F.round("bin_score", 6).alias("bin_score"), F.round("monte_carlo_p_value", 9).alias("monte_carlo_p_value"))


def selected_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heatmap(_shifts(spark, sf_dir), selection(_loose(spark, sf_dir)), GRID.horizons)


def selected_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _loose(spark, sf_dir)
    return selected_tests(rows, selection(rows)).select("node_id", "bin", F.round("null_p95", 6).alias("null_p95"))


def skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of the hourly bars that lack support on a grid without pairs: all of them."""
    lone = Grid((0.01, 0.03), (1, 5))
    surface, baseline = measure(bars_hourly(spark, sf_dir), list(NODES[:1]), default_registry(), lone, N_BINS)
    return skipped_bins(bin_scores(shift_surface(surface, baseline), lone)).select("node_id", "bin", "reason")


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return null_histogram(_tests(spark, sf_dir))


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status_by_family(list(NODES), _measured(spark, sf_dir)[0], _loose(spark, sf_dir))


def one_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _shifts(spark, sf_dir)
    best = strongest(economic_filter(rows, MIN_DEV, FILTER_BIN_N, MIN_RUN))
    return node_status(rows, best, "roc_5", MIN_DEV, GRID.horizons)


def counts_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivoted(_measured(spark, sf_dir)[0].withColumn("n", F.col("n_obs").cast("double")), "n", GRID.horizons)


def one_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_sheet(_measured(spark, sf_dir)[0], "roc_5", 0, GRID.horizons)


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return null_markers(_tests(spark, sf_dir)).select("node_id", "bin", "marker", F.round("at", 6).alias("at"))


def given_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surface again, from feature values, fixed edges and excursions that are given."""
    bars, values = bars_daily(spark, sf_dir), _features(spark, sf_dir)
    edges_given = fixed_edges(quantile_edges(values, N_BINS), bars)
    surface, _ = measure(bars, list(NODES), default_registry(), GRID, N_BINS, values, edges_given, excursions_wide(bars, (1, 2, *GRID.horizons)))
    return surface.select("node_id", "bin", "horizon", "barrier_idx", "n_obs", "n_hit", F.round("p", 9).alias("p"))


def restored_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known feature values alone, put back on all bars."""
    known = _features(spark, sf_dir).where("value is not null")
    return on_history(bars_daily(spark, sf_dir), known, [n.id for n in NODES]).select("node_id", "bar_idx", "value")


def unmeasured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_nodes([*NODES, Node("late", "ma_ratio", {"period": 10}, "own")], _measured(spark, sf_dir)[0])


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of raw event values, by the streaming expression over a table."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return stream_bars(events.select("ts", F.col("event_id").alias("key"), F.col("value").alias("price")))


def defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    closes = bars_daily(spark, sf_dir).select("bar_idx", "close")
    return with_defaults(closes).select("bar_idx", "open", "high", "low", "close", "volume")


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts over a panel with one fault of several kinds on every hundredth bar."""
    bars = bars_daily(spark, sf_dir)
    broken = bars.withColumns({
        "low": F.when(F.col("bar_idx") % 100 == 1, F.col("high") + 1).otherwise(F.col("low")),
        "close": F.when(F.col("bar_idx") % 100 == 2, F.lit(None).cast("double")).otherwise(F.col("close")),
        "volume": F.when(F.col("bar_idx") % 100 == 3, F.lit(-1.0)).otherwise(F.col("volume")),
        "open": F.when(F.col("bar_idx") % 100 == 4, F.lit(0.0)).otherwise(F.col("open")),
    })
    return violations(broken)


QUERIES: dict[str, Query] = {
    "bars_daily": lambda s, d: bars_daily(s, d).select("bar_idx", "ts", "open", "high", "low", "close", "volume"),
    "bars_hourly": lambda s, d: bars_hourly(s, d).select("bar_idx", "ts", "open", "high", "low", "close", "volume"),
    "dedup_keep_last": lambda s, d: dedup_keep_last(_messy(s, d)).select("ts", "close", "volume"),
    "clean_bars": lambda s, d: clean_bars(_messy(s, d), "1996-01-01").select("ts", "open", "high", "low", "close", "volume"),
    "ffill_aux": lambda s, d: ffill(auxiliary(s, d).withColumn("vix", F.when(F.dayofmonth("ts") % 5 != 0, F.col("vix"))), ["vix", "tnx"]),
    "asof_align": lambda s, d: panel(s, d).select("bar_idx", "ts", "close", "vix", "tnx", "dxy"),
    "default_columns": defaults,
    "validate_bars": validated,
    "node_coverage": lambda s, d: node_coverage(_features(s, d), 100),
    **{f"feature_{n}": _feature(n) for n in FEATURES},
    "forward_excursions": forward_excursions,
    "quantile_edges": edges,
    "bin_assignment": bins,
    "touch_rate_baseline": touch_rate_baseline,
    "conditional_surface": conditional_surface,
    "shift_surface": shifts,
    "barrier_pairs": lambda s, d: barrier_pairs(baseline_rates(excursions(bars_daily(s, d), GRID.horizons), GRID)),
    "bin_scores": scores,
    "economic_filter": filtered,
    "strongest_cell": strongest_cell,
    "inspection_target": target,
    "log_components": components,
    "null_fit": fit,
    "null_paths": paths,
    "monte_carlo_pvalue": tests,
    "catalogue_surface": catalogue,
    "monte_carlo_histories": two_histories,
    "ensemble_extended": extended,
    "selection": selected,
    "selected_heatmap": selected_heatmap,
    "selected_null": selected_null,
    "skipped_bins": skipped,
    "status_by_family": status,
    "node_status": one_node,
    "surface_pivot": lambda s, d: pivoted(_measured(s, d)[0], "p", GRID.horizons),
    "shift_pivot": lambda s, d: pivoted(_shifts(s, d), "shift", GRID.horizons),
    "null_histogram": histogram,
    "stream_bars": streamed,
    "sheet_counts": counts_sheet,
    "bin_sheet": one_sheet,
    "null_markers": markers,
    "selection_summary": lambda s, d: selection_summary(selection(_loose(s, d))),
    "measure_given": given_parts,
    "feature_restore": restored_values,
    "missing_nodes": unmeasured,
}
