"""Monte-Carlo tests of bin scores, and the selection of bins that clear the threshold.

The observed path is replicate 0 of the same plan as the simulated ones, so both go through
the same expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import N_REPLICATES, P_THRESHOLD, SEED, Grid, Node
from ..functions.features import FeatureRegistry, long_features, node_batches
from ..shared import materialise
from .null_model import log_components, null_fit, null_paths
from .scoring import bin_scores, shift_surface
from .surface import assign_bins, baseline_rates, conditional_rates, excursions_wide, quantile_edges


def all_features(observed: DataFrame, paths: DataFrame | None, nodes: list[Node], registry: FeatureRegistry) -> DataFrame:
    """Feature values on all paths: core features are recomputed, fixed ones carried over from the observed path."""
    core = [n for n in nodes if registry.get(n.feature).core]
    fixed = [n for n in nodes if not registry.get(n.feature).core]
    parts = []
    if core:
        columns = [c for c in observed.columns if paths is None or c in paths.columns]
        rows = observed.select(*columns)
        parts += [long_features(rows if paths is None else rows.unionByName(paths.select(*columns)), own, registry) for own in node_batches(core, registry)]
    if fixed:
        own = [long_features(observed, some, registry) for some in node_batches(fixed, registry)]
        parts += own
        if paths is not None:
            replicas = paths.select("history_id", "rep_id").distinct()
            parts += [x.drop("rep_id").join(replicas, "history_id").select(x.columns) for x in own]
    if not parts:
        raise ValueError("there are no nodes")
    return reduce(DataFrame.unionByName, parts)


def block_scores(observed: DataFrame, paths: DataFrame | None, nodes: list[Node], registry: FeatureRegistry, grid: Grid, n_bins: int, exc: DataFrame) -> DataFrame:
    """(history_id, rep_id, node_id, bin, score, supported) of the paths that ``exc`` holds.

    Edges of core features are found anew on each path, those of fixed features are the observed ones.
    """
    core = [n for n in nodes if registry.get(n.feature).core]
    fixed = [n for n in nodes if not registry.get(n.feature).core]
    parts = [materialise(all_features(observed, paths, own, registry), "features") for some in (core, fixed) for own in node_batches(some, registry)]
    values = reduce(DataFrame.unionByName, parts)
    bins = assign_bins(values, quantile_edges(values, n_bins))
    return bin_scores(shift_surface(conditional_rates(exc, bins, grid), baseline_rates(exc, grid)), grid)


def path_scores(observed: DataFrame, nodes: list[Node], registry: FeatureRegistry, grid: Grid, n_bins: int, n_replicates: int = N_REPLICATES, seed: int = SEED) -> DataFrame:
    """``block_scores`` of the observed path (0) and all simulated ones, nothing of which is kept beyond the session.

    Paths, feature values and excursions are each written once in the shared folder, since several steps read
    them; excursions stay one row per bar until they are counted.
    """
    columns = ["history_id", "rep_id", "bar_idx", "ts", "open", "high", "low", "close", "volume"]
    simulated = null_paths(observed, null_fit(log_components(observed)), n_replicates, seed)
    paths = materialise(simulated.select(*columns), "paths")
    exc = materialise(excursions_wide(observed.select(*columns).unionByName(paths), grid.horizons), "excursions")
    return block_scores(observed, paths, nodes, registry, grid, n_bins, exc)


def monte_carlo(scores: DataFrame, n_replicates: int, threshold: float = P_THRESHOLD) -> DataFrame:
    """One row per supported observed bin: its score, p-value, null 95th percentile and verdict.

    p = (1 + #{null >= observed}) / (1 + n); ties count, null bins without support or row score 0
    and stay in n.  Bins are matched by place.
    """
    keys = ["history_id", "node_id", "bin"]
    seen = scores.where("rep_id = 0 and supported").select(*keys, F.col("score").alias("bin_score"))
    null = scores.where("rep_id > 0").groupBy(*keys).agg(F.collect_list(F.when(F.col("supported"), F.col("score")).otherwise(0.0)).alias("found"), F.count_if("supported").alias("n_supported_null"))
    rows = seen.join(null, keys, "left").withColumn("found", F.coalesce("found", F.array().cast("array<double>")))
    # one value per replicate, absent ones are nought
    rows = rows.withColumn("null_scores", F.sort_array(F.concat("found", F.array_repeat(F.lit(0.0), F.lit(n_replicates) - F.size("found")))))
    above = F.size(F.filter("null_scores", lambda x: x >= F.col("bin_score")))
    at = F.lit(0.95 * (n_replicates - 1))
    low = F.floor(at).cast("int")
    value = lambda k: F.get(F.col("null_scores"), k)
    p95 = value(low) + (at - low) * (F.coalesce(value(low + 1), value(low)) - value(low))
    p = (1 + above) / F.lit(1.0 + n_replicates)
    return rows.select(
        *keys, "bin_score", p.alias("monte_carlo_p_value"), (p < threshold).alias("cleared"), F.round(p95, 9).alias("null_p95"),
        F.lit(n_replicates).cast("long").alias("n_null_replicates"), F.coalesce("n_supported_null", F.lit(0)).cast("long").alias("n_supported_null"), "null_scores",
    )


def skipped_bins(scores: DataFrame) -> DataFrame:
    """Observed bins without support."""
    rows = scores.where("rep_id = 0 and not supported")
    return rows.select("history_id", "node_id", "bin", F.lit("no eligible cells").alias("reason"))


def missing_nodes(declared: list[Node], measured: DataFrame) -> DataFrame:
    """Declared nodes that have no measurement: an anti-join on their ids."""
    spark = measured.sparkSession
    return spark.createDataFrame([(n.id,) for n in declared], "node_id string").join(measured.select("node_id").distinct(), "node_id", "left_anti")


def selection(tests: DataFrame) -> DataFrame:
    """All cleared bins in total order, numbered from 1: p up, score down, node, bin."""
    w = Window.orderBy("monte_carlo_p_value", F.desc("bin_score"), "node_id", "bin")
    return tests.where("cleared").withColumn("selection_number", F.row_number().over(w).cast("long"))
