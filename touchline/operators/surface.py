"""Measurement: forward extremes, quantile bins, and touch probabilities by bin, barrier and horizon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MIN_BIN_N, Grid, Node
from ..functions.features import FeatureRegistry, kept_features
from ..functions.windows import BY, chunked, lead, own_rows
from ..shared import materialise

SEGMENT_ROWS = 1 << 20  # values of a node that are ordered together
SEGMENT_BINS = 4096


def excursions_wide(panel: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """(.., bar_idx, exc): one row per bar with an array of (horizon, down, up), the extremes of the next bars relative to the close.

    down and up are NULL unless as many bars follow.  Horizons may come in any order and repeat, each distinct
    one is measured once.  Extremes over the next 1, 2, 4, ... bars are doubled step by step, and a horizon
    takes two of them that overlap: the work grows with the logarithm of the longest horizon.  Chunks get
    as many bars after them as it has.
    """
    own = sorted(set(horizons))
    if not own or own[0] < 1:
        raise ValueError("horizons are whole numbers from 1 on")
    sides = {"down": ("low", F.least), "up": ("high", F.greatest)}
    both = lambda f, a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), f(a, b))
    rows = chunked(panel, ahead=own[-1])
    rows = rows.withColumns({f"__{side}0": lead(column) for side, (column, _) in sides.items()})
    for k in range(own[-1].bit_length() - 1):
        rows = rows.withColumns({f"__{side}_next": lead(f"__{side}{k}", 1 << k) for side in sides})
        rows = rows.withColumns({f"__{side}{k + 1}": both(f, f"__{side}{k}", f"__{side}_next") for side, (_, f) in sides.items()})
    table = {h: h.bit_length() - 1 for h in own}
    rest = {f"__{side}_h{h}": lead(f"__{side}{table[h]}", h - (1 << table[h])) for h in own if h != 1 << table[h] for side in sides}
    rows = own_rows(rows.withColumns(rest) if rest else rows)
    found = lambda side, f, h: both(f, f"__{side}{table[h]}", f"__{side}_h{h}") if f"__{side}_h{h}" in rest else F.col(f"__{side}{table[h]}")
    change = lambda side, f, h: (F.try_divide(found(side, f, h), F.col("close")) - 1).alias(side)
    cells = [F.struct(F.lit(h).alias("horizon"), *[change(side, f, h) for side, (_, f) in sides.items()]) for h in own]
    return rows.select(*BY, "bar_idx", F.array(*cells).alias("exc"))


def by_horizon(wide: DataFrame) -> DataFrame:
    """One row per bar and horizon of what excursions_wide gives, with all other columns."""
    rest = [c for c in wide.columns if c != "exc"]
    return wide.select(*rest, F.explode("exc").alias("x")).select(*rest, "x.horizon", "x.down", "x.up")


def excursions(panel: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """(.., bar_idx, horizon, down, up), see excursions_wide."""
    return by_horizon(excursions_wide(panel, horizons))


def quantile_edges(features: DataFrame, n_bins: int, most: int = SEGMENT_ROWS) -> DataFrame:
    """(.., node_id, edges): exact linear quantiles at j / n, without repeats, above the least and up to the largest value.

    An edge lies between two values of known ranks, which are selected exactly: a segment of a node's values
    that holds wanted ranks and more than ``most`` values is cut into SEGMENT_BINS bins between its least and largest
    value, whose counts (summed before the shuffle) tell which bins hold the ranks; these are the
    next segments.  What is left is counted by value and ordered, a segment at a time.  No buffer and no
    task holds more values than that, however many distinct ones a path has.
    """
    if n_bins < 1:
        raise ValueError("there is at least one bin")
    keys = [*BY, "node_id"]
    known = features.where("value is not null").select(*keys, "value")
    if n_bins == 1:
        return known.select(*keys).distinct().select(*keys, F.array().cast("array<double>").alias("edges"))
    groups = materialise(known.groupBy(*keys).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")), "groups")
    places = F.array(*[(F.col("n") - 1) * F.lit(j / n_bins) for j in range(1, n_bins)])
    ranks = F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(F.floor(p), F.ceil(p)))))
    segments = groups.select(*keys, "low", "high", "n", F.lit(0).cast("long").alias("before"), ranks.alias("ranks"))
    while (segments.where("low < high").agg(F.max("n")).first()[0] or 0) > most:
        segments = materialise(_narrowed(known, segments), "segments")
    found = _ranked(_within(known, segments.where("low < high")).groupBy(*keys, "low", "before", "ranks", "value").agg(F.count("*").alias("n")), "value")
    found = found.select(*keys, F.explode("ranks").alias("rank"), "value")
    one_value = segments.where("low = high").select(*keys, F.explode("ranks").alias("rank"), F.col("low").alias("value"))
    at = found.unionByName(one_value).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))  # two ranks an edge
    value = lambda p: F.element_at("at", p)
    between = lambda p: F.when(F.floor(p) == F.ceil(p), value(F.floor(p))).otherwise((F.ceil(p) - p) * value(F.floor(p)) + (p - F.floor(p)) * value(F.ceil(p)))
    rows = groups.join(at, keys).select(*keys, "low", "high", F.transform(places, lambda p: F.round(between(p), 9)).alias("q"))
    return rows.select(*keys, F.filter(F.array_distinct("q"), lambda e: (e > F.col("low")) & (e <= F.col("high"))).alias("edges"))


def _within(known: DataFrame, segments: DataFrame) -> DataFrame:
    """The values of each segment; a node has few segments, so they travel and the values need not."""
    return known.join(segments.drop("n"), [*BY, "node_id"]).where("value between low and high")


def _ranked(counted: DataFrame, order: str) -> DataFrame:
    """Rows of counts n within a segment that hold some of its ranks, with those and with how many values come before."""
    w = Window.partitionBy(*BY, "node_id", "low").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = counted.withColumn("before", F.col("before") + F.coalesce(F.sum("n").over(w), F.lit(0)))
    rows = rows.withColumn("ranks", F.filter("ranks", lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n"))))
    return rows.where(F.size("ranks") > 0)


def _narrowed(known: DataFrame, segments: DataFrame) -> DataFrame:
    """The bins of the segments that hold wanted ranks, as segments between the least and largest of their values."""
    part = F.try_divide(F.col("value") / 2 - F.col("low") / 2, F.col("high") / 2 - F.col("low") / 2)  # halves: no overflow
    cut = F.least(F.floor(F.coalesce(part, F.lit(0.0)) * SEGMENT_BINS), F.lit(SEGMENT_BINS - 1)).alias("bin")
    counted = _within(known, segments).groupBy(*BY, "node_id", "low", "before", "ranks", cut)
    counted = counted.agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("largest"))
    return _ranked(counted, "bin").select(*BY, "node_id", F.col("least").alias("low"), F.col("largest").alias("high"), "n", "before", "ranks")


def bin_of(value: Column, edges: Column) -> Column:
    """Bins from 0; a value on an edge is in the lower bin."""
    return F.size(F.filter(edges, lambda e: e < value))


def assign_bins(features: DataFrame, edges: DataFrame) -> DataFrame:
    """(.., node_id, bar_idx, value, bin) of every known value."""
    joined = features.where("value is not null").join(edges, [*BY, "node_id"])
    return joined.select(*BY, "node_id", "bar_idx", "value", bin_of(F.col("value"), F.col("edges")).alias("bin"))


def feature_label(node: Node) -> str:
    """How a node reads in a report: its feature and parameters."""
    params = ", ".join(f"{k}={v:g}" if isinstance(v, float) else f"{k}={v}" for k, v in node.params.items())
    return f"{node.feature}({params})" if params else node.feature


def sheet_names(labels: list[str], longest: int = 31) -> list[str]:
    """Distinct names of at most ``longest`` characters without those that spreadsheets refuse; a number tells equal ones apart."""
    out: list[str] = []
    for label in labels:
        base = "".join(" " if c in "[]:*?/\\" else c for c in label).strip("' ") or "sheet"
        name, k = base[:longest], 2
        while name.lower() in {x.lower() for x in out}:
            tail = f" ({k})"
            name, k = base[: longest - len(tail)] + tail, k + 1
        out.append(name)
    return out


def bin_labels(edges: list[float]) -> list[str]:
    """How the bins read: x < a, a < x < b, b < x; "all" for a single one."""
    if not edges:
        return ["all"]
    inner = [f"{a:.4g} < x < {b:.4g}" for a, b in zip(edges, edges[1:])]
    return [f"x < {edges[0]:.4g}", *inner, f"{edges[-1]:.4g} < x"]


def _touch(barrier: float) -> Column:
    """A fall reaches a negative barrier, a rise all others, nought included."""
    return F.col("down") <= F.lit(barrier) if barrier < 0 else F.col("up") >= F.lit(barrier)


def touch_counts(rows: DataFrame, keys: list[str], grid: Grid) -> DataFrame:
    """(keys, barrier_idx, barrier, n_obs, n_hit, p) from rows with down and up.

    One hash aggregate counts all barriers at once (partial sums before the shuffle), so
    rows are never multiplied by barriers.  p is NULL below MIN_BIN_N observations.
    """
    known = rows.where(F.col("down").isNotNull() & F.col("up").isNotNull())
    hits = [F.count_if(_touch(b)).alias(f"__h{k}") for k, b in enumerate(grid.barriers)]
    counted = known.groupBy(*keys).agg(F.count("*").alias("n_obs"), *hits)
    cells = F.array(*[F.struct(F.lit(k).alias("barrier_idx"), F.lit(b).alias("barrier"), F.col(f"__h{k}").alias("n_hit")) for k, b in enumerate(grid.barriers)])
    p = F.when(F.col("n_obs") >= MIN_BIN_N, F.col("x.n_hit") / F.col("n_obs"))
    return counted.select(*keys, "n_obs", F.explode(cells).alias("x")).select(*keys, "x.barrier_idx", "x.barrier", "n_obs", "x.n_hit", p.alias("p"))


def _tall(exc: DataFrame) -> DataFrame:
    return by_horizon(exc) if "exc" in exc.columns else exc


def baseline_rates(exc: DataFrame, grid: Grid) -> DataFrame:
    """Unconditional touch probabilities; warm-up of features plays no part."""
    return touch_counts(_tall(exc), [*BY, "horizon"], grid)


def conditional_rates(exc: DataFrame, bins: DataFrame, grid: Grid) -> DataFrame:
    """Touch probabilities by node and bin; a cell without observations has no row.

    With wide excursions the join meets one row per bar, and horizons only unfold within the
    pipelined stage that counts.
    """
    joined = bins.select(*BY, "node_id", "bar_idx", "bin").join(exc, [*BY, "bar_idx"])
    return touch_counts(_tall(joined), [*BY, "node_id", "bin", "horizon"], grid)


def fixed_edges(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """The observed path's edges (rep_id 0) for every path of ``paths``."""
    observed = edges.where("rep_id = 0").drop("rep_id")
    return observed.join(paths.select(*BY).distinct(), "history_id").select(*edges.columns)


def measure(
    panel: DataFrame, nodes: list[Node], registry: FeatureRegistry, grid: Grid, n_bins: int, features: DataFrame | None = None,
    edges: DataFrame | None = None, excursions: DataFrame | None = None, baseline: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(surface, baseline) of all nodes over all paths of a panel, in one plan.

    What is known already may be given: feature values, bin edges (for instance ``fixed_edges``), excursions
    (wide or tall; their horizons must hold the grid's) and baseline.
    """
    values = kept_features(panel, nodes, registry) if features is None else features
    if excursions is not None:
        found = {r.horizon for r in _tall(excursions).select("horizon").distinct().collect()}
        if found and not set(grid.horizons) <= found:
            raise ValueError(f"the excursions lack the horizons {sorted(set(grid.horizons) - found)}")
        kept = F.array(*map(F.lit, sorted(set(grid.horizons))))
        if "exc" in excursions.columns:
            exc = excursions.withColumn("exc", F.filter("exc", lambda x: F.array_contains(kept, x["horizon"])))
        else:
            exc = excursions.where(F.col("horizon").isin(list(grid.horizons)))
    else:
        exc = materialise(excursions_wide(panel, grid.horizons), "excursions")  # counted twice
    bins = assign_bins(values, quantile_edges(values, n_bins) if edges is None else edges)
    return conditional_rates(exc, bins, grid), baseline_rates(exc, grid) if baseline is None else baseline


def on_history(bars: DataFrame, values: DataFrame, node_ids: list[str]) -> DataFrame:
    """Kept feature values on every bar of a history, in (.., bar_idx, ts, node_id, value); NULL where a bar has none."""
    every = bars.select(*BY, "bar_idx", "ts", F.explode(F.array(*map(F.lit, node_ids))).alias("node_id"))
    return every.join(values.select(*BY, "node_id", "bar_idx", "value"), [*BY, "bar_idx", "node_id"], "left")


def node_coverage(features: DataFrame, min_obs: int) -> DataFrame:
    """(node_id, n_valid, enough): observed values of each node."""
    seen = features.where("rep_id = 0").groupBy("node_id").agg(F.count("value").alias("n_valid"))
    return seen.withColumn("enough", F.col("n_valid") >= min_obs)
