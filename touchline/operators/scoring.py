"""Comparison: shifts from the baseline, mirrored scores, the economic filter and the inspection target."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import MIN_BIN_N, Grid
from ..functions.windows import BY

ZERO = 1e-12  # barriers at most so far from nought have no mirror
SCORE_PLACES = 9


def shift_surface(surface: DataFrame, baseline: DataFrame) -> DataFrame:
    """The surface with base_p and shift = p - base_p, a difference of probabilities in [-1, 1]."""
    base = baseline.select(*BY, "barrier_idx", "horizon", F.col("p").alias("base_p"))
    joined = surface.join(base, [*BY, "barrier_idx", "horizon"])
    return joined.withColumn("shift", F.col("p") - F.col("base_p"))


def mirrored(barriers: tuple[float, ...]) -> list[tuple[int, int, float]]:
    """(row of +d, row of -d, weight) of each magnitude that has exactly one row of each sign.

    A pair weighs its magnitude over the largest paired one.
    """
    near = lambda a, b: abs(a - b) <= 1e-12 + 1e-5 * abs(b)
    found = []
    for d in sorted({abs(b) for b in barriers if abs(b) > ZERO}):
        plus = [k for k, b in enumerate(barriers) if near(b, d)]
        minus = [k for k, b in enumerate(barriers) if near(b, -d)]
        if len(plus) == len(minus) == 1:
            found.append((plus[0], minus[0], d))
    top = max((d for _, _, d in found), default=1.0)
    return [(a, b, d / top) for a, b, d in found]


def barrier_pairs(rates: DataFrame) -> DataFrame:
    """(barrier_idx, barrier, mirror_idx, weight) of the barriers that a table of rates has: each row of a pair carries half of the pair's weight.

    A barrier without a pair is its own mirror and weighs nothing.  Magnitudes are compared to 9 places.
    """
    rows = rates.select("barrier_idx", "barrier").distinct()
    size = F.round(F.abs("barrier"), 9)
    sides = rows.where(F.abs("barrier") > ZERO).groupBy(size.alias("d")).agg(
        F.count_if(F.col("barrier") > 0).alias("plus"), F.count_if(F.col("barrier") < 0).alias("minus"),
        F.max(F.when(F.col("barrier") > 0, F.col("barrier_idx"))).alias("up"), F.max(F.when(F.col("barrier") < 0, F.col("barrier_idx"))).alias("down"),
        F.max(F.abs("barrier")).alias("magnitude"),
    )
    pairs = sides.where("plus = 1 and minus = 1")
    pairs = pairs.withColumn("top", F.max("magnitude").over(Window.partitionBy(F.lit(0))))  # a grid has few barriers
    both = pairs.select(F.explode(F.array(F.struct(F.col("up").alias("k"), F.col("down").alias("m")), F.struct(F.col("down").alias("k"), F.col("up").alias("m")))).alias("x"), (F.col("magnitude") / F.col("top") / 2).alias("weight"))
    both = both.select(F.col("x.k").alias("barrier_idx"), F.col("x.m").alias("mirror_idx"), "weight")
    return rows.join(both, "barrier_idx", "left").select("barrier_idx", "barrier", F.coalesce("mirror_idx", "barrier_idx").alias("mirror_idx"), F.coalesce("weight", F.lit(0.0)).alias("weight"))


def bin_scores(shifts: DataFrame, grid: Grid) -> DataFrame:
    """(.., node_id, bin, score, supported): weighted absolute differences of mirrored shifts.

    A pair counts in a bin if both shifts are known, the bin has MIN_BIN_N observations, and
    at least two bins of the node have it at that horizon.  One aggregate brings the two rows
    of a pair together; nothing is joined.
    """
    pairs = mirrored(grid.barriers)
    keys = [*BY, "node_id", "bin"]
    if not pairs:
        return shifts.groupBy(*keys).agg(F.lit(0.0).alias("score"), F.lit(False).alias("supported"))
    of = {k: (i, sign) for i, (a, b, _) in enumerate(pairs) for k, sign in ((a, 1), (b, -1))}
    table = F.create_map(*[F.lit(x) for k, (i, _) in of.items() for x in (k, i)])
    signs = F.create_map(*[F.lit(x) for k, (_, s) in of.items() for x in (k, s)])
    weights = F.array(*[F.lit(w) for _, _, w in pairs])
    rows = shifts.withColumn("pair", F.try_element_at(table, F.col("barrier_idx"))).withColumn("sign", F.try_element_at(signs, F.col("barrier_idx")))
    side = lambda s: F.max(F.when(F.col("sign") == s, F.col("shift")))
    # barriers without a pair keep their bin in the result
    both = rows.groupBy(*keys, "horizon", "pair").agg(side(1).alias("up"), side(-1).alias("down"), F.max("n_obs").alias("n_obs"))
    diff = F.abs(F.col("up") - F.col("down"))
    usable = F.coalesce(F.col("pair").isNotNull() & diff.isNotNull() & (F.col("n_obs") >= MIN_BIN_N), F.lit(False))
    w = Window.partitionBy(*BY, "node_id", "horizon", "pair")
    both = both.withColumn("usable", usable).withColumn("usable", F.col("usable") & (F.sum(F.col("usable").cast("int")).over(w) >= 2))
    share = F.when(F.col("usable"), diff * F.get(weights, F.col("pair"))).otherwise(0.0)
    return both.groupBy(*keys).agg(F.round(F.sum(share), SCORE_PLACES).alias("score"), F.max("usable").alias("supported"))


def economic_filter(shifts: DataFrame, min_dev: float = 0.10, min_bin_n: int = 50, min_run: int = 2) -> DataFrame:
    """The best cell of each (node, horizon): the largest shift within a run of adjacent barriers.

    A run is of one sign with every |shift| at least min_dev, in bins of at least min_bin_n
    observations, min_run barriers long; gaps-and-islands over the barriers of a bin.  Ties
    go to the lowest bin, then the lowest barrier.  ``run`` is the run's length where the
    cell first stood as its largest one.
    """
    if not (math.isfinite(min_dev) and 0 <= min_dev <= 1):
        raise ValueError("min_dev is a difference of probabilities from 0 to 1")
    keys = [*BY, "node_id", "bin", "horizon"]
    w = Window.partitionBy(*keys).orderBy("barrier_idx")
    rows = shifts.where(F.col("n_obs") >= min_bin_n).withColumn("sign", F.when(F.abs("shift") >= min_dev, F.signum("shift")))
    rows = rows.withColumn("new", (F.col("sign").isNull() | ~F.lag("sign").over(w).eqNullSafe(F.col("sign"))).cast("int"))
    rows = rows.withColumn("island", F.sum("new").over(w)).where("sign is not null")
    inside = Window.partitionBy(*keys, "island")
    rows = rows.withColumn("place", F.row_number().over(inside.orderBy("barrier_idx"))).withColumn("length", F.count("*").over(inside))
    long = rows.where(F.col("length") >= min_run)
    cell = F.struct("bin", "barrier", F.col("shift").alias("dev"), F.greatest(F.lit(min_run), "place").cast("int").alias("run"), "p", "base_p", "n_obs", "n_hit")
    order = F.struct(F.abs("shift"), -F.col("bin"), -F.col("barrier_idx"))
    best = long.groupBy(*BY, "node_id", "horizon").agg(F.max_by(cell, order).alias("c"))
    return best.select(*BY, "node_id", "horizon", "c.*")


def strongest(filtered: DataFrame) -> DataFrame:
    """The best cell of each node: the largest |dev|, the earliest horizon on ties."""
    order = F.struct(F.abs("dev"), -F.col("horizon"))
    cell = F.struct("horizon", "bin", "barrier", "dev", "run", "p", "base_p", "n_obs", "n_hit")
    return filtered.groupBy(*BY, "node_id").agg(F.max_by(cell, order).alias("c")).select(*BY, "node_id", "c.*")


def inspection_target(baseline: DataFrame, horizon: int, barrier: float | None = None, rate: float = 0.30) -> DataFrame:
    """(target_barrier, target_horizon): the given barrier, or the negative one whose rate is nearest ``rate``."""
    if barrier is not None:
        return baseline.sparkSession.createDataFrame([(float(barrier), int(horizon))], "target_barrier double, target_horizon int")
    rows = baseline.where((F.col("rep_id") == 0) & (F.col("horizon") == horizon) & (F.col("barrier") < 0) & F.col("p").isNotNull())
    nearest = F.min_by("barrier", F.struct(F.abs(F.col("p") - F.lit(rate)), "barrier_idx"))
    return rows.agg(nearest.alias("target_barrier")).withColumn("target_horizon", F.lit(int(horizon)))
