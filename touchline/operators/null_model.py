"""The Gaussian null: log components of bars, their fit, and simulated price paths.

Draws are counter-based: each is a hash of (seed, replicate, bar, component), so paths do not
depend on partitions, retries or the number of executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SEED
from ..functions.windows import chunked, lag, own_rows, path, so_far

COMPONENTS = ("g_open", "g_close", "g_high", "g_low")
PLACES = 12  # of fitted moments and of log steps: sums of steps are then exact whole numbers
PRICE_PLACES = 4


def log_components(panel: DataFrame) -> DataFrame:
    """(history_id, rep_id, bar_idx, g_open, g_close, g_high, g_low); rows with a non-finite one are dropped.

    The first bar is its own previous close and stays in.
    """
    before = F.coalesce(lag("close"), F.col("close"))
    body = (F.greatest("open", "close"), F.least("open", "close"))
    log = lambda a, b: F.ln(F.try_divide(a, b))
    rows = own_rows(chunked(panel, back=1).withColumn("__prev", before)).select(
        "history_id", "rep_id", "bar_idx", log(F.col("open"), F.col("__prev")).alias("g_open"), log(F.col("close"), F.col("open")).alias("g_close"),
        log(F.col("high"), body[0]).alias("g_high"), log(F.col("low"), body[1]).alias("g_low"),
    )
    return rows.dropna("any", subset=list(COMPONENTS))


def null_fit(components: DataFrame) -> DataFrame:
    """One row per history: means m0..m3 and the lower Cholesky factor l00..l33 of the jittered covariance."""
    pairs = [(i, j) for i in range(4) for j in range(i + 1)]
    moments = [F.round(F.avg(c), PLACES).alias(f"m{i}") for i, c in enumerate(COMPONENTS)]
    moments += [F.round(F.covar_samp(COMPONENTS[i], COMPONENTS[j]), 15).alias(f"s{i}{j}") for i, j in pairs]
    fit = components.groupBy("history_id").agg(*moments)
    jitter = 1e-12 * F.greatest(*[F.abs(f"s{i}{i}") for i in range(4)], F.lit(1.0))
    fit = fit.withColumn("jitter", jitter)
    for i, j in pairs:
        rest = sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        value = F.sqrt(F.col(f"s{i}{i}") + F.col("jitter") - rest) if i == j else F.try_divide(F.col(f"s{i}{j}") - rest, F.col(f"l{j}{j}"))
        fit = fit.withColumn(f"l{i}{j}", value)
    return fit.select("history_id", *[f"m{i}" for i in range(4)], *[F.round(f"l{i}{j}", PLACES).alias(f"l{i}{j}") for i, j in pairs])


def _uniform(seed: int, component: int) -> Column:
    """(k + 1/2) / 2^52 from the first 52 bits of a hash of the counter."""
    text = F.concat_ws(":", F.lit(str(seed)), F.col("rep_id").cast("string"), F.col("bar_idx").cast("string"), F.lit(str(component)))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def normals(seed: int) -> list[Column]:
    """Four standard normal draws for (rep_id, bar_idx), by the Box-Muller transform."""
    u = [_uniform(seed, k) for k in range(4)]
    out = []
    for a, b in ((0, 1), (2, 3)):
        radius, angle = F.sqrt(-2.0 * F.ln(u[a])), F.lit(2.0 * math.pi) * u[b]
        out += [radius * F.cos(angle), radius * F.sin(angle)]
    return out


def null_paths(panel: DataFrame, fit: DataFrame, replicates: int | DataFrame, seed: int = SEED) -> DataFrame:
    """Panels of rep_id 1 .. ``replicates`` as long as the observed one, with its times and volume; or of the given (history_id, rep_id).

    Each path runs in a partition of its own.  Highs and lows may leave the body, as they do
    under the fitted model; simulated bars are not repaired.
    """
    observed = panel.where("rep_id = 0").select("history_id", "bar_idx", "ts", "volume")
    start = panel.where("rep_id = 0").groupBy("history_id").agg(F.min_by("close", "bar_idx").alias("c0"))
    # a handful of numbers per history goes to every bar; how they travel is left to the optimiser
    base = observed.join(fit.join(start, "history_id"), "history_id")
    if isinstance(replicates, int):
        rows = base.withColumn("rep_id", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    else:
        rows = base.join(replicates, "history_id")
    rows = rows.repartition("history_id", "rep_id")
    rows = rows.withColumns({f"z{k}": F.round(z, PLACES) for k, z in enumerate(normals(seed))})
    for i in range(4):
        step = sum((F.col(f"z{k}") * F.col(f"l{i}{k}") for k in range(i + 1)), F.col(f"m{i}"))
        rows = rows.withColumn(f"g{i}", F.round(step * 1e12).cast("long"))
    total = F.sum(F.col("g0") + F.col("g1")).over(so_far())
    rows = rows.withColumn("__close", F.col("c0") * F.exp(total / 1e12))
    rows = rows.withColumn("__prev", F.coalesce(F.lag("__close").over(path()), F.col("c0")))
    step = lambda k: F.exp(F.col(f"g{k}") / 1e12)
    rows = rows.withColumn("__open", F.col("__prev") * step(0))
    rows = rows.withColumn("__high", F.greatest("__open", "__close") * step(2)).withColumn("__low", F.least("__open", "__close") * step(3))
    price = lambda c: F.round(F.col(f"__{c}"), PRICE_PLACES).alias(c)
    return rows.select("history_id", F.col("rep_id").cast("int").alias("rep_id"), "bar_idx", "ts", price("open"), price("high"), price("low"), price("close"), "volume")
