"""Window primitives over one history: trailing frames that need every value, forward extremes, fills and scans.

A path is cut into chunks of CHUNK bars, and every window runs within a chunk, so no task sorts or holds
more than a chunk and its halo, however long a path is (bar_idx counts its bars from 0 without gaps):

* frames of bounded length see a chunk with a halo: the last bars before it, or the first after it, are
  sent along (``chunked``), and the halo's own results are dropped (``own_rows``);
* what depends on all earlier bars has two levels: each chunk alone, then one row a chunk (``filled``,
  ``exponential``).

Exponential averages are linear recurrences.  A bar is an affine map of the average before it, maps are
composed by an associative scan in strides of RADIX (a few projections, whatever the span), and a chunk takes
the composition of all earlier chunks as its start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BY = ("history_id", "rep_id")
CHUNK = 1024
RADIX = 4
MOST_CHUNKS = RADIX**8  # of one path whose exponential average is taken
_CHUNK, _OWN = "__chunk", "__own"


def path() -> Window:
    """The bars of one path in order."""
    return Window.partitionBy(*BY).orderBy("bar_idx")


def so_far() -> Window:
    """All bars of a path up to the present one; where a path is one of many short ones."""
    return path().rowsBetween(Window.unboundedPreceding, 0)


def chunked(panel: DataFrame, back: int = 0, ahead: int = 0, size: int | None = None) -> DataFrame:
    """``panel`` with each bar in its chunk, and again in the chunks that lack it within ``back`` bars before or ``ahead`` after."""
    size = size or CHUNK
    own = F.expr(f"bar_idx div {size}")
    if not back and not ahead:
        return panel.withColumn(_CHUNK, own).withColumn(_OWN, F.lit(True))
    first = F.greatest(F.expr(f"(bar_idx - {ahead}) div {size}"), F.lit(0))
    spread = panel.withColumn(_CHUNK, F.explode(F.sequence(first, F.expr(f"(bar_idx + {back}) div {size}"))))
    return spread.withColumn(_OWN, F.col(_CHUNK) == own)


def own_rows(rows: DataFrame) -> DataFrame:
    """Each bar once, as its own chunk has it."""
    return rows.where(F.col(_OWN)).drop(_CHUNK, _OWN)


def series() -> Window:
    """The bars of one chunk and its halo in order; the only sort that features need."""
    return Window.partitionBy(*BY, _CHUNK).orderBy("bar_idx")


def trailing(kind: str, column: str, n: int) -> Column:
    """mean, max, min or std (n - 1) of the last n values; NULL unless all n are there."""
    if n < 1:
        raise ValueError("a window needs at least one bar")
    w = series().rowsBetween(-(n - 1), 0)
    f = {"mean": F.avg, "max": F.max, "min": F.min, "std": F.stddev_samp}[kind]
    return F.when(F.count(column).over(w) == n, f(column).over(w))


def lag(column: str, n: int = 1) -> Column:
    return F.lag(column, n).over(series())


def lead(column: str, n: int = 1) -> Column:
    return F.lead(column, n).over(series())


def filled(panel: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``panel`` with the last known value of each column, at or before each bar, under its new name."""
    rows = chunked(panel)
    ends = rows.groupBy(*BY, _CHUNK).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("bar_idx"))).alias(f"{new}__end") for c, new in columns.items()])
    earlier = Window.partitionBy(*BY).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)  # one row a chunk
    given = ends.select(*BY, _CHUNK, *[F.last(f"{new}__end", ignorenulls=True).over(earlier).alias(f"{new}__given") for new in columns.values()])
    inside = series().rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({new: F.last(c, ignorenulls=True).over(inside) for c, new in columns.items()})
    rows = rows.join(given, [*BY, _CHUNK]).withColumns({new: F.coalesce(new, f"{new}__given") for new in columns.values()})
    return own_rows(rows).select(*panel.columns, *columns.values())


def _scanned(rows: DataFrame, names: list[str], order: Window, length: int) -> DataFrame:
    """Composes each row's affine maps with those of all rows before it, up to ``length`` rows back.

    A map has three columns: slope m and offset b, of an average that came before, and f, the average if none did
    (NULL: still none).  Strides grow by RADIX, and all look-backs of a stride are one projection.
    """
    stride = 1
    while stride < length:
        steps = min(RADIX, -(-length // stride))
        back = {}
        for n in names:
            for k in range(1, steps):
                for part, nothing in (("m", 1.0), ("b", 0.0), ("f", None)):
                    back[f"{n}__{part}{k}"] = F.lag(f"{n}__{part}", k * stride, nothing).over(order)
        rows = rows.withColumns(back)
        new = {}
        for n in names:
            at = lambda part, k: F.col(f"{n}__{part}{k or ''}")  # noqa: E731, B023
            m, b, f = (at(part, steps - 1) for part in "mbf")
            for k in range(steps - 2, -1, -1):
                m, b, f = at("m", k) * m, at("b", k) + at("m", k) * b, F.coalesce(at("m", k) * f + at("b", k), at("f", k))
            new |= {f"{n}__m": m, f"{n}__b": b, f"{n}__f": f}
        rows = rows.withColumns(new).drop(*back)
        stride *= RADIX
    return rows


def exponential(panel: DataFrame, averages: dict[str, tuple[str, int]]) -> DataFrame:
    """``panel`` with exponential averages, by name (column, span): y0 = x0, then y = a x + (1 - a) y, a = 2 / (span + 1).

    A bar without a value has no average, and leaves the one before as it is.
    """
    rows = chunked(panel)
    for n, (column, span) in averages.items():
        a, x = 2.0 / (span + 1.0), F.col(column)
        maps = {"m": F.when(x.isNull(), 1.0).otherwise(1.0 - a), "b": F.coalesce(a * x, F.lit(0.0)), "f": x}
        rows = rows.withColumns({f"{n}__{part}": c.cast("double") for part, c in maps.items()})
    names, parts = list(averages), [f"{n}__{part}" for n in averages for part in "mbf"]
    rows = _scanned(rows, names, series(), CHUNK)
    ends = rows.groupBy(*BY, _CHUNK).agg(F.max_by(F.struct(*parts), "bar_idx").alias("end")).select(*BY, _CHUNK, "end.*")
    chunks = Window.partitionBy(*BY).orderBy(_CHUNK)  # one row a chunk
    ends = _scanned(ends, names, chunks, MOST_CHUNKS)
    starts = ends.select(*BY, _CHUNK, *[F.lag(f"{n}__f").over(chunks).alias(f"{n}__start") for n in names])
    rows = rows.join(starts, [*BY, _CHUNK])
    value = lambda n: F.coalesce(F.col(f"{n}__m") * F.col(f"{n}__start") + F.col(f"{n}__b"), F.col(f"{n}__f"))
    rows = rows.withColumns({n: F.when(F.col(column).isNotNull(), value(n)) for n, (column, _) in averages.items()})
    return own_rows(rows).select(*panel.columns, *names)
