"""Report relations: pivoted surfaces, null histograms, progress by family, one node's table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Node
from .surface import bin_labels, feature_label, sheet_names

SHOWN_HORIZONS = (1, 2, 3, 5, 7, 10, 14, 21, 30)


def pivoted(surface: DataFrame, value: str, horizons: tuple[int, ...], places: int = 4) -> DataFrame:
    """One row per (node, bin, barrier) with a column h<horizon> for each; conditional aggregates, no pivot scan."""
    cells = [F.round(F.max(F.when(F.col("horizon") == h, F.col(value))), places).alias(f"h{h}") for h in horizons]
    return surface.where("rep_id = 0").groupBy("node_id", "bin", "barrier_idx", "barrier").agg(*cells)


def bin_sheet(surface: DataFrame, node_id: str, bin: int, horizons: tuple[int, ...], value: str = "p") -> DataFrame:
    """One bin's sheet: a row with the observations at each horizon, then its barriers from the highest down."""
    own = surface.where((F.col("rep_id") == 0) & (F.col("node_id") == node_id) & (F.col("bin") == bin))
    counts = own.agg(*[F.max(F.when(F.col("horizon") == h, F.col("n_obs"))).cast("double").alias(f"h{h}") for h in horizons])
    head = counts.select(F.lit("n").alias("row"), F.lit(None).cast("double").alias("barrier"), "*")
    body = pivoted(own, value, horizons).select(F.lit(value).alias("row"), "barrier", *[f"h{h}" for h in horizons])
    return head.unionByName(body).orderBy(F.col("row") != "n", F.desc("barrier"))


def bin_table(edges: DataFrame, nodes: list[Node]) -> DataFrame:
    """(node_id, sheet, feature_label, bin, bin_label): how each bin of each node reads, and the sheet that it goes to."""
    labels = [feature_label(n) for n in nodes]
    named = {n.id: (sheet, label) for n, sheet, label in zip(nodes, sheet_names(labels), labels)}
    found = edges.where("rep_id = 0").select("node_id", "edges").collect()  # nodes are declared one by one
    rows = [(r.node_id, *named[r.node_id], k, text) for r in found if r.node_id in named for k, text in enumerate(bin_labels(r.edges))]
    return edges.sparkSession.createDataFrame(rows, "node_id string, sheet string, feature_label string, bin int, bin_label string")


def heatmap(shifts: DataFrame, selected: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """Surfaces of the selected bins only, without the barrier at nought."""
    own = shifts.where(F.abs("barrier") > 1e-12).join(selected.select("node_id", "bin"), ["node_id", "bin"], "left_semi")
    return pivoted(own, "shift", horizons)


def null_histogram(tests: DataFrame, low: int = 24, high: int = 80) -> DataFrame:
    """(node_id, bin, n_bars, bar, left, right, n): Freedman-Diaconis bars of the null scores, low to high of them."""
    rows = tests.select("node_id", "bin", "null_scores", F.size("null_scores").alias("size"))
    at = lambda q: F.lit(q) * (F.col("size") - 1)

    def quantile(q: float):
        k = F.floor(at(q)).cast("int")
        a, b = F.get("null_scores", k), F.coalesce(F.get("null_scores", k + 1), F.get("null_scores", k))
        return a + (at(q) - k) * (b - a)

    rows = rows.withColumn("low", F.get("null_scores", F.lit(0))).withColumn("high", F.get("null_scores", F.col("size") - 1))
    width = 2.0 * (quantile(0.75) - quantile(0.25)) / F.cbrt(F.col("size").cast("double"))
    bars = F.coalesce(F.ceil(F.round(F.try_divide(F.col("high") - F.col("low"), width), 9)), F.lit(1))
    rows = rows.withColumn("n_bars", F.least(F.lit(high), F.greatest(F.lit(low), bars)).cast("int"))
    # a constant null spans a unit, as histograms do
    flat = F.col("high") == F.col("low")
    rows = rows.withColumn("left0", F.when(flat, F.col("low") - 0.5).otherwise(F.col("low"))).withColumn("step", F.when(flat, 1.0 / F.col("n_bars")).otherwise((F.col("high") - F.col("low")) / F.col("n_bars")))
    one = rows.select("node_id", "bin", "n_bars", "left0", "step", F.explode("null_scores").alias("x"))
    bar = F.least(F.col("n_bars") - 1, F.floor(F.round((F.col("x") - F.col("left0")) / F.col("step"), 9))).cast("int")
    counts = one.groupBy("node_id", "bin", "n_bars", "left0", "step", bar.alias("bar")).agg(F.count("*").alias("n"))
    left = F.col("left0") + F.col("bar") * F.col("step")
    return counts.select("node_id", "bin", "n_bars", "bar", F.round(left, 6).alias("left"), F.round(left + F.col("step"), 6).alias("right"), "n")


def null_markers(tests: DataFrame) -> DataFrame:
    """(node_id, bin, marker, at): where the observed score and the null's 95th percentile stand on a histogram."""
    marks = F.array(F.struct(F.lit("observed").alias("marker"), F.col("bin_score").alias("at")), F.struct(F.lit("p95").alias("marker"), F.col("null_p95").alias("at")))
    return tests.select("node_id", "bin", F.explode(marks).alias("x")).select("node_id", "bin", "x.marker", "x.at")


def unplotted(selected: DataFrame, histogram: DataFrame) -> DataFrame:
    """Selected bins that have no null histogram."""
    return selected.select("node_id", "bin").join(histogram.select("node_id", "bin").distinct(), ["node_id", "bin"], "left_anti")


def selection_summary(selected: DataFrame) -> DataFrame:
    """One row: how many bins are selected, and of how many nodes."""
    return selected.agg(F.count("*").alias("n_bins"), F.count_distinct("node_id").alias("n_nodes"))


def selected_tests(tests: DataFrame, selected: DataFrame) -> DataFrame:
    """The tests of the selected bins."""
    return tests.join(selected.select("node_id", "bin"), ["node_id", "bin"], "left_semi")


def status_by_family(nodes: list[Node], surface: DataFrame, tests: DataFrame, sheets: DataFrame | None = None, selected: DataFrame | None = None) -> DataFrame:
    """(family, nodes, measured, tested, cleared) with a TOTAL row, by one rollup; with sheets and selected where they are given."""
    spark = surface.sparkSession
    declared = spark.createDataFrame([(n.id, n.family) for n in nodes], "node_id string, family string")
    measured = surface.where("rep_id = 0").select("node_id").distinct().withColumn("m", F.lit(1))
    tested = tests.groupBy("node_id").agg(F.count("*").alias("t"), F.count_if("cleared").alias("c"))
    rows = declared.join(measured, "node_id", "left").join(tested, "node_id", "left")
    nought = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    counts = [F.count("*").alias("nodes"), nought("m").alias("measured"), nought("t").alias("tested"), nought("c").alias("cleared")]
    if sheets is not None:
        rows = rows.join(sheets.select("node_id").distinct().withColumn("s", F.lit(1)), "node_id", "left")
        counts.append(nought("s").alias("sheets"))
    if selected is not None:
        rows = rows.join(selected.groupBy("node_id").agg(F.count("*").alias("x")), "node_id", "left")
        counts.append(nought("x").alias("selected"))
    return rows.rollup("family").agg(*counts).withColumn("family", F.coalesce("family", F.lit("TOTAL")))


def node_status(shifts: DataFrame, best: DataFrame, node_id: str, min_dev: float, horizons: tuple[int, ...]) -> DataFrame:
    """Rows of the node's strongest bin that deviate by min_dev at a shown horizon, highest barrier first."""
    shown = [h for h in SHOWN_HORIZONS if h in horizons]
    own = best.where(F.col("node_id") == node_id).select("node_id", "bin")
    rows = shifts.where((F.col("node_id") == node_id) & F.col("horizon").isin(shown)).join(own, ["node_id", "bin"], "left_semi")
    wide = pivoted(rows, "shift", tuple(shown), 9)
    largest = F.greatest(*[F.abs(f"h{h}") for h in shown]) if len(shown) > 1 else F.abs(f"h{shown[0]}")
    return wide.where(largest >= min_dev).orderBy(F.desc("barrier"))
