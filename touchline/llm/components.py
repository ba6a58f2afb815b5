"""Connected components of an edge list, by contraction in a DataFrame loop."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node joined to it by the links (u, v)."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        if (a == b).all():
            return label
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))  # roots are hooked to smaller roots
        while ((low := label[label]) != label).any():
            label = low


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as stars: an edge from every node to the smallest one that these edges join to it, and back."""
    got = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
    if got:
        u, v = (np.concatenate(x) for x in zip(*got))
        nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = nodes[forest(place[: len(u)], place[len(u) :], len(nodes))]
        child = np.flatnonzero(root != nodes)
        a, b = nodes[child], root[child]
        yield pa.record_batch([pa.array(np.concatenate([a, b])), pa.array(np.concatenate([b, a]))], names=["u", "v"])


def component_labels(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (columns u, v: long, no nulls); label: the smallest node reachable.

    Every task first turns its edges into stars.  Then each round gives every node the one of its
    neighbours and itself that comes first in an order, leads edges over to these, and makes stars again.
    In two rounds of three the order is that of the numbers, which ends stars at once; in every
    third it is drawn anew by hashing (randomised contraction): whatever the graph, a node then comes
    first among its neighbours with a chance of at most one half, so nodes fall by a
    constant factor, and the rounds grow with the logarithm of the largest component, not with
    its longest chain.  The loop ends when no edge is left.  The rounds' tables, which shrink
    geometrically, are then read back from the last to the first.  Each carries the smallest node below
    a representative, so no further pass is needed for it.  Firsts and minima are
    pre-aggregated; joins have one row per key on one side, so where a hub's edges fill a partition
the adaptive plan splits it (spark.sql.adaptive.skewJoin, on by default).
    """

    def as_stars(df: DataFrame) -> DataFrame:
        return materialise(df.mapInArrow(_stars, "u long, v long"), "edges")

    live = as_stars(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")))
    low = live.select(F.col("u").alias("node"), F.col("u").alias("low")).distinct()  # the smallest node below each
    steps: list[DataFrame] = []
    while not live.isEmpty():
        k = len(steps)
        order = lambda c: F.struct((F.xxhash64(c, F.lit(k)) if k % 3 == 2 else F.col(c)).alias("h"), F.col(c).alias("x"))  # noqa: B023, E731
        first = live.groupBy("u").agg(F.min(order("v")).alias("v"))
        to = first.select(F.col("u").alias("node"), F.least(order("u"), F.col("v"))["x"].alias("to"))
        step = materialise(to.join(low, "node").select("node", "to", "low"), "step")
        steps.append(step)
        low = step.groupBy(F.col("to").alias("node")).agg(F.min("low").alias("low"))
        a, b = (step.select(F.col("node").alias(end), F.col("to").alias(f"{end}2")) for end in ("u", "v"))
        led = live.join(a, "u").join(b, "v").select(F.col("u2").alias("u"), F.col("v2").alias("v")).where("u < v")
        live = as_stars(led)
    label: DataFrame | None = None
    for step in reversed(steps):
        # a representative that went on to another round has its label there; others are a whole component's
        own = step.groupBy("to").agg(F.min("low").alias("own"))
        if label is None:
            own = own.withColumnRenamed("own", "label")
        else:
            own = own.join(label.select(F.col("node").alias("to"), "label"), "to", "left").select("to", F.coalesce("label", "own").alias("label"))
        label = step.join(own, "to").select("node", "label")
    return low.select("node", F.col("low").alias("label")) if label is None else materialise(label, "labels")
