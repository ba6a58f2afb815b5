"""Whitening of embeddings by TSQR: the covariance is never formed.

Entries become whole numbers x = floor(SCALE c) + SHIFT.  ``fit_whitening`` then works in three steps:

1. exact sums of x by dimension, and the number of vectors n;
2. each partition centres its rows with the exact sums, (n x - S) / n, and reduces them slice by slice to
   one triangular R (QR of the R so far above the next slice); R factors are merged in a
   tree of fan-in FAN, each level a grouped task over FAN small matrices;
3. the singular values s and right vectors of the last R, d x d, give the eigenvalues s^2 / n and eigenvectors of the
   covariance to double precision, since its condition number is not squared.

The driver gets one d x d matrix, whatever the number of rows; d is the dimension of a vector.
``whiten`` maps rows to components; ``identity_error`` measures what it gives, by means and centred products of
partitions that are merged in the same kind of tree.

Defined cases: rows whose vector is null or holds a null or non-finite entry are dropped, and so are rows of
another length than most have (ties: the longer), empty vectors among them; repeated rows and null ids count
each; entries beyond 9e18 / SCALE are taken as that; components without variance (singular value at
rounding level) are left out, so one vector alone, or equal ones, have none; a squared deviation that no long
holds is NULL; an empty table gives an empty table; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import materialise, read_columns

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
FAN = 16  # matrices that one task of the tree merges
SLICE = 4096  # rows reduced at once
LONG = 2**63 - 1
PART = "part long, data binary"


@dataclass(frozen=True)
class Whitening:
    """Exact sums, and the kept components: eigenvalues (falling) and eigenvectors (columns) of the covariance."""

    n: int
    sums: tuple[int, ...]
    eigenvalues: np.ndarray
    vectors: np.ndarray
    trace: float


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, x): the vectors of the common length without null or non-finite entries, as whole numbers."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("c")).where(F.col("c").isNotNull() & (F.size("c") > 0) & ~F.exists("c", bad))
    length = rows.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    whole = lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(9e18)), F.lit(-9e18))).cast("long") + SHIFT
    return rows.where(F.size("c") == (length.d if length else 0)).select("id", F.transform("c", whole).alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and x of slices of rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            yield part.column("id"), part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def scaled_deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n x - S, exactly: longs where they hold it, Python's whole numbers else."""
    bound = n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, sums))
    if bound <= LONG:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def squared_length(dev: np.ndarray) -> list[int | None]:
    """The sum of squares of each row, exactly; None where no long holds it."""
    if dev.dtype != object and dev.shape[1] * max(abs(int(dev.max(initial=0))), abs(int(dev.min(initial=0)))) ** 2 <= LONG:
        return (dev * dev).sum(1).tolist()
    return [s if s <= LONG else None for s in (sum(int(v) * int(v) for v in row) for row in dev)]


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    return scaled_deviations(x, n, sums).astype(np.float64) / n


def _triangle(above: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows if above is None else np.vstack([above, rows]), mode="r")


def _part(data: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([data.astype("<f8").tobytes()], pa.binary())], names=["part", "data"])


def tree_merge(parts: DataFrame, merge: Callable[[list[bytes]], bytes]) -> bytes | None:
    """Merges the rows of (part, data) in groups of FAN, level by level; None if there are none.  Parts are numbered from 0."""

    def level(group: pa.Table) -> pa.Table:
        group = group.sort_by("part")
        return pa.table([pa.array([group.column("part")[0].as_py() // FAN], pa.int64()), pa.array([merge(group.column("data").to_pylist())], pa.binary())], names=["part", "data"])

    parts = materialise(parts, "factors")
    last = parts.agg(F.max("part")).first()[0]
    while last:
        parts = parts.groupBy(F.floor(F.col("part") / FAN).alias("up")).applyInArrow(level, PART)
        last //= FAN
    row = parts.first()
    return None if row is None else bytes(row.data)


def fit_whitening(x: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all rows of ``usable``; None if there are none."""
    each = x.select(F.posexplode("x").alias("k", "v")).groupBy("k")
    found = each.agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s"), F.count("*").alias("n")).collect()  # a row for each dimension
    if not found:
        return None
    n, sums, d = found[0].n, tuple(int(r.s) for r in sorted(found, key=lambda r: r.k)), len(found)

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for _, own in _matrices(batches):
            r = _triangle(r, _centred(own, n, sums))
        if r is not None:
            yield _part(r)

    matrix = lambda data: np.frombuffer(data, "<f8").reshape(-1, d)
    merged = tree_merge(x.mapInArrow(reduced, PART), lambda data: _triangle(None, np.vstack([matrix(m) for m in data])).astype("<f8").tobytes())
    _, s, vt = np.linalg.svd(matrix(merged), full_matrices=False)
    kept = min(components, int((s > s.max(initial=0) * max(n, d) * np.finfo(float).eps).sum()))
    vt = vt * np.where(vt[np.arange(len(vt)), np.abs(vt).argmax(1)] < 0, -1.0, 1.0)[:, None]
    return Whitening(n, sums, s[:kept] ** 2 / n, vt[:kept].T.copy(), float((s**2).sum() / n))


def whitened(x: np.ndarray, model: Whitening) -> np.ndarray:
    return _centred(x, model.n, model.sums) @ model.vectors / np.sqrt(model.eigenvalues)


def _joined(a: tuple[float, np.ndarray, np.ndarray], b: tuple[float, np.ndarray, np.ndarray]) -> tuple[float, np.ndarray, np.ndarray]:
    """Number, mean and centred products of two sets of rows together."""
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def identity_error(x: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the covariance of all whitened rows less the identity; 0 without components."""
    k = len(model.eigenvalues)
    if not k:
        return 0.0

    def moments(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        mean = w.mean(0)
        return float(len(w)), mean, (w - mean).T @ (w - mean)

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, own in _matrices(batches):
            one = moments(whitened(own, model))
            total = one if total is None else _joined(total, one)
        if total is not None:
            yield _part(np.concatenate([[total[0]], total[1], total[2].ravel()]))

    def read(data: bytes) -> tuple[float, np.ndarray, np.ndarray]:
        a = np.frombuffer(data, "<f8")
        return float(a[0]), a[1 : 1 + k], a[1 + k :].reshape(k, k)

    def merge(data: list[bytes]) -> bytes:
        total = read(data[0])
        for m in data[1:]:
            total = _joined(total, read(m))
        return np.concatenate([[total[0]], total[1], total[2].ravel()]).astype("<f8").tobytes()

    n, _, products = read(tree_merge(x.mapInArrow(reduced, PART), merge))
    return float(np.abs(products / n - np.eye(k)).max())


def whiten(x: DataFrame, model: Whitening) -> DataFrame:
    """(id, deviation, whitened): a row for each row of ``usable``, its whitened components in an array."""
    kind = x.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, own in _matrices(batches):
            w = whitened(own, model)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, max(1, w.shape[1]), dtype=np.int32)[: len(w) + 1]), pa.array(w.ravel()))
            yield pa.record_batch([ids, pa.array(squared_length(scaled_deviations(own, model.n, model.sums)), pa.int64()), lists], names=["id", "deviation", "whitened"])

    return x.mapInArrow(run, f"id {kind}, deviation long, whitened array<double>")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector's first components, whitened, with the model's figures beside."""
    x = usable(read_columns(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    model = fit_whitening(x)
    if model is None or not len(model.eigenvalues):
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues])
    rows = whiten(x, model).select("id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return rows.select(
        F.col("id").alias("vec_id"), (F.col("k") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("k")).alias("explained"), F.lit(identity_error(x, model)).alias("identity_error"),
    )
