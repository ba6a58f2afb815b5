"""A kept null ensemble: simulated paths, their excursions and their scores, added to block by block.

Replicates are numbered from 1 and drawn by counters, so those of a history are the same whoever asks for them
and however many are asked for.  They are kept in blocks of BLOCK_REPS: paths by (history, seed, block), excursions by
(history, seed, horizons, block), scores by (history, seed, test, block), where a test is a feature with its
parameters, grid and bins (and, for features that are not recomputed, its observed values).  What is asked for
again is read; more replicates, further nodes or other grids compute only what lacks.  A note is written
after each block, so a run that ends half-way repeats the blocks that have none, and replaces them.

Histories are told apart by the content of their bars, not by the ids that panels give them.  Several of them, each with
nodes of its own, go through one run.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections import defaultdict
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SEED, Grid, Node
from ..functions.features import FeatureRegistry
from ..store import METHOD, VERSION, Store, content_digest, history_id
from .inference import all_features, block_scores
from .null_model import log_components, null_fit, null_paths
from .surface import excursions_wide

BLOCK_REPS = 20
OBSERVED = -1  # the block of the observed path
STEPS = 5  # in which what lacks is computed, each a mark of progress
PANEL = ("history_id", "rep_id", "bar_idx", "ts", "open", "high", "low", "close", "volume")
Unit = tuple[str, int]  # a history and a block


def _digest(*parts: object) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:32]


class Ensemble:
    """The ensemble of one seed in a store."""

    def __init__(self, store: Store, seed: int = SEED):
        self.store, self.seed, self.spark = store, seed, store.spark

    def _key(self, what: str, unit: Unit, *key: str) -> str:
        return _digest(VERSION, METHOD, self.seed, what, *unit, *key)

    def _kept_keys(self) -> set[str]:
        """What has been noted: a file for each step of work."""
        names = [n for n in self.store.files.names("ensemble/done") if n.endswith(".json")]  # others are being written
        return {k for n in names for k in json.loads(self.store.files.read(f"ensemble/done/{n}") or "[]")}

    def _lacking(self, what: str, units: list[Unit], *key: str, have: set[str] | None = None) -> list[Unit]:
        have = self._kept_keys() if have is None else have
        return [u for u in units if self._key(what, u, *key) not in have]

    def _note(self, what: str, units: list[Unit], *keys: str) -> None:
        """Notes that ``units`` are done, for each of ``keys`` if there are any."""
        done = [self._key(what, u, *key) for u in units for key in ([(k,) for k in keys] or [()])]
        self.store.files.write(f"ensemble/done/{uuid.uuid4().hex}.json", json.dumps(done))

    def _units(self, units: list[Unit]) -> DataFrame:
        """(history_id, block): as many rows as blocks."""
        return self.spark.createDataFrame(units, "history_id string, block int")

    def _kept(self, name: str, units: list[Unit], **also: list[str]) -> DataFrame:
        """Rows of some blocks, of the given grids or tests."""
        rows = self.store.read("ensemble", name).where(F.col("seed") == self.seed)
        for column, values in also.items():
            rows = rows.where(F.col(column).isin(values))
        rows = rows.where(F.col("block").isin(sorted({b for _, b in units})) & F.col("history_id").isin(sorted({h for h, _ in units})))  # only these folders are read
        return rows.join(self._units(units), ["history_id", "block"], "left_semi").drop("seed", "block")

    def _add(self, name: str, rows: DataFrame, *by: str) -> None:
        block = F.when(F.col("rep_id") == 0, F.lit(OBSERVED)).otherwise(F.expr(f"(rep_id - 1) div {BLOCK_REPS}").cast("int"))
        self.store.add("ensemble", name, rows.withColumn("seed", F.lit(self.seed).cast("long")).withColumn("block", block), ("history_id", "seed", *by, "block"))

    def _simulate(self, observed: DataFrame, units: list[Unit]) -> None:
        lacking = self._lacking("paths", [u for u in units if u[1] != OBSERVED])
        if lacking:
            first = F.col("block") * BLOCK_REPS + 1
            wanted = self._units(lacking).select("history_id", F.explode(F.sequence(first, first + BLOCK_REPS - 1)).alias("rep_id"))
            self._add("paths", null_paths(observed, null_fit(log_components(observed)), wanted, self.seed))
            self._note("paths", lacking)

    def paths(self, observed: DataFrame, n_replicates: int) -> DataFrame:
        """Panels of replicates 1 .. n_replicates of an observed history."""
        (given,) = histories(observed)
        key, bars = by_content(observed)
        units = [(key, b) for b in range(blocks(n_replicates))]
        self._simulate(bars, units)
        return self._kept("paths", units).where(F.col("rep_id") <= n_replicates).withColumn("history_id", F.lit(given)).select(*PANEL)

    def _measure(self, observed: DataFrame, units: list[Unit], horizons: tuple[int, ...]) -> None:
        key = "-".join(map(str, sorted(set(horizons))))
        grid = _digest(key)
        lacking = self._lacking("excursions", units, key)
        parts = []
        if any(b == OBSERVED for _, b in lacking):
            parts.append(observed.where(F.col("history_id").isin([h for h, b in lacking if b == OBSERVED])).select(*PANEL))
        if simulated := [u for u in lacking if u[1] != OBSERVED]:
            parts.append(self._kept("paths", simulated).select(*PANEL))
        if parts:
            rows = excursions_wide(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), horizons)
            self._add("excursions", rows.withColumn("grid", F.lit(grid)), "grid")
            self._note("excursions", lacking, key)

    def tests(self, observed: DataFrame, nodes: list[Node], registry: FeatureRegistry, grid: Grid, n_bins: int) -> dict[str, str]:
        """The key of each node's test; features that are not recomputed go by their observed values, too."""
        out = {}
        for n in nodes:
            d = registry.get(n.feature)
            values = "" if d.core else content_digest(all_features(observed, None, [n], registry).select("bar_idx", "value"))
            out[n.id] = _digest(n.feature, n.params, d.version, asdict(grid), n_bins, values)
        return out

    def scores(
        self, groups: list[tuple[DataFrame, list[Node]]], registry: FeatureRegistry, grid: Grid, n_bins: int, n_replicates: int, step: Callable[[int, int], None] = lambda done, total: None
    ) -> DataFrame:
        """(history_id, rep_id, node_id, bin, score, supported) of the observed path (0) and replicates 1 .. n_replicates.

        ``groups``: observed panels of one history each, with the nodes that are tested on it; histories of equal bars
        share their ensemble.  ``step`` hears how many of the blocks that lacked are done.
        """
        every = [OBSERVED, *range(blocks(n_replicates))]
        names, lacking, base, have = [], defaultdict(list), {}, self._kept_keys()
        panels = []
        for k, (panel, nodes) in enumerate(groups):
            (given,) = histories(panel)
            history, panel = by_content(panel)
            panels.append(panel)
            base.setdefault(history, panel.select(*PANEL))
            test_of = self.tests(panel, nodes, registry, grid, n_bins)
            names += [(history, test_of[n.id], n.id, given) for n in nodes]
            for n in nodes:
                for u in self._lacking("scores", [(history, b) for b in every], test_of[n.id], have=have):
                    lacking[u, k].append((n, test_of[n.id]))
        # blocks of one group of nodes that lack the same tests are one step of work
        alike = defaultdict(list)
        for (unit, k), own in lacking.items():
            alike[k, tuple(t for _, t in own)].append((unit, own))
        total, done = sum(len(x) for x in alike.values()), 0
        for (k, _), work in alike.items():
            size = -(-len(work) // STEPS)
            for at in range(0, len(work), size):
                units, own = [u for u, _ in work[at : at + size]], work[at][1]
                self._score(panels[k], base[units[0][0]], units, own, registry, grid, n_bins)
                done += len(units)
                step(done, total)
        wanted = self.spark.createDataFrame(sorted(set(names)), "history_id string, test string, node_id string, given string")
        units = sorted({(h, b) for h, *_ in names for b in every})
        rows = self._kept("scores", units, test=sorted({t for _, t, *_ in names})).where(F.col("rep_id") <= n_replicates)
        return rows.join(wanted, ["history_id", "test"]).select(F.col("given").alias("history_id"), "rep_id", "node_id", "bin", "score", "supported")

    def _score(self, panel: DataFrame, bars: DataFrame, units: list[Unit], own: list[tuple[Node, str]], registry: FeatureRegistry, grid: Grid, n_bins: int) -> None:
        """Scores of some nodes on some blocks of one history, from paths and excursions that are kept or made now."""
        self._simulate(bars, units)
        self._measure(bars, units, grid.horizons)
        simulated = [u for u in units if u[1] != OBSERVED]
        paths = self._kept("paths", simulated).select(*PANEL) if simulated else None
        exc = self._kept("excursions", units, grid=[_digest("-".join(map(str, sorted(set(grid.horizons)))))]).drop("grid")
        of = self.spark.createDataFrame(sorted({(n.id, t) for n, t in own}), "node_id string, test string")
        found = block_scores(panel, paths, [n for n, _ in own], registry, grid, n_bins, exc)
        rows = found.join(of, "node_id").dropDuplicates(["history_id", "rep_id", "test", "bin"]).drop("node_id")
        self._add("scores", rows.select("history_id", "rep_id", "test", "bin", "score", "supported"), "test")
        self._note("scores", units, *sorted({t for _, t in own}))


def blocks(n_replicates: int) -> int:
    return -(-n_replicates // BLOCK_REPS)


def by_content(panel: DataFrame) -> tuple[str, DataFrame]:
    """A panel's history by the content of its bars, and the panel under that id."""
    key = history_id(panel)
    return key, panel.withColumn("history_id", F.lit(key))


def histories(panel: DataFrame) -> list[str]:
    """The ids of a panel's histories; they are few."""
    return sorted(r.history_id for r in panel.select("history_id").distinct().collect())
