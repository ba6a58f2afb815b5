"""The four stages of a study: measure, compare, validate, select; and its status.

A study has one panel, or one for each set of sources that its nodes name.  Panels of equal prices and times are one
history, whatever else they hold; each node belongs to the history of its panel.

The first stage keeps what the others need: the panels (history), feature values and observed surfaces laid out by
node, and observed excursions, so later stages run from the store alone.  Each node has a fingerprint of its
own: a changed one alone is measured again, one that is no longer declared is removed, and one that fails, while its
plan is built or while it runs, costs only itself.  Every stage names its inputs by content in a manifest:
settings, nodes, histories and the tables that it read.  A later stage refuses to run on tables of other settings
or other histories than the present ones.
"""

from __future__ import annotations

import hashlib
import json
import logging
import math
import time
from collections.abc import Callable
from dataclasses import asdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import N_REPLICATES, SEED, Node, Workspace
from .functions.features import FeatureRegistry, default_registry, kept_features, node_batches
from .operators.cleaning import check_panel
from .operators.ensemble import Ensemble, histories
from .operators.inference import missing_nodes, monte_carlo, selection
from .operators.reporting import bin_table, heatmap, node_status, null_histogram, null_markers, pivoted, selected_tests, selection_summary, status_by_family, unplotted
from .operators.scoring import economic_filter, shift_surface, strongest
from .operators.surface import baseline_rates, excursions_wide, measure, node_coverage, on_history, quantile_edges
from .sources.readers import load_panel
from .store import STAGES, VERSION, Store, config_digest, content_digest, history_id

log = logging.getLogger("touchline")
BARS = ("history_id", "rep_id", "bar_idx", "ts", "open", "high", "low", "close", "volume")
KEYS = ("history_id", "rep_id", "node_id", "bin", "horizon", "barrier_idx")
Loader = Callable[[SparkSession, tuple[str, ...]], DataFrame]


class Progress:
    """Logs five marks of ``total`` pieces of work as they are finished, and how long a stage took."""

    def __init__(self, stage: str, total: int = 0, parts: int = 5):
        self.stage, self.total, self.done, self.began = stage, total, 0, time.time()
        self.marks = [math.ceil(total * k / parts) for k in range(1, parts + 1)] if total else []

    def step(self, n: int = 1) -> None:
        self.reach(self.done + n)

    def reach(self, done: int, total: int | None = None) -> None:
        """``done`` pieces are finished; marks that are passed at once are logged once."""
        if total is not None and total != self.total:
            self.__init__(self.stage, total)
        passed = [m for m in self.marks if self.done < m <= done]
        self.done = done
        if passed:
            log.info("%s: %d of %d (%d %%)", self.stage, done, self.total, 100 * done // self.total)

    def finish(self) -> None:
        log.info("%s completed in %.1f s", self.stage, time.time() - self.began)


class Study:
    """Runs the stages of one workspace and keeps their tables in a store."""

    def __init__(self, workspace: Workspace, panel: DataFrame, store: Store, registry: FeatureRegistry | None = None):
        self._set(workspace, {"": panel}, store, registry)

    def _set(self, workspace: Workspace, panels: dict[str, DataFrame], store: Store, registry: FeatureRegistry | None, require_volume: bool = True) -> None:
        """``panels``: by set of sources; "" holds for nodes whose own set has none."""
        self.workspace, self.store, self.registry = workspace, store, registry or default_registry()
        self.panels = {k: check_panel(p, tuple(c for c in p.columns if c not in BARS), require_volume) for k, p in panels.items()}
        self.history_of = {k: histories(p) for k, p in self.panels.items()}
        if any(len(h) != 1 for h in self.history_of.values()):
            raise ValueError("a panel has one history")
        first = {h[0]: k for k, h in reversed(self.history_of.items())}
        self.panel = self.panels[next(iter(self.panels))] if len(self.panels) == 1 else reduce(DataFrame.unionByName, [self.panels[k].select(*BARS) for _, k in sorted(first.items())])

    @classmethod
    def of_sources(cls, workspace: Workspace, load: Loader, store: Store, registry: FeatureRegistry | None = None) -> Study:
        """A study whose nodes' panels come from a loader, one for each distinct set of sources."""
        panels = {}
        for sources in sorted({n.data for n in workspace.nodes()}):
            panel = load_panel(load, store.spark, sources)
            panels["+".join(sources)] = panel.withColumn("history_id", F.lit(history_id(panel)))
        out = object.__new__(cls)
        out._set(workspace, panels, store, registry)
        return out

    @classmethod
    def restored(cls, workspace: Workspace, store: Store, registry: FeatureRegistry | None = None) -> Study:
        """A study over the panels that its first stage kept; volume may be lacking there."""
        if not store.has(STAGES[0], "history"):
            raise RuntimeError("no history is kept: run measure")
        names = store.kept_names(STAGES[0])
        panels = {"": store.read(STAGES[0], "history")} | {k: store.read(STAGES[0], f"history-{k}") for k in names}
        if names:
            del panels[""]
        out = object.__new__(cls)
        out._set(workspace, panels, store, registry, require_volume=False)
        return out

    def _panel_of(self, node: Node) -> str:
        own = "+".join(node.data)
        return own if own in self.panels else ""

    def nodes_by_panel(self, nodes: list[Node] | None = None) -> dict[str, list[Node]]:
        out: dict[str, list[Node]] = {}
        for n in self.workspace.nodes() if nodes is None else nodes:
            out.setdefault(self._panel_of(n), []).append(n)
        return out

    def _timed(self, stage: str, work: Callable[[], DataFrame]) -> DataFrame:
        progress = Progress(stage)
        out = work()
        progress.finish()
        return out

    def _inputs(self) -> dict:
        return {"config": config_digest(self.workspace), "panel": self._panel_digest()}

    def _panel_digest(self) -> str:
        return "+".join(content_digest(p) for _, p in sorted(self.panels.items()))

    def _cache_key(self) -> dict:
        return {"version": VERSION, "history": "+".join(history_id(p) for _, p in sorted(self.panels.items())), "horizons": sorted(set(self.workspace.config.grid.horizons))}

    def observed_excursions(self) -> DataFrame:
        """The observed paths' excursions: the kept ones if they are of these histories, grid and version, else made and kept."""
        key = self._cache_key()
        if self.store.manifest("cache").get("inputs") != key or not self.store.has("cache", "excursions"):
            self.store.write("cache", "excursions", excursions_wide(self.panel, tuple(key["horizons"])))
            self.store.write_manifest("cache", key)
        return self.store.read("cache", "excursions")

    def features(self) -> DataFrame:
        """The kept feature values, one row per node and bar of its history; NULL where a bar has none."""
        self._need(STAGES[0], self._inputs(), "measure")
        values = self.store.read(STAGES[0], "features")
        of = values.select("history_id", "node_id").distinct().collect()  # nodes are declared one by one
        parts = []
        for history in sorted({r.history_id for r in of}):
            names = sorted(r.node_id for r in of if r.history_id == history)
            parts.append(on_history(self.panel.where(F.col("history_id") == history), values, names))
        return reduce(DataFrame.unionByName, parts)

    # ---- measure -----------------------------------------------------------------------------

    def fingerprint(self, node: Node, panel_digest: str) -> str:
        """What a node's measurement depends on."""
        c = self.workspace.config
        d = self.registry.get(node.feature)
        plain = [asdict(node), d.version, d.core, asdict(c.grid), c.n_bins, c.min_obs, panel_digest, VERSION]
        return hashlib.sha256(json.dumps(plain, sort_keys=True, default=str).encode()).hexdigest()

    def _measure_some(self, nodes: list[Node], exc: DataFrame, baseline: DataFrame) -> dict[str, str]:
        """Measures nodes of one panel into the store; returns why some of them have no measurement."""
        panel, c = self.panels[self._panel_of(nodes[0])], self.workspace.config
        values = kept_features(panel, nodes, self.registry)
        few = {r.node_id: f"only {r.n_valid} values" for r in node_coverage(values, c.min_obs).collect() if not r.enough}
        good = [n for n in nodes if n.id not in few]
        if good:
            values = values.where(F.col("node_id").isin([n.id for n in good]))
            edges = quantile_edges(values, c.n_bins)
            surface, _ = measure(panel, good, self.registry, c.grid, c.n_bins, features=values, edges=edges, excursions=exc, baseline=baseline)
            self.store.add(STAGES[0], "features", values, ("node_id",))
            self.store.add(STAGES[0], "edges", edges, ("node_id",))
            self.store.add(STAGES[0], "surface", surface, ("node_id",))
        return few

    def _measure_or_say_why(self, nodes: list[Node], exc: DataFrame, baseline: DataFrame) -> dict[str, str]:
        """As _measure_some; where it fails, each node is tried alone, so that one that fails costs only itself."""
        try:
            return self._measure_some(nodes, exc, baseline)
        except Exception as e:  # noqa: BLE001  a plugin may raise anything, on the driver or in a task
            if len(nodes) == 1:
                return {nodes[0].id: str(e).strip().splitlines()[0][:300] if str(e).strip() else type(e).__name__}
        return {k: v for n in nodes for k, v in self._measure_or_say_why([n], exc, baseline).items()}

    def measure(self) -> DataFrame:
        """Surfaces of all nodes; only nodes whose fingerprint differs from the kept one are measured."""

        def work() -> DataFrame:
            c, inputs, declared = self.workspace.config, self._inputs(), list(self.workspace.nodes())
            before = self.store.manifest(STAGES[0])
            same_panel = before.get("inputs", {}).get("panel") == inputs["panel"]
            if not same_panel:  # a restored study reads what it would write
                self._keep_history()
            exc = self.observed_excursions()
            baseline = self.store.write(STAGES[0], "baseline", baseline_rates(exc, c.grid))
            digests = {k: content_digest(p) for k, p in self.panels.items()}
            prints, bad = {}, {}
            for n in declared:
                try:
                    prints[n.id] = self.fingerprint(n, digests[self._panel_of(n)])
                except (ValueError, KeyError) as e:
                    bad[n.id] = str(e)
            kept = {k: v for k, v in before.get("nodes", {}).items() if prints.get(k) == v and same_panel and self.store.has(STAGES[0], "surface")}
            for name in ("features", "edges", "surface"):
                for gone in set(before.get("nodes", {})) - set(kept):
                    self.store.remove_part(STAGES[0], name, "node_id", gone)
            progress = Progress("measuring nodes", len(declared))
            progress.reach(len(kept) + len(bad))
            for nodes in self.nodes_by_panel([n for n in declared if n.id in prints and n.id not in kept]).values():
                for batch in node_batches(nodes, self.registry):
                    why = self._batch(batch, exc, baseline)
                    bad |= why
                    kept |= {n.id: prints[n.id] for n in batch if n.id not in why}
                    # what is done is noted at once: a stage that is cut off goes on from here
                    self.store.write_manifest(STAGES[0], {"panel": inputs["panel"]}, nodes=kept)
                    progress.step(len(batch))
            for node_id, why in bad.items():
                log.warning("node %s is left out: %s", node_id, why)
            if not kept:
                raise ValueError("no node can be measured")
            out = self.store.read(STAGES[0], "surface")
            self.store.write(STAGES[0], "bins", bin_table(self.store.read(STAGES[0], "edges"), declared))
            self.store.write(STAGES[0], "sheet", pivoted(out, "p", c.grid.horizons))
            self.store.write(STAGES[0], "sheet_counts", pivoted(out.withColumn("n", F.col("n_obs").cast("double")), "n", c.grid.horizons))
            for r in missing_nodes(declared, out).collect():
                if r.node_id not in bad:
                    log.warning("node %s is not measured", r.node_id)
            self.store.write_manifest(STAGES[0], inputs, nodes=kept, left_out=bad)
            return out

        return self._timed("measure", work)

    def _batch(self, batch: list[Node], exc: DataFrame, baseline: DataFrame) -> dict[str, str]:
        """One batch as a job group of its own, so that its jobs are told apart while they run."""
        context = self.store.spark.sparkContext
        context.setLocalProperty("spark.job.description", f"measuring {', '.join(n.id for n in batch)}"[:200])
        try:
            return self._measure_or_say_why(batch, exc, baseline)
        finally:
            context.setLocalProperty("spark.job.description", None)

    def _keep_history(self) -> None:
        for k, panel in self.panels.items():
            self.store.write(STAGES[0], f"history-{k}" if k else "history", panel)
        if "" not in self.panels:
            self.store.write(STAGES[0], "history", self.panel)

    # ---- compare, validate, select -----------------------------------------------------------

    def compare(self, thin: bool = False) -> DataFrame:
        """Shifts from the baseline; ``thin`` keeps the shift alone, and ``shifts`` joins the rest on again."""

        def work() -> DataFrame:
            self._need(STAGES[0], self._inputs(), "measure")
            c = self.workspace.config
            shifts = shift_surface(self.store.read(STAGES[0], "surface"), self.store.read(STAGES[0], "baseline"))
            self.store.write(STAGES[1], "shift", shifts.select(*KEYS, "shift") if thin else shifts)
            inputs = self._digests(STAGES[0], "surface", "baseline")
            self.store.write_manifest(STAGES[1], inputs)
            out = self.shifts(inputs)
            self.store.write(STAGES[1], "best", economic_filter(out, c.min_dev, c.min_bin_n, c.min_run))
            self.store.write(STAGES[1], "sheet", pivoted(out, "shift", c.grid.horizons))
            return out

        return self._timed("compare", work)

    def shifts(self, sources: dict | None = None) -> DataFrame:
        """The compared surface with all its columns; a thin one is joined with the tables that it came from, if they are still the same."""
        kept = self.store.read(STAGES[1], "shift")
        if "p" in kept.columns:
            return kept
        if self.store.manifest(STAGES[1]).get("inputs") != (sources or self._digests(STAGES[0], "surface", "baseline")):
            raise RuntimeError("the thin surface is of other tables: run compare")
        full = shift_surface(self.store.read(STAGES[0], "surface"), self.store.read(STAGES[0], "baseline"))
        return full.drop("shift").join(kept, list(KEYS))

    def measured_nodes(self) -> list[Node]:
        """Declared nodes that the first stage measured."""
        kept = self.store.manifest(STAGES[0]).get("nodes", {})
        return [n for n in self.workspace.nodes() if n.id in kept]

    def validate(self, n_replicates: int = N_REPLICATES, seed: int = SEED) -> DataFrame:
        """Tests of all bins; simulated paths, excursions and scores that the store has are used again."""

        def work() -> DataFrame:
            self._need(STAGES[0], self._inputs(), "measure")
            self._need(STAGES[1], self._digests(STAGES[0], "surface", "baseline"), "compare")
            c = self.workspace.config
            inputs = {**self._inputs(), **self._digests(STAGES[1], "shift"), "n_replicates": n_replicates, "seed": seed}
            groups = [(self.panels[k], nodes) for k, nodes in self.nodes_by_panel(self.measured_nodes()).items()]
            scores = Ensemble(self.store, seed).scores(groups, self.registry, c.grid, c.n_bins, n_replicates, Progress("validating blocks of replicates").reach)
            out = self.store.write(STAGES[2], "tests", monte_carlo(scores, n_replicates))
            self.store.write(STAGES[2], "null_histogram", null_histogram(out))
            self.store.write(STAGES[2], "null_markers", null_markers(out))
            if self._digests(STAGES[1], "shift")["shift"] != inputs["shift"]:
                raise RuntimeError("the compared surface changed while it was validated")
            self.store.write_manifest(STAGES[2], inputs)
            return out

        return self._timed("validate", work)

    def select(self) -> DataFrame:
        def work() -> DataFrame:
            m = self.store.manifest(STAGES[2]).get("inputs", {})
            now = {**self._inputs(), **self._digests(STAGES[1], "shift")}
            if not m or any(m.get(k) != v for k, v in now.items()):
                raise RuntimeError("validation is missing or stale: run validate")
            before = self._digests(STAGES[2], "tests")
            chosen = selection(self.store.read(STAGES[2], "tests"))
            labels = self.store.read(STAGES[0], "bins").select("node_id", "bin", "feature_label", "bin_label")
            out = self.store.write(STAGES[3], "selected", chosen.join(labels, ["node_id", "bin"], "left"))
            self.store.write(STAGES[3], "heatmap", heatmap(self.shifts(), out, self.workspace.config.grid.horizons))
            histogram = self.store.read(STAGES[2], "null_histogram")
            self.store.write(STAGES[3], "null_histogram", selected_tests(histogram, out))
            for r in unplotted(out, histogram).collect():  # selected bins are few
                log.warning("bin %s of node %s has no null histogram", r.bin, r.node_id)
            if self._digests(STAGES[2], "tests") != before:
                raise RuntimeError("the tests changed while bins were selected")
            self.store.drop_stale(STAGES[3], {"selected", "heatmap", "null_histogram"})
            self.store.write_manifest(STAGES[3], before)
            total = selection_summary(out).first()
            log.info("%d bins of %d nodes are selected", total.n_bins, total.n_nodes)
            return out

        return self._timed("select", work)

    def status(self, node_id: str | None = None) -> DataFrame:
        """Progress by family, or the strongest bin of one node."""
        c = self.workspace.config
        if node_id is not None:
            self.workspace.node(node_id)
            shifts = self.shifts()
            return node_status(shifts, strongest(economic_filter(shifts, c.min_dev, c.min_bin_n, c.min_run)), node_id, c.min_dev, c.grid.horizons)
        surface = self.store.read(STAGES[0], "surface")
        none = surface.sparkSession.createDataFrame([], "node_id string, cleared boolean")
        at = lambda stage, name: self.store.read(stage, name) if self.store.has(stage, name) and self.store.manifest(stage) else none
        return status_by_family(list(self.workspace.nodes()), surface, at(STAGES[2], "tests"), at(STAGES[1], "sheet"), at(STAGES[3], "selected"))

    def _digests(self, stage: str, *names: str) -> dict:
        return {n: content_digest(self.store.read(stage, n)) for n in names}

    def _need(self, stage: str, inputs: dict, command: str) -> None:
        if not self.store.is_current(stage, inputs):
            raise RuntimeError(f"{stage} is missing or stale: run {command}")
