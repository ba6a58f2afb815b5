"""Long paths in chunks, exact selection, kept ensembles, several histories, array features, paged sources, upkeep by node."""

import json
import logging
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.config import Grid, Node, parse_workspace
from touchline.functions import windows
from touchline.functions.features import default_registry, kept_features, long_features, node_batches, wide_features
from touchline.operators import ensemble as kept
from touchline.operators import inference, surface
from touchline.operators.ensemble import Ensemble
from touchline.plans.catalogue import catalogue_nodes
from touchline.plans.queries import FEATURES
from touchline.sources.paged import PagedSource, pages, read_paged
from touchline.sources.readers import pages_frame, read_pages
from touchline.store import Store
from touchline.study import Progress, Study

BARS = "history_id string, rep_id int, bar_idx long, ts timestamp_ntz, open double, high double, low double, close double, volume double"
DAY = datetime(2024, 1, 1)
REGISTRY = default_registry()
GRID = Grid((-0.02, 0.0, 0.02), (1, 3))


def bars(spark, n=160, seed=12, history="h", holes=False, scale=1.0):
    r = np.random.default_rng(seed)
    close = np.round(scale * 100 * np.exp(np.cumsum(r.normal(0, 0.02, n))), 4)
    rows = []
    for k, c in enumerate(close.tolist()):
        row = [c, round(c * 1.01, 4), round(c * 0.99, 4), c, float(k % 5 + 1)]
        if holes and r.random() < 0.1:
            row[int(r.integers(0, 5))] = None
        rows.append((history, 0, k, DAY + timedelta(k), *row))
    return spark.createDataFrame(rows, BARS)


def table(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


# ---- chunks and halos ------------------------------------------------------------------------


def test_features_do_not_depend_on_chunks(spark, monkeypatch):
    panel = bars(spark, 150, holes=True)
    panel = panel.withColumns({c: F.when(F.col("bar_idx") % k != 1, F.col("close") * k) for k, c in ((3, "vix"), (4, "tnx"), (5, "dxy"))})
    panel = panel.withColumns({"mvrv": F.col("vix"), "hash_rate": F.col("dxy"), "adr_act_cnt": F.col("tnx")}).cache()
    nodes = [Node(n, n, {k: min(v, 11) if isinstance(v, int) and v > 20 else v for k, v in p.items()}) for n, p in FEATURES.items()]
    run = lambda: table(long_features(panel, nodes, REGISTRY), "node_id", "bar_idx")
    whole = run()
    monkeypatch.setattr(windows, "CHUNK", 16)
    for a, b in zip(whole, run(), strict=True):
        assert a[:4] == b[:4] and (a[4] is None) == (b[4] is None) and (a[4] is None or abs(a[4] - b[4]) < 2e-9), (a, b)
    assert len(whole) == 150 * len(nodes) and sum(r[4] is not None for r in whole) > 3000


@pytest.mark.parametrize("size", [7, 1024])
def test_exponential_averages_equal_the_recursion(spark, monkeypatch, size):
    monkeypatch.setattr(windows, "CHUNK", size)
    r = np.random.default_rng(4)
    x = [None] * 9 + [None if r.random() < 0.2 else float(v) for v in r.normal(size=200)] + [None] * 8
    rows = [("h", rep, k, v) for rep in (0, 3) for k, v in enumerate(x)] + [("n", 0, k, None) for k in range(20)]
    panel = spark.createDataFrame(rows, "history_id string, rep_id int, bar_idx long, x double")
    spans = {"a": ("x", 1), "b": ("x", 2), "c": ("x", 26), "d": ("x", 5000)}
    got = {(q.history_id, q.rep_id, q.bar_idx): q for q in windows.exponential(panel, spans).collect()}
    assert len(got) == len(rows)
    for name, (_, span) in spans.items():
        y, a = None, 2 / (span + 1)
        for k, v in enumerate(x):
            y = y if v is None else v if y is None else a * v + (1 - a) * y
            for rep in (0, 3):
                assert got["h", rep, k][name] == (None if v is None else pytest.approx(y, rel=1e-12))
    assert all(got["n", 0, k].a is None for k in range(20))


def test_fills_reach_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(windows, "CHUNK", 8)
    x = [None] * 20 + [1.0] + [None] * 30 + [2.0, None, 3.0] + [None] * 11
    panel = spark.createDataFrame([("h", 0, k, v) for k, v in enumerate(x)], "history_id string, rep_id int, bar_idx long, x double")
    last, want = None, []
    for v in x:
        last = last if v is None else v
        want.append(last)
    assert [r.y for r in windows.filled(panel, {"x": "y"}).orderBy("bar_idx").collect()] == want


def test_excursions_do_not_depend_on_chunks(spark, monkeypatch):
    monkeypatch.setattr(windows, "CHUNK", 16)
    panel = bars(spark, 100, holes=True)
    rows = panel.orderBy("bar_idx").collect()
    got = {(r.bar_idx, r.horizon): (r.down, r.up) for r in surface.excursions(panel, (1, 2, 3, 7, 8, 30, 99)).collect()}
    assert len(got) == 700
    for k, row in enumerate(rows):
        for h in (1, 2, 3, 7, 8, 30, 99):
            after = rows[k + 1 : k + 1 + h]
            for which, name, f in ((0, "low", min), (1, "high", max)):
                values = [r[name] for r in after]
                whole = len(values) == h and None not in values and row.close is not None
                assert got[k, h][which] == (pytest.approx(f(values) / row.close - 1, abs=1e-15) if whole else None)


def test_no_task_gets_more_than_a_chunk_and_its_halo(spark, monkeypatch):
    monkeypatch.setattr(windows, "CHUNK", 32)
    panel = bars(spark, 1000)
    sizes = windows.chunked(panel, back=5, ahead=3).groupBy("__chunk").count().collect()
    assert max(r["count"] for r in sizes) == 40 and len(sizes) == 32
    assert windows.own_rows(windows.chunked(panel, back=5, ahead=3)).count() == 1000
    for df in (wide_features(panel, [Node("m", "macd_histogram", {"fast": 12, "slow": 26}), Node("r", "rsi", {"period": 14})], REGISTRY), surface.excursions_wide(panel, (1, 30))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
        own = [line for line in plan.splitlines() if " Window [" in line and "bar_idx" in line.split("windowspecdefinition")[-1]]
        assert own and all("__chunk" in line for line in own)


# ---- exact selection -------------------------------------------------------------------------


@pytest.mark.parametrize("most", [5, 40, 1 << 20])
def test_edges_are_exact_however_segments_are_cut(spark, most, monkeypatch):
    monkeypatch.setattr(surface, "SEGMENT_BINS", 8)
    r = np.random.default_rng(9)
    series = {
        "normal": r.normal(size=400).round(9), "ties": r.integers(0, 4, 400).astype(float), "one": np.full(50, 2.5), "tails": np.append(r.normal(size=300).round(9), [1e300, -1e300, 1e5]),
        "two": np.array([1.0, 2.0]), "single": np.array([7.0]), "mostly": np.append(np.zeros(500), r.normal(size=20).round(9)),
    }
    rows = [("h", rep, name, k, float(v)) for rep in (0, 1) for name, x in series.items() for k, v in enumerate(x)] + [("h", 0, "none", k, None) for k in range(5)]
    df = spark.createDataFrame(rows, "history_id string, rep_id int, node_id string, bar_idx long, value double")
    got = {(q.rep_id, q.node_id): q.edges for q in surface.quantile_edges(df, 7, most).collect()}
    assert set(got) == {(rep, name) for rep in (0, 1) for name in series}
    for (_, name), edges in got.items():
        x = series[name]
        want = [round(float(np.quantile(x, j / 7)), 9) for j in range(1, 7)]
        want = [e for e in dict.fromkeys(want) if x.min() < e <= x.max()]
        assert edges == pytest.approx(want, rel=1e-12, abs=2e-9), name


def test_many_distinct_values_are_narrowed(spark):
    df = spark.range(300_000).select(F.lit("h").alias("history_id"), F.lit(0).alias("rep_id"), F.lit("n").alias("node_id"), F.col("id").alias("bar_idx"), (F.pmod(F.col("id") * 7919, F.lit(300_007)) ** 2 / 3e5).alias("value"))
    want = np.quantile(np.array([r.value for r in df.select("value").collect()]), [j / 10 for j in range(1, 10)])
    assert surface.quantile_edges(df, 10, 2000).first().edges == pytest.approx(want.round(9).tolist(), rel=1e-12)


# ---- ensembles and histories -----------------------------------------------------------------

A, B, WEEKDAY = Node("a", "roc", {"period": 3}), Node("b", "rsi", {"period": 5}), Node("w", "day_of_week")


def scored(df):
    return sorted(tuple(r) for r in df.select("history_id", "rep_id", "node_id", "bin", "score", "supported").collect())


def test_an_ensemble_grows_without_repeating_itself(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(kept, "BLOCK_REPS", 4)
    made = []
    for name in ("null_paths", "excursions_wide"):
        monkeypatch.setattr(kept, name, lambda *a, f=getattr(kept, name), name=name: made.append(name) or f(*a))
    measured = []
    monkeypatch.setattr(kept, "block_scores", lambda *a, f=kept.block_scores: measured.append([n.id for n in a[2]]) or f(*a))
    panel = bars(spark)
    ensemble = Ensemble(Store(spark, str(tmp_path)))
    run = lambda nodes, n: scored(ensemble.scores([(panel, nodes)], REGISTRY, GRID, 2, n))
    fresh = lambda nodes, n: scored(inference.path_scores(panel, nodes, REGISTRY, GRID, 2, n))
    assert run([A], 8) == fresh([A], 8)
    assert set(made) == {"null_paths", "excursions_wide"} and made.count("null_paths") == len(measured) - 1 == 2  # two blocks, and the observed path
    made.clear(), measured.clear()
    assert run([A], 8) == run([A], 6) + [r for r in run([A], 8) if r[1] > 6] and not made and not measured  # all of it is kept
    assert run([A, B, WEEKDAY], 8) == fresh([A, B, WEEKDAY], 8)
    assert not made and measured and all(ids == ["b", "w"] for ids in measured)  # paths and excursions are read
    measured.clear()
    steps = []
    more = scored(ensemble.scores([(panel, [A, B, WEEKDAY])], REGISTRY, GRID, 2, 12, lambda done, total: steps.append((done, total))))
    assert more == fresh([A, B, WEEKDAY], 12) and made.count("null_paths") == 1 and steps == [(1, 1)]
    # the same test under another name is not run again; another seed or grid is
    made.clear(), measured.clear()
    assert len(run([Node("again", "roc", {"period": 3})], 12)) == len([r for r in more if r[2] == "a"]) and not measured
    assert scored(Ensemble(ensemble.store, 5).scores([(panel, [A])], REGISTRY, GRID, 2, 4)) != run([A], 4)
    assert "null_paths" in made


def test_other_bars_under_the_same_id_are_another_history(spark, tmp_path):
    ensemble, one, two = Ensemble(Store(spark, str(tmp_path))), bars(spark, seed=1), bars(spark, seed=2)
    run = lambda panel: scored(ensemble.scores([(panel, [A])], REGISTRY, GRID, 2, 4))
    want = [scored(inference.path_scores(p, [A], REGISTRY, GRID, 2, 4)) for p in (one, two)]
    assert [run(one), run(two), run(one)] == [want[0], want[1], want[0]] and want[0] != want[1]
    simulated = ensemble.paths(two, 3)
    assert simulated.select("history_id", "rep_id").distinct().count() == 3 and {r.history_id for r in simulated.select("history_id").distinct().collect()} == {"h"}


def test_a_cut_off_block_is_made_again(spark, tmp_path, monkeypatch):
    panel, ensemble = bars(spark), Ensemble(Store(spark, str(tmp_path)))
    real = kept.Ensemble._note

    def cut(self, what, *a):
        if what == "scores":
            raise RuntimeError("cut off")
        real(self, what, *a)

    monkeypatch.setattr(kept.Ensemble, "_note", cut)
    with pytest.raises(RuntimeError, match="cut off"):
        ensemble.scores([(panel, [A])], REGISTRY, GRID, 2, 20)
    monkeypatch.setattr(kept.Ensemble, "_note", real)
    assert scored(ensemble.scores([(panel, [A])], REGISTRY, GRID, 2, 20)) == scored(inference.path_scores(panel, [A], REGISTRY, GRID, 2, 20))


DECLARED = {
    "meta": {"start_date": "2024-01-01", "n_bins": 2, "min_obs": 30, "horizons": {"min": 1, "max": 3}, "barriers": {"min": -0.02, "max": 0.02, "step": 0.02}, "evaluate": {"min_dev": 0.01, "shift_unit": "probability_difference"}},
    "families": {"f": [{"id": "a", "feature": "roc", "params": {"period": 3}}, {"id": "b", "feature": "rsi", "params": {"period": 5}}]},
}


def declared(**changes):
    nodes = [dict(n) for n in DECLARED["families"]["f"]]
    for n in nodes:
        n.update(changes.get(n["id"], {}))
    return parse_workspace({**DECLARED, "families": {"f": nodes + changes.get("more", [])}})


def run_study(study, n=6):
    study.measure()
    study.compare()
    return sorted((r.node_id, r.bin, r.bin_score, r.monte_carlo_p_value, tuple(r.null_scores)) for r in study.validate(n).collect())


def test_two_histories_give_what_two_studies_give(spark, tmp_path):
    one, two = bars(spark, 160, 12), bars(spark, 140, 5)
    load = lambda s, sources: {("ohlcv",): one, ("ohlcv", "other"): two}[sources]
    both = Study.of_sources(declared(b={"data": ["ohlcv", "other"]}), load, Store(spark, f"{tmp_path}/both"))
    got = run_study(both)
    alone = []
    for node, panel in (("a", one), ("b", two)):
        only = parse_workspace({**DECLARED, "families": {"f": [n for n in DECLARED["families"]["f"] if n["id"] == node]}})
        alone += run_study(Study(only, panel, Store(spark, f"{tmp_path}/{node}")))
    assert got == sorted(alone) and len({r[0] for r in got}) == 2
    assert both.features().count() == 300
    again = Study.restored(both.workspace, both.store)
    assert again.panel.select("history_id").distinct().count() == 2 and run_study(again) == got
    assert again.select().columns[-2:] == ["feature_label", "bin_label"]


def test_panels_of_equal_prices_share_a_history(spark, tmp_path):
    panel = bars(spark)
    load = lambda s, sources: panel.withColumn("vix", F.col("close")) if "vix" in sources else panel
    workspace = declared(b={"data": ["ohlcv", "vix"], "feature": "vix_level", "params": {}})
    study = Study.of_sources(workspace, load, Store(spark, str(tmp_path)))
    assert len(study.panels) == 2 and study.panel.count() == 160
    assert {r[0] for r in run_study(study)} == {"a", "b"}


# ---- array features --------------------------------------------------------------------------


def momentum(columns, params):
    """Close over the close some bars before, less one."""
    out = np.full(len(columns["close"]), np.nan)
    n = params["period"]
    out[n:] = columns["close"][n:] / columns["close"][:-n] - 1
    return out


def test_array_features_run_beside_columns(spark, tmp_path):
    registry = default_registry()
    registry.register_array("momentum", momentum, core=True)
    registry.register_array("hour", lambda c, p: (c["ts"].astype("datetime64[D]").astype(int) % 7).astype(float))
    registry.register_array("scaled", lambda c, p: c["extra"] * 2, needs=("extra",))
    panel = bars(spark).withColumn("extra", F.when(F.col("bar_idx") > 2, F.col("close")))
    nodes = [A, Node("m", "momentum", {"period": 3}), Node("h", "hour"), Node("s", "scaled")]
    wide = wide_features(panel, nodes, registry).orderBy("bar_idx").collect()
    assert all(r.a == r.m for r in wide) and [r.s for r in wide[:4]] == [None, None, None, round(wide[3].close * 2, 9)] and {r.h for r in wide} == set(map(float, range(7)))
    with pytest.raises(ValueError, match="needs the columns extra"):
        wide_features(bars(spark), nodes, registry)
    # in a study: recomputed on simulated paths, where it is a core feature
    workspace = declared(more=[{"id": "m", "feature": "momentum", "params": {"period": 3}}])
    rows = run_study(Study(workspace, panel, Store(spark, str(tmp_path)), registry))
    of = lambda node: [r[1:] for r in rows if r[0] == node]
    assert of("m") == of("a") and of("m")


# ---- catalogue -------------------------------------------------------------------------------


def test_the_catalogue_is_a_few_bounded_projections(spark):
    nodes = catalogue_nodes()
    batches = node_batches(nodes, REGISTRY)
    assert len(nodes) == 58 == len({n.id for n in nodes}) and sorted(n.id for b in batches for n in b) == sorted(n.id for n in nodes) and 2 <= len(batches) <= 6
    some = [n for n in nodes if not REGISTRY.get(n.feature).needs]
    panel = bars(spark, 260)
    one = table(long_features(panel, some, REGISTRY), "node_id", "bar_idx")
    assert table(kept_features(panel, some, REGISTRY), "node_id", "bar_idx") == one and len(one) == 260 * len(some)


# ---- paged sources ---------------------------------------------------------------------------


@pytest.fixture
def chain(tmp_path):
    for k in range(4):
        rows = [{"time": f"2024-01-{3 * k + i + 1:02d}T00:00:00Z", "m": None if i == 1 else f"{k}.{i}"} for i in range(3)]
        (tmp_path / f"p{k}.json").write_text(json.dumps({"data": rows, **({"next_page_url": f"p{k + 1}.json"} if k < 3 else {})}))
    return f"file://{tmp_path}/p0.json"


def test_pages_are_read_on_executors(spark, chain):
    got = sorted((r.ts, r.m) for r in read_paged(spark, [chain], "time", {"m": "m"}).collect())
    whole = pages_frame(spark, [r for page in pages(chain) for r in page], "time", ["m"])
    assert got == sorted((r.ts, r.m) for r in whole.collect()) and len(got) == 12 and (DAY + timedelta(1), None) in got
    root = chain.removesuffix("p0.json")
    again = read_pages(lambda u: {**json.loads(open(u.removeprefix("file://")).read())}, f"{root}p3.json")
    assert len(again) == 3
    two = read_paged(spark, [chain, f"{root}p3.json"], "time", {"m": "m"})
    assert two.rdd.getNumPartitions() == 2 and two.count() == 15


@pytest.mark.parametrize("page", [{"data": []}, {"data": [{"time": "2024-01-01"}], "next_page_url": "p.json"}])
def test_bad_pages_fail_the_read(spark, tmp_path, page):
    (tmp_path / "p.json").write_text(json.dumps(page))
    with pytest.raises(Exception, match="empty|repeats"):
        read_paged(spark, [f"file://{tmp_path}/p.json"], "time", {"m": "m"}).collect()
    spark.dataSource.register(PagedSource)
    for options in ({"columns": "a"}, {"urls": "x"}):
        with pytest.raises(Exception, match="option"):
            spark.read.format("touchline_pages").options(**options).load().collect()


def test_the_command_line_takes_several_sources(spark, tmp_path, chain, capsys, caplog):
    from touchline.cli import main

    caplog.set_level(logging.INFO, logger="touchline")
    panel = bars(spark)
    panel.select("ts", "open", "high", "low", "close", "volume").write.parquet(f"{tmp_path}/bars")
    workspace = {**DECLARED, "families": {"f": [DECLARED["families"]["f"][0], {"id": "v", "feature": "vix_level", "data": ["ohlcv", "onchain"]}]}}
    (tmp_path / "w.json").write_text(json.dumps(workspace))
    common = ["--workspace", f"{tmp_path}/w.json", "--store", f"{tmp_path}/out"]
    main(["measure", *common, "--bars", f"{tmp_path}/bars", "--aux", f"onchain=pages:{chain}:m=vix"])
    assert "rows" in capsys.readouterr().out and len(list((tmp_path / "out/snapshots").iterdir())) == 2
    assert {r.node_id for r in Store(spark, f"{tmp_path}/out").read("01_surface", "surface").select("node_id").distinct().collect()} == {"a", "v"}
    assert sum("is kept as" in r.message for r in caplog.records) >= 2
    with pytest.raises(ValueError, match="NAME=KIND"):
        main(["measure", *common, "--bars", f"{tmp_path}/bars", "--aux", "nonsense"])


# ---- upkeep by node --------------------------------------------------------------------------


@pytest.fixture
def measured(monkeypatch):
    """Ids of nodes as they are measured."""
    ids = []
    monkeypatch.setattr(Study, "_measure_some", lambda self, nodes, *a, f=Study._measure_some: ids.extend(n.id for n in nodes) or f(self, nodes, *a))
    return ids


def test_a_changed_node_alone_is_measured_again(spark, tmp_path, measured):
    panel, store = bars(spark), Store(spark, str(tmp_path))
    first = Study(declared(), panel, store).measure()
    rows = {tuple(r) for r in first.where("node_id = 'b'").collect()}
    assert sorted(measured) == ["a", "b"]
    measured.clear()
    Study(declared(), panel, store).measure()
    assert measured == []
    changed = Study(declared(a={"params": {"period": 9}}, more=[{"id": "007", "feature": "constant"}]), panel, store)
    out = changed.measure()
    assert sorted(measured) == ["007", "a"] and {tuple(r) for r in out.where("node_id = 'b'").collect()} == rows
    assert {r.node_id for r in out.select("node_id").distinct().collect()} == {"a", "b", "007"}
    measured.clear()
    gone = parse_workspace({**DECLARED, "families": {"f": DECLARED["families"]["f"][1:]}})
    assert {r.node_id for r in Study(gone, panel, store).measure().select("node_id").distinct().collect()} == {"b"} and measured == []
    Study(gone, bars(spark, 150), store).measure()  # another history: all anew
    assert measured == ["b"]


def test_a_node_that_fails_while_it_runs_costs_only_itself(spark, tmp_path, caplog):
    registry = default_registry()

    def broken(columns, params):
        raise ArithmeticError("no such number")

    registry.register_array("broken", broken)
    registry.register_array("short", lambda c, p: c["close"][1:])
    workspace = declared(more=[{"id": "x", "feature": "broken"}, {"id": "y", "feature": "short"}, {"id": "z", "feature": "nope"}, {"id": "few", "feature": "ma_ratio", "params": {"period": 150}}])
    study = Study(workspace, bars(spark), Store(spark, str(tmp_path)), registry)
    assert {r.node_id for r in study.measure().select("node_id").distinct().collect()} == {"a", "b"}
    said = {r.message.split()[1]: r.message for r in caplog.records if "left out" in r.message}
    assert set(said) == {"x", "y", "z", "few"} and "unknown feature" in said["z"] and "only" in said["few"]
    study.compare()
    assert {r.node_id for r in study.validate(4).select("node_id").distinct().collect()} == {"a", "b"}
    registry.register_array("broken", lambda c, p: c["close"], version="2")
    assert {r.node_id for r in study.measure().select("node_id").distinct().collect()} == {"a", "b", "x"}


def test_five_marks_of_finished_work(caplog):
    caplog.set_level(logging.INFO, logger="touchline")
    progress = Progress("measuring nodes", 58)
    for _ in range(58):
        progress.step()
    assert [r.message for r in caplog.records] == [f"measuring nodes: {n} of 58 ({p} %)" for n, p in ((12, 20), (24, 41), (35, 60), (47, 81), (58, 100))]
    caplog.clear()
    Progress("x", 10).reach(10)
    assert len(caplog.records) == 1


def test_marks_follow_the_work(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO, logger="touchline")
    study = Study(declared(), bars(spark), Store(spark, str(tmp_path)))
    run_study(study, 100)
    said = [r.message for r in caplog.records]
    assert any(m.startswith("measuring nodes: 2 of 2") for m in said) and sum(m.startswith("validating blocks of replicates") for m in said) >= 3
