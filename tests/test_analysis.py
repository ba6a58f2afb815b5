"""The barrier-touch operators against hand-made numbers and NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.config import Grid, Node
from touchline.functions.features import FeatureRegistry, default_registry, long_features, wide_features
from touchline.operators import inference, reporting, scoring, surface
from touchline.operators.null_model import log_components, null_fit, null_paths
from touchline.sources.readers import with_defaults

REGISTRY = default_registry()
BARS = "history_id string, rep_id int, bar_idx long, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def history(n=240, seed=7, sigma=0.02):
    r = np.random.default_rng(seed)
    close = np.round(100 * np.exp(np.cumsum(r.normal(0.002, sigma, n))), 4)
    open_ = np.concatenate([[100.0], close[:-1]])
    high, low = np.round(np.maximum(open_, close) * 1.01, 4), np.round(np.minimum(open_, close) * 0.99, 4)
    return open_, high, low, close, np.round(r.uniform(1, 9, n), 2)


def frame(spark, columns, rep=0):
    from datetime import datetime, timedelta

    rows = [("h", rep, k, datetime(2024, 1, 1) + timedelta(k), *map(float, v)) for k, v in enumerate(zip(*columns))]
    return spark.createDataFrame(rows, BARS)


@pytest.fixture(scope="module")
def bars(spark):
    return frame(spark, history()).cache()


def rolling(x, n, f):
    return np.array([f(x[k - n + 1 : k + 1]) if k >= n - 1 and not np.isnan(x[k - n + 1 : k + 1]).any() else np.nan for k in range(len(x))])


def ema(x, span):
    out, a = [x[0]], 2 / (span + 1)
    for v in x[1:]:
        out.append(a * v + (1 - a) * out[-1])
    return np.array(out)


def lagged(x, n):
    return np.concatenate([np.full(n, np.nan), x[:-n]])


def expected(name):
    o, h, l, c, v = history()  # noqa: E741
    mean = lambda n, x=c: rolling(x, n, np.mean)
    std = lambda n, x=c: rolling(x, n, lambda y: np.std(y, ddof=1))
    prev = np.concatenate([[c[0]], c[:-1]])
    ret = np.log(c / lagged(c, 1))
    true_range = np.max([h - l, np.abs(h - prev), np.abs(l - prev)], 0)
    low, high = rolling(l, 14, np.min), rolling(h, 14, np.max)
    k = 100 * (c - low) / (high - low)

    def rsi(n):
        g, d = mean(n, np.maximum(c - prev, 0)), mean(n, np.maximum(prev - c, 0))
        return 100 - 100 / (1 + g / d)

    roc = lambda n: c / lagged(c, n) - 1
    dd = lambda n: c / rolling(c, n, np.max) - 1
    macd = (ema(c, 12) - ema(c, 26)) / c
    return {
        "ma_ratio": c / mean(20) - 1, "ma_cross": mean(10) / mean(50) - 1, "roc": roc(5), "roc_spread": roc(5) - roc(20), "drawdown": dd(50),
        "drawdown_recovery": dd(20) - dd(50), "rsi": rsi(14), "rsi_spread": rsi(7) - rsi(14), "macd": macd, "macd_histogram": macd - ema(macd, 9),
        "realized_vol": std(20, ret) * 252**0.5 * 100, "vol_ratio": std(10, ret) / std(50, ret), "atr": mean(14, true_range) / c,
        "bb_pct": (c - (mean(20) - 2 * std(20))) / (4 * std(20)), "bb_width": 4 * std(20) / mean(20), "volume_ratio": v / mean(20, v), "stoch_k": k,
        "stoch_d": rolling(k, 3, np.mean), "williams_r": (c - high) / (high - low) + 1, "constant": np.zeros(len(c)),
    }[name]


def test_features_match_numpy(spark, bars):
    from touchline.plans.queries import FEATURES

    names = [n for n in FEATURES if n not in ("day_of_week", "wr_spread") and REGISTRY.get(n).core]
    wide = wide_features(bars, [Node(n, n, FEATURES[n]) for n in names], REGISTRY).toPandas().sort_values("bar_idx")
    for n in names:
        np.testing.assert_allclose(wide[n].to_numpy(float), expected(n), atol=2e-9, err_msg=n)


def test_rsi_without_losses_or_moves(spark):
    up = np.arange(1.0, 7.0)
    flat = np.full(6, 5.0)
    for close, want in ((up, 100.0), (flat, None)):
        rows = wide_features(frame(spark, [close] * 4 + [flat]), [Node("x", "rsi", {"period": 3})], REGISTRY).orderBy("bar_idx").collect()
        assert [r.x for r in rows] == [None, None, want, want, want, want]


def test_unknown_features_and_missing_columns(bars):
    with pytest.raises(ValueError, match="unknown feature"):
        wide_features(bars, [Node("x", "nope")], REGISTRY)
    with pytest.raises(ValueError, match="needs the columns vix"):
        wide_features(bars, [Node("x", "vix_level")], REGISTRY)
    with pytest.raises(ValueError, match="period"):
        wide_features(bars, [Node("x", "roc")], REGISTRY)


def test_weekday_and_equal_primitives_sort_once(bars):
    nodes = [Node("d", "day_of_week"), Node("a", "ma_ratio", {"period": 5}), Node("b", "ma_cross", {"fast": 5, "slow": 9})]
    wide = wide_features(bars, nodes, REGISTRY)
    assert [r.d for r in wide.orderBy("bar_idx").limit(7).collect()] == [0, 1, 2, 3, 4, 5, 6]  # 2024-01-01 is a Monday
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Exchange hashpartitioning") <= 2


def test_registered_feature(bars):
    own = FeatureRegistry()
    own.register("double", lambda stage, p: F.col("close") * 2, core=True)
    rows = long_features(bars, [Node("x", "double")], own)
    assert rows.join(bars, "bar_idx").where("abs(value - 2 * close) > 1e-8").count() == 0


# ---- measurement -----------------------------------------------------------------------------


def test_excursions_match_brute_force(spark, bars):
    o, h, l, c, v = history()  # noqa: E741
    got = {(r.bar_idx, r.horizon): (r.down, r.up) for r in surface.excursions(bars, (7, 1, 7, 100, 300)).collect()}
    assert len(got) == 240 * 4
    for t in range(240):
        for k in (1, 7, 100, 300):
            want = (None, None) if t + k >= 240 else (l[t + 1 : t + k + 1].min() / c[t] - 1, h[t + 1 : t + k + 1].max() / c[t] - 1)
            assert got[t, k] == want


def test_a_missing_high_hides_its_windows(spark):
    cols = [np.array(x, object) for x in history(12)]
    cols[1][5] = None
    rows = [("h", 0, k, None, *[None if x is None else float(x) for x in v]) for k, v in enumerate(zip(*cols))]
    got = {r.bar_idx: r.up for r in surface.excursions(spark.createDataFrame(rows, BARS), (3,)).collect()}
    assert [t for t in range(12) if got[t] is None] == [2, 3, 4, 9, 10, 11]


def test_five_bars_by_hand(spark):
    """Baseline 1/2 up and down; given the feature above its edge, 1 of 1."""
    high, low = [100, 101, 110, 103, 120], [100, 99, 90, 98, 95]
    df = frame(spark, [[100] * 5, high, low, [100] * 5, [1] * 5])
    grid = Grid((-0.05, 0.05), (1,))
    exc = surface.excursions(df, (1,))
    base = surface.baseline_rates(exc, grid).collect()
    assert {(r.barrier, r.n_obs, r.n_hit, r.p) for r in base} == {(-0.05, 4, 2, None), (0.05, 4, 2, None)}
    values = spark.createDataFrame([("h", 0, "n", k, v) for k, v in enumerate([None, None, 0.0, 1.0, 1.0])], "history_id string, rep_id int, node_id string, bar_idx long, value double")
    edges = spark.createDataFrame([("h", 0, "n", [0.5])], "history_id string, rep_id int, node_id string, edges array<double>")
    rates = surface.conditional_rates(exc, surface.assign_bins(values, edges), grid).collect()
    assert {(r.bin, r.barrier, r.n_obs, r.n_hit) for r in rates} == {(0, -0.05, 1, 0), (0, 0.05, 1, 0), (1, -0.05, 1, 1), (1, 0.05, 1, 1)}


def values_frame(spark, xs):
    return spark.createDataFrame([("h", 0, "n", k, None if x is None else float(x)) for k, x in enumerate(xs)], "history_id string, rep_id int, node_id string, bar_idx long, value double")


@pytest.mark.parametrize("xs, n, want", [
    ([0] * 60 + [1] * 20, 4, [0.25]), ([1] * 50, 5, []), (list(range(101)), 1, []), (list(range(101)), 4, [25.0, 50.0, 75.0]), ([None] * 5 + [0, 1, 2], 2, [1.0]),
])
def test_quantile_edges(spark, xs, n, want):
    assert surface.quantile_edges(values_frame(spark, xs), n).first().edges == want


def test_values_on_an_edge_are_below_it(spark):
    values = values_frame(spark, [0] * 60 + [1] * 20 + [0.25])
    edges = spark.createDataFrame([("h", 0, "n", [0.25])], "history_id string, rep_id int, node_id string, edges array<double>")
    assert {(r.bin, r["count"]) for r in surface.assign_bins(values, edges).groupBy("bin").count().collect()} == {(0, 61), (1, 20)}


def test_bins_need_one(spark):
    with pytest.raises(ValueError):
        surface.quantile_edges(values_frame(spark, [1]), 0)


def test_labels():
    assert surface.bin_labels([]) == ["all"] and surface.bin_labels([0.12, 12345.6]) == ["x < 0.12", "0.12 < x < 1.235e+04", "1.235e+04 < x"]


# ---- scores ----------------------------------------------------------------------------------

SHIFTS = "history_id string, rep_id int, node_id string, bin int, horizon int, barrier_idx int, barrier double, n_obs long, n_hit long, p double, base_p double, shift double"


def shift_frame(spark, barriers, cells, base=None):
    """cells: {(bin, horizon): (n, [p by barrier])}; base: {horizon: [p by barrier]}."""
    rows = []
    for (b, h), (n, ps) in cells.items():
        for k, p in enumerate(ps):
            q = (base or {}).get(h, [0.0] * len(ps))[k]
            rows.append(("h", 0, "n", b, h, k, barriers[k], n, 0, p, q, None if p is None else p - q))
    return spark.createDataFrame(rows, SHIFTS)


def slow_scores(barriers, cells, base):
    mags = [d for d in sorted({abs(b) for b in barriers if abs(b) > 1e-12}) if barriers.count(d) == barriers.count(-d) == 1]
    bins, hs, out = sorted({b for b, _ in cells}), sorted({h for _, h in cells}), {}
    for b in bins:
        out[b] = [0.0, False]
    for d in mags:
        up, down = barriers.index(d), barriers.index(-d)
        for h in hs:
            diff = {}
            for b in bins:
                n, p = cells.get((b, h), (0, None))
                if p and n >= 30 and p[up] is not None and p[down] is not None:
                    diff[b] = abs((p[up] - base[h][up]) - (p[down] - base[h][down])) * d / mags[-1]
            if len(diff) >= 2:
                for b, x in diff.items():
                    out[b][0] += x
                    out[b][1] = True
    return {b: (round(s, 9), ok) for b, (s, ok) in out.items()}


def run_scores(spark, barriers, cells, base=None):
    return {r.bin: (r.score, r.supported) for r in scoring.bin_scores(shift_frame(spark, barriers, cells, base), Grid(tuple(barriers), (1,))).collect()}


def test_scores_on_a_hostile_grid(spark):
    barriers, r = [0.02, -0.01, 0.0, -0.02, 0.01, 0.03, -0.04, 0.04, 0.04], np.random.default_rng(1)
    cells = {(b, h): (int(r.integers(20, 90)), [None if r.random() < 0.1 else round(float(r.random()), 3) for _ in barriers]) for b in range(4) for h in (1, 3)}
    base = {h: [round(float(r.random()), 3) for _ in barriers] for h in (1, 3)}
    got, want = run_scores(spark, barriers, cells, base), slow_scores(barriers, cells, base)
    assert {b: ok for b, (_, ok) in got.items()} == {b: ok for b, (_, ok) in want.items()}
    assert all(got[b][0] == pytest.approx(want[b][0], abs=1e-9) for b in want)


def test_scores_weigh_barriers_linearly(spark):
    barriers = [-0.02, -0.01, 0.01, 0.02]
    cells = {(0, 1): (50, [0.0, 0.0, 0.4, 0.5]), (1, 1): (50, [0.2, 0.0, 0.0, 1.0])}
    assert run_scores(spark, barriers, cells) == {0: (0.7, True), 1: (0.8, True)}


def test_scores_need_two_bins_and_pairs(spark):
    assert run_scores(spark, [-0.01, 0.01], {(0, 1): (50, [0.1, 0.9]), (1, 1): (29, [0.5, 0.1])}) == {0: (0.0, False), 1: (0.0, False)}
    assert run_scores(spark, [0.01, 0.02], {(0, 1): (50, [0.1, 0.9]), (1, 1): (50, [0.5, 0.1])}) == {0: (0.0, False), 1: (0.0, False)}


def test_drift_alone_scores_nought_with_support(spark):
    close = 100 * 1.02 ** np.arange(130)
    df = frame(spark, [close] * 4 + [np.ones(130)])
    values = values_frame(spark, [k % 2 for k in range(130)])
    grid = Grid((-0.015, -0.01, 0.01, 0.015), (1, 3))
    exc = surface.excursions(df, grid.horizons)
    rates = surface.conditional_rates(exc, surface.assign_bins(values, surface.quantile_edges(values, 2)), grid)
    got = scoring.bin_scores(scoring.shift_surface(rates, surface.baseline_rates(exc, grid)), grid).collect()
    assert {(r.bin, r.score, r.supported) for r in got} == {(0, 0.0, True), (1, 0.0, True)}


def slow_filter(barriers, cells, base, min_dev, min_n, min_run):
    best = {}
    for (b, h), (n, ps) in sorted(cells.items()):
        if n < min_n:
            continue
        run, start = 0, None
        dev = [None if p is None else p - base[h][k] for k, p in enumerate(ps)]
        for i, v in enumerate(dev):
            if v is None or abs(v) < min_dev:
                run, start = 0, None
                continue
            if start is not None and (v > 0) != (dev[start] > 0):
                run, start = 1, i
            else:
                start = i if start is None else start
                run += 1
            if run >= min_run:
                k = max(range(start, i + 1), key=lambda j: (abs(dev[j]), -j))
                if h not in best or abs(dev[k]) > abs(best[h][2]):
                    best[h] = (b, barriers[k], dev[k], run)
    return best


def test_economic_filter_matches_a_scan(spark):
    r, barriers = np.random.default_rng(5), [round(x / 100, 2) for x in range(-6, 7)]
    cells = {(b, h): (int(r.integers(40, 90)), [None if r.random() < 0.05 else float(r.integers(0, 33)) / 32 for _ in barriers]) for b in range(5) for h in (1, 2, 3, 4)}
    base = {h: [0.5] * len(barriers) for h in (1, 2, 3, 4)}
    got = scoring.economic_filter(shift_frame(spark, barriers, cells, base), 0.125, 50, 2)
    assert {r.horizon: (r.bin, r.barrier, r.dev, r.run) for r in got.collect()} == slow_filter(barriers, cells, base, 0.125, 50, 2)
    top = scoring.strongest(got).first()
    assert abs(top.dev) == max(abs(x[2]) for x in slow_filter(barriers, cells, base, 0.125, 50, 2).values())


def test_effect_threshold(spark):
    cells, base = {(0, 1): (60, [0.25, 0.75])}, {1: [0.125, 0.5]}
    for dev, n in ((0.125, 1), (0.126, 0)):
        assert scoring.economic_filter(shift_frame(spark, [0.01, 0.02], cells, base), dev).count() == n
    with pytest.raises(ValueError):
        scoring.economic_filter(shift_frame(spark, [0.01, 0.02], cells, base), 1.5)


# ---- inference -------------------------------------------------------------------------------


def test_fit_is_a_cholesky_factor(spark, bars):
    comp = log_components(bars)
    x = comp.orderBy("bar_idx").toPandas()[["g_open", "g_close", "g_high", "g_low"]].to_numpy()
    assert len(x) == 240 and x[0, 0] == pytest.approx(-x[0, 1])  # the first bar is its own previous close
    fit = null_fit(comp).first()
    lower = np.array([[fit[f"l{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
    np.testing.assert_allclose([fit[f"m{i}"] for i in range(4)], x.mean(0), atol=1e-11)
    np.testing.assert_allclose(lower @ lower.T, np.cov(x.T) + 1e-12 * np.eye(4), atol=1e-11)


def test_paths_do_not_depend_on_partitions(spark, bars):
    fit = null_fit(log_components(bars))
    a = null_paths(bars, fit, 4).orderBy("rep_id", "bar_idx").collect()
    b = null_paths(bars.repartition(7), fit, 4).orderBy("rep_id", "bar_idx").collect()
    assert a == b and len(a) == 960 and {r.rep_id for r in a} == {1, 2, 3, 4}
    assert null_paths(bars, fit, 4, seed=1).where("rep_id = 1 and bar_idx = 5").first().close != next(r.close for r in a if r.bar_idx == 5)


def test_observed_and_copied_paths_score_alike(spark, bars):
    both = bars.union(bars.withColumn("rep_id", F.lit(3)))
    grid, nodes = Grid((-0.03, -0.01, 0.01, 0.03), (1, 5)), [Node("r", "roc", {"period": 3})]
    rates, base = surface.measure(both, nodes, REGISTRY, grid, 3)
    rows = scoring.bin_scores(scoring.shift_surface(rates, base), grid).collect()
    by = {rep: {r.bin: (r.score, r.supported) for r in rows if r.rep_id == rep} for rep in (0, 3)}
    assert by[0] == by[3] and len(by[0]) == 3


SCORES = "history_id string, rep_id int, node_id string, bin int, score double, supported boolean"


def test_p_values_count_ties_and_missing_bins(spark):
    rows = [("h", 0, "a", 0, 0.5, True), ("h", 0, "a", 1, 0.0, True), ("h", 0, "a", 2, 0.1, False)]
    rows += [("h", k, "a", 0, s, True) for k, s in enumerate([0.5, 0.6, 0.1], 1)] + [("h", 1, "a", 1, 9.0, False)]
    got = {r.bin: r for r in inference.monte_carlo(spark.createDataFrame(rows, SCORES), 4).collect()}
    assert set(got) == {0, 1}
    assert (got[0].monte_carlo_p_value, got[0].n_supported_null, got[0].cleared) == (3 / 5, 3, False)
    assert got[1].monte_carlo_p_value == 1.0  # nought ties with every null
    assert got[0].null_p95 == pytest.approx(np.quantile([0.5, 0.6, 0.1, 0.0], 0.95))
    assert inference.skipped_bins(spark.createDataFrame(rows, SCORES)).first().bin == 2


def test_selection_order_and_threshold(spark):
    rows = [("b", 0, 2.0, 0.01, True), ("a", 1, 2.0, 0.01, True), ("a", 0, 1.0, 0.01, True), ("c", 0, 9.0, 0.04, True), ("d", 0, 9.0, 0.05, False)]
    tests = spark.createDataFrame(rows, "node_id string, bin int, bin_score double, monte_carlo_p_value double, cleared boolean")
    got = [(r.selection_number, r.node_id, r.bin) for r in inference.selection(tests).orderBy("selection_number").collect()]
    assert got == [(1, "a", 1), (2, "b", 0), (3, "a", 0), (4, "c", 0)]


def test_fixed_features_keep_observed_values(spark, bars):
    paths = null_paths(bars, null_fit(log_components(bars)), 2)
    rows = inference.all_features(bars, paths, [Node("w", "day_of_week"), Node("r", "roc", {"period": 2})], REGISTRY)
    w = rows.where("node_id = 'w'").groupBy("bar_idx").agg(F.count("*").alias("n"), F.count_distinct("value").alias("d")).select("n", "d").distinct().collect()
    assert [(r.n, r.d) for r in w] == [(3, 1)]
    assert rows.where("node_id = 'r' and bar_idx = 9").select("value").distinct().count() == 3


def test_histogram_bounds(spark):
    r = np.random.default_rng(2)
    x = sorted(round(float(v), 6) for v in r.exponential(1, 500))
    tests = spark.createDataFrame([("a", 0, x), ("b", 0, [1.0] * 9)], "node_id string, bin int, null_scores array<double>")
    got = reporting.null_histogram(tests).collect()
    a = [g for g in got if g.node_id == "a"]
    edges = np.histogram_bin_edges(x, min(80, max(24, len(np.histogram_bin_edges(x, bins="fd")) - 1)))
    want = np.histogram(x, edges)[0]
    assert a[0].n_bars == len(want) and {g.bar: g.n for g in a} == {k: int(n) for k, n in enumerate(want) if n}
    assert [(g.n_bars, g.n) for g in got if g.node_id == "b"] == [(24, 9)]


def test_default_columns(spark):
    rows = with_defaults(spark.createDataFrame([(5.0, 4.0)], "close double, open double")).first()
    assert (rows.high, rows.low, rows.volume) == (5.0, 4.0, 1.0)
