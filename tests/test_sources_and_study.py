"""Sources, the market-data contract, declarations, the four stages, and the command line."""

import ast
import json
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from touchline.config import parse_config, parse_workspace
from touchline.operators import cleaning
from touchline.sources import readers
from touchline.sources.bars import bars_daily, bars_hourly, indexed
from touchline.store import Store, content_digest, history_id
from touchline.study import Study
from touchline.streaming.bars import stream_bars

FEED = "ts timestamp_ntz, open double, high double, low double, close double, volume double, arrival long"
DAY = datetime(2024, 1, 1)


def good(n=3):
    return [(DAY + timedelta(k), 10.0, 11.0, 9.0, 10.5, 1.0, k) for k in range(n)]


def changed(row, **new):
    names = ["ts", "open", "high", "low", "close", "volume", "arrival"]
    return tuple(new.get(n, v) for n, v in zip(names, row))


def broken(spark, rows):
    df = cleaning.violations(spark.createDataFrame(rows, FEED))
    return {r.rule for r in df.collect() if r.n_bars}


def test_a_good_panel_passes(spark):
    df = spark.createDataFrame(good(), FEED)
    assert broken(spark, good()) == set() and cleaning.check_panel(df) is df


@pytest.mark.parametrize("new, rule", [
    ({"ts": None}, "null_timestamp"), ({"ts": DAY}, "not_increasing"), ({"ts": DAY - timedelta(5)}, "not_increasing"), ({"close": None}, "not_finite"),
    ({"high": float("inf")}, "not_finite"), ({"low": float("nan")}, "not_finite"), ({"volume": None}, "not_finite"), ({"open": 0.0, "low": 0.0}, "price_not_positive"),
    ({"low": -1.0}, "price_not_positive"), ({"volume": -1.0}, "negative_volume"), ({"low": 10.2}, "low_above_body"), ({"high": 10.2}, "high_below_body"),
    ({"high": 8.0, "low": 12.0}, "low_above_high"),
])
def test_the_contract_rejects(spark, new, rule):
    rows = good()
    rows[1] = changed(rows[1], **new)
    assert rule in broken(spark, rows)
    with pytest.raises(ValueError, match=rule):
        cleaning.check_panel(spark.createDataFrame(rows, FEED))


def test_the_contract_rejects_shapes(spark):
    df = spark.createDataFrame(good(), FEED)
    assert broken(spark, []) == {"empty"}
    for bad, what in ((df.drop("low"), "missing"), (df.withColumn("close", F.lit("x")), "real numbers"), (df.withColumn("ts", F.col("ts").cast("timestamp")), "naive"), (df.withColumn("volume", F.lit(True)), "real numbers")):
        with pytest.raises(ValueError, match=what):
            cleaning.check_panel(bad)
    with pytest.raises(ValueError, match="auxiliary_infinite"):
        cleaning.check_panel(df.withColumn("vix", F.lit(float("inf"))), ("vix",))
    assert cleaning.check_panel(df.withColumn("vix", F.lit(None).cast("double")), ("vix",))


def test_the_last_arrival_wins_and_incomplete_bars_go(spark):
    rows = [*good(), changed(good()[1], close=10.7, arrival=9), changed(good()[2], volume=None, arrival=8)]
    got = cleaning.clean_bars(spark.createDataFrame(rows, FEED), "2024-01-02").collect()
    assert [(r.ts, r.close) for r in got] == [(DAY + timedelta(1), 10.7)]


def test_asof_keeps_missing_values_and_never_looks_ahead(spark):
    panel = spark.createDataFrame([("h", r, k, DAY + timedelta(k)) for r in (0, 1) for k in range(5)], "history_id string, rep_id int, bar_idx long, ts timestamp_ntz")
    aux = spark.createDataFrame([(DAY + timedelta(days=1, hours=-2), 1.0), (DAY + timedelta(3), None)], "ts timestamp_ntz, x double")
    got = cleaning.asof_join(panel, aux, ["x"]).orderBy("rep_id", "bar_idx").collect()
    assert [r.x for r in got] == [None, 1.0, 1.0, None, None] * 2


def test_forward_fill(spark):
    rows = [(DAY + timedelta(k), v) for k, v in enumerate([None, 1.0, None, 2.0, None])]
    got = cleaning.ffill(spark.createDataFrame(rows, "ts timestamp_ntz, x double"), ["x"]).orderBy("ts").collect()
    assert [r.x for r in got] == [None, 1.0, 1.0, 2.0, 2.0]


def test_csv_feed_normalises_time_and_numbers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("DATETIME,OPEN,HIGH,LOW,CLOSE,VOLUME_BTC,X\n2024-01-01T01:00:00+01:00,1,2,0.5,1.5,7,z\n2024-01-01 02:00:00,1,2,inf,bad,7,z\n")
    names = {"OPEN": "open", "HIGH": "high", "LOW": "low", "CLOSE": "close", "VOLUME_BTC": "volume"}
    got = readers.read_ohlcv(spark, str(tmp_path / "a.csv"), "csv", "DATETIME", names).orderBy("ts").collect()
    assert [r.ts for r in got] == [DAY, DAY + timedelta(hours=2)] and (got[0].low, got[1].low, got[1].close) == (0.5, None, None)
    with pytest.raises(ValueError):
        readers.read_ohlcv(spark, "x", "xml")


def test_two_level_columns_of_one_symbol(spark, tmp_path):
    rows = spark.createDataFrame([(DAY, 1.0, 2.0, 0.5, 1.5, 7.0)], "ts timestamp_ntz, open double, high double, low double, close double, volume double")
    two = rows.select("ts", *[F.struct(F.col(c).alias("BTC-USD")).alias(c) for c in rows.columns[1:]])
    two.write.parquet(f"{tmp_path}/two")
    assert readers.read_ohlcv(spark, f"{tmp_path}/two").drop("arrival").collect() == rows.collect()
    with pytest.raises(ValueError, match="2 symbols"):
        readers.flattened(two.withColumn("close", F.struct(F.lit(1.0).alias("a"), F.lit(2.0).alias("b"))))


def test_pages(spark):
    pages = {"a": {"data": [{"time": "2024-01-01T00:00:00Z", "m": "1.5"}], "next_page_url": "b"}, "b": {"data": [{"time": "2024-01-02T00:00:00Z", "m": None}]}}
    rows = readers.read_pages(pages.get, "a")
    assert [(r.ts, r.m) for r in readers.pages_frame(spark, rows, "time", ["m"]).collect()] == [(DAY, 1.5), (DAY + timedelta(1), None)]
    for loop in ({"a": {"data": [1], "next_page_url": "a"}}, {"a": {"data": []}}):
        with pytest.raises(ValueError):
            readers.read_pages(loop.get, "a")


def test_loader_contract(spark):
    ok = readers.load_panel(lambda s, sources: s.range(len(sources)), spark, ("ohlcv", "vix"))
    assert ok.count() == 2
    for bad in ((), ("vix", "ohlcv"), ("ohlcv", "ohlcv")):
        with pytest.raises(ValueError):
            readers.load_panel(lambda s, sources: None, spark, bad)


def test_bars_are_ordered_and_positive(spark, sf_dir):
    for make in (bars_daily, bars_hourly):
        df = make(spark, sf_dir)
        assert not {r.rule for r in cleaning.violations(df).collect() if r.n_bars}


def test_declarations():
    c = parse_config({"start_date": "2020-01-01", "Δ": {"min": -0.1, "max": 0.1, "step": 0.05}, "horizons": {"max": 3}, "evaluate": {"min_dev": 12}, "asset": {"interval": "1h"}})
    assert c.grid.barriers == (-0.1, -0.05, 0.0, 0.05, 0.1) and c.grid.horizons == (1, 2, 3) and c.min_dev == 0.12 and c.horizon_unit == "h" and c.middle_horizon == 2
    plain = parse_config({"start_date": "x", "evaluate": {"shift_unit": "probability_difference"}})
    assert plain.min_dev == 0.10 and len(plain.grid.barriers) == 41 and plain.grid.barriers[0] == -0.2 and plain.horizon_unit == "d"
    for bad in ({"shift_unit": "x"}, {"min_dev": 200}, {"min_dev": float("nan")}):
        with pytest.raises(ValueError):
            parse_config({"start_date": "x", "evaluate": bad})
    with pytest.raises(ValueError):
        parse_workspace({"meta": {}})


DECLARED = {
    "meta": {"start_date": "1995-01-01", "n_bins": 3, "horizons": {"min": 1, "max": 5}, "barriers": {"min": -0.04, "max": 0.04, "step": 0.02}, "evaluate": {"min_dev": 0.01, "shift_unit": "probability_difference"}},
    "families": {"base": [{"id": "baseline", "feature": "constant"}], "own": [{"id": "roc", "feature": "roc", "params": {"period": 5}}, {"id": "bad", "feature": "nope"}, {"id": "late", "feature": "ma_ratio", "params": {"period": 1090}}]},
}


def test_four_stages(spark, sf_dir, tmp_path):
    study = Study(parse_workspace(DECLARED), bars_daily(spark, sf_dir), Store(spark, str(tmp_path)))
    with pytest.raises(RuntimeError, match="run measure"):
        study.compare()
    surface = study.measure()
    assert {r.node_id for r in surface.select("node_id").distinct().collect()} == {"baseline", "roc"}
    # the constant's only bin is the baseline
    base = study.store.read("01_surface", "baseline")
    same = surface.where("node_id = 'baseline'").alias("a").join(base.alias("b"), ["horizon", "barrier_idx"]).where("a.n_hit <> b.n_hit or a.n_obs <> b.n_obs")
    assert same.count() == 0
    with pytest.raises(RuntimeError, match="run compare"):
        study.validate(4)
    study.compare()
    with pytest.raises(RuntimeError, match="run validate"):
        study.select()
    tests = study.validate(4)
    assert {(r.node_id, r.bin) for r in tests.collect()} == {("roc", 0), ("roc", 1), ("roc", 2)}
    assert study.select().count() == tests.where("cleared").count()
    status = {r.family: r for r in study.status().collect()}
    assert (status["TOTAL"].nodes, status["TOTAL"].measured, status["own"].tested) == (4, 2, 3)
    assert study.status("roc").count() > 0
    # another panel makes the stored surface stale
    other = Study(study.workspace, bars_daily(spark, sf_dir).where("bar_idx < 900"), study.store)
    with pytest.raises(RuntimeError, match="stale"):
        other.compare()


def test_stages_run_from_the_store_and_refuse_other_settings(spark, sf_dir, tmp_path, caplog):
    workspace, store = parse_workspace(DECLARED), Store(spark, f"file://{tmp_path}/a store")
    with pytest.raises(RuntimeError, match="run measure"):
        Study.restored(workspace, store)
    first = Study(workspace, bars_daily(spark, sf_dir), store)
    want = {tuple(r) for r in first.measure().collect()}
    study = Study.restored(workspace, store)
    assert study.panel.count() == first.panel.count() and {tuple(r) for r in study.measure().collect()} == want
    values = study.features()
    assert values.count() == 2 * study.panel.count() and values.where("node_id = 'roc' and value is null").count() == 5
    full = study.compare()
    thin = study.compare(thin=True)
    assert "p" in full.columns and "p" in thin.columns and {"p", "base_p"}.isdisjoint(store.read("02_shift", "shift").columns)
    assert sorted(map(str, thin.select(sorted(full.columns)).collect())) == sorted(map(str, first.shifts().select(sorted(full.columns)).collect()))
    caplog.set_level("INFO", logger="touchline")
    study.validate(3)
    study.select()
    assert any("bins of" in r.message for r in caplog.records) and any("completed in" in r.message for r in caplog.records)
    assert store.has("04_selection", "null_histogram") and {"sheets", "selected"} <= set(study.status().columns)
    # one more bin: every stage sees that what is kept is of other settings
    other = Study.restored(parse_workspace({**DECLARED, "meta": {**DECLARED["meta"], "n_bins": 4}}), store)
    for stage in (other.compare, lambda: other.validate(3), other.select, other.features):
        with pytest.raises(RuntimeError, match="stale"):
            stage()
    # a thin surface is only completed by the tables that it came from
    store.write("01_surface", "baseline", spark.createDataFrame(store.read("01_surface", "baseline").where("horizon < 3").collect()))
    with pytest.raises(RuntimeError, match="other tables"):
        study.shifts()


def test_observed_excursions_are_kept_while_they_fit(spark, sf_dir, tmp_path):
    study = Study(parse_workspace(DECLARED), bars_daily(spark, sf_dir), Store(spark, str(tmp_path)))
    rows = {(r.bar_idx, r.exc[0].up) for r in study.observed_excursions().collect()}
    written = study.store.manifest("cache")
    study.store.write("cache", "excursions", spark.createDataFrame([(1,)], "marker int"))
    assert study.observed_excursions().columns == ["marker"]  # nothing is measured again
    longer = Study(parse_workspace({**DECLARED, "meta": {**DECLARED["meta"], "horizons": {"min": 1, "max": 6}}}), study.panel, study.store)
    again = longer.observed_excursions()
    assert {(r.bar_idx, r.exc[0].up) for r in again.collect()} == rows and study.store.manifest("cache") != written


def test_snapshots_are_named_by_content(spark, tmp_path):
    store, df = Store(spark, str(tmp_path)), spark.createDataFrame(good(), FEED)
    a, b, c = store.snapshot(df), store.snapshot(df.repartition(2)), store.snapshot(df.where("arrival > 0"))
    assert a == b != c and spark.read.parquet(a).count() == 3 and len(store.files.names("snapshots")) == 2


def test_two_level_fill_equals_one_window(spark):
    import random

    r = random.Random(3)
    rows = [(DAY + timedelta(hours=r.randrange(40_000)), r.choice([None, None, float(k)]), r.choice([None, k])) for k in range(400)]
    rows = list({t: (t, a, b) for t, a, b in rows}.values()) + [(None, 5.0, None)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, x double, y long")
    got = {row.ts: (row.x, row.y) for row in cleaning.ffill(df, ["x", "y"]).collect()}
    last = (5.0, None)  # rows without a time come first
    for t, a, b in sorted(rows, key=lambda v: (v[0] is not None, v[0] or DAY)):
        last = tuple(new if new is not None else old for new, old in zip((a, b), last))
        assert got[t] == last


def test_labels_and_sheet_names():
    from touchline.config import Node
    from touchline.operators.surface import feature_label, sheet_names

    assert feature_label(Node("a", "roc", {"period": 5})) == "roc(period=5)" and feature_label(Node("a", "constant")) == "constant"
    names = sheet_names(["x" * 40, "x" * 40, "a/b:c", "", "X" * 40])
    assert len({n.lower() for n in names}) == 5 and all(0 < len(n) <= 31 and not set(n) & set("[]:*?/\\") for n in names)


def test_manifests_and_digests(spark, tmp_path):
    df = spark.range(10).selectExpr("id", "cast(id as string) as s")
    assert content_digest(df) == content_digest(df.repartition(3).orderBy("s")) != content_digest(df.where("id < 9"))
    store = Store(spark, str(tmp_path))
    store.write("01_surface", "a", df.withColumnRenamed("id", "hits"))
    assert "n_hit" in store.read("01_surface", "a").columns and store.manifest("01_surface") == {}
    (tmp_path / "01_surface/manifest.json").write_text("{broken")
    assert store.manifest("01_surface") == {} and store.drop_stale("01_surface", set()) == ["a"]


def test_history_id_ignores_auxiliary_columns(spark, sf_dir):
    bars = bars_daily(spark, sf_dir)
    assert history_id(bars) == history_id(bars.withColumn("vix", F.lit(1.0)))


def test_command_line(spark, sf_dir, tmp_path, capsys):
    from touchline.cli import main, parser

    bars_daily(spark, sf_dir).write.parquet(f"{tmp_path}/bars")
    (tmp_path / "w.json").write_text(json.dumps(DECLARED))
    common = ["--workspace", f"{tmp_path}/w.json", "--bars", f"{tmp_path}/bars", "--store", f"{tmp_path}/out"]
    main(["measure", *common])
    assert "rows" in capsys.readouterr().out and (tmp_path / "out/01_surface/surface.parquet").exists()
    main(["compare", "--thin", "--workspace", f"{tmp_path}/w.json", "--store", f"{tmp_path}/out"])  # from the kept history
    assert "rows" in capsys.readouterr().out
    for bad in (["compare", "--fdr", *common], ["nope"], []):
        with pytest.raises(SystemExit):
            parser().parse_args(bad)


def test_streamed_bars_equal_batch_bars(spark, sf_dir, tmp_path):
    prices = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", F.col("event_id").alias("key"), F.col("value").alias("price"))
    want = sorted(map(tuple, stream_bars(prices).collect()))
    prices.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(prices.schema).parquet(f"{tmp_path}/in")
    q = stream_bars(stream).writeStream.format("memory").queryName("bars").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("bars").collect())) == want


def test_indexed(spark):
    rows = spark.createDataFrame(good(), FEED)
    assert [r.bar_idx for r in indexed(rows, "x").orderBy("ts").collect()] == [0, 1, 2]


def test_nothing_outside_imports_the_llm_subpackage():
    root = Path(__file__).resolve().parents[1] / "touchline"
    for file in root.rglob("*.py"):
        if "llm" in file.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(file.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any("llm" in n.split(".") for n in names), file
