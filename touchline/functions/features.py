"""The feature registry: each feature is a column expression over window primitives.

A feature names the primitives that it needs; all primitives of all requested features are
computed in one projection per stage over one window specification, so a panel is sorted
once and equal primitives are computed once.  Stages: fills and exponential averages of the panel's
columns (only where asked for); bar-wise columns (previous close, gains, losses, log returns, true
range), windows over them, then windows over features, all within chunks and their halos; exponential
averages of features.

Features that can be computed on any price path are ``core``; the others (calendar,
external series) are fixed and are carried to simulated paths from the observed one.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import OHLCV, Node
from ..shared import materialise
from .windows import BY, chunked, exponential, filled, lag, own_rows, trailing

#: Event days of the supply cycle: four past ones and the expected next one (fixed values).
CYCLE_DATES = (date(2012, 11, 28), date(2016, 7, 9), date(2020, 5, 11), date(2024, 4, 20))
NEXT_CYCLE_DATE = date(2028, 4, 20)
BATCH = 24  # window columns that one projection computes
ROUND = 9  # places of stored values: ties and edges do not hang on the order of summation


class Stage:
    """Collects the primitives that features ask for, one column each."""

    def __init__(self):
        self.rolling: dict[str, Column] = {}
        self.second: dict[str, Column] = {}
        self.emas: dict[str, tuple[str, int]] = {}
        self.second_base: dict[str, Column] = {}
        self.fills: dict[str, str] = {}
        self.reach = [0, 0]  # bars before the present one that the windows of either stage look at

    def _reaches(self, stage: int, n: int) -> None:
        self.reach[stage] = max(self.reach[stage], n)

    def roll(self, kind: str, column: str, n: int) -> Column:
        name = f"__{kind}_{column.strip('_')}_{n}"
        self.rolling.setdefault(name, trailing(kind, column, n))
        self._reaches(0, n)
        return F.col(name)

    def lag(self, column: str, n: int) -> Column:
        name = f"__lag_{column}_{n}"
        self.rolling.setdefault(name, lag(column, n))
        self._reaches(0, n)
        return F.col(name)

    def ffill(self, column: str, kind: str = "level", n: int = 0) -> Column:
        """A forward-filled external column, or a window over it."""
        base = f"__ff_{column}"
        self.fills[column] = base
        if kind == "level":
            return F.col(base)
        name = f"{base}_{kind}_{n}"
        self.second.setdefault(name, trailing("mean", base, n) if kind == "mean" else lag(base, n))
        self._reaches(1, n)
        return F.col(name)

    def ema(self, column: str, span: int) -> Column:
        name = f"__ema_{column.strip('_')}_{span}"
        self.emas[name] = (column, span)
        return F.col(name)

    def over(self, name: str, base: Column, kind: str, n: int) -> Column:
        """A window over a column that is itself made of windows."""
        self.second_base.setdefault(name, base)
        own = f"{name}_{kind}_{n}"
        self.second.setdefault(own, trailing(kind, name, n))
        self._reaches(1, n)
        return F.col(own)


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


Builder = Callable[[Stage, dict], Column]
ArrayFunction = Callable[[dict[str, np.ndarray], dict], np.ndarray]


@dataclass(frozen=True)
class FeatureDef:
    name: str
    build: Builder | ArrayFunction
    core: bool
    needs: tuple[str, ...] = ()
    version: str = ""  # kept results of other versions are not used
    whole: bool = False  # build(table, params) takes a path's columns as arrays and returns one


def _int(p: dict, name: str, default: int | None = None) -> int:
    value = p.get(name, default)
    if value is None:
        raise ValueError(f"parameter {name} is missing")
    return int(value)


def _ma_ratio(s: Stage, p: dict) -> Column:
    return ratio(F.col("close"), s.roll("mean", "close", _int(p, "period"))) - 1


def _ma_cross(s: Stage, p: dict) -> Column:
    return ratio(s.roll("mean", "close", _int(p, "fast")), s.roll("mean", "close", _int(p, "slow"))) - 1


def _roc(s: Stage, n: int) -> Column:
    return ratio(F.col("close"), s.lag("close", n)) - 1


def _drawdown(s: Stage, n: int) -> Column:
    return ratio(F.col("close"), s.roll("max", "close", n)) - 1


def _rsi(s: Stage, n: int) -> Column:
    """100 when there were gains and no losses, NULL when there was neither."""
    gain, loss = s.roll("mean", "__gain", n), s.roll("mean", "__loss", n)
    return F.when((loss == 0) & (gain > 0), F.lit(100.0)).otherwise(F.lit(100.0) - F.try_divide(F.lit(100.0), 1 + ratio(gain, loss)))


def _macd(s: Stage, p: dict) -> Column:
    return ratio(s.ema("close", _int(p, "fast")) - s.ema("close", _int(p, "slow")), F.col("close"))


def _macd_histogram(s: Stage, p: dict) -> Column:
    name = f"__macd_{_int(p, 'fast')}_{_int(p, 'slow')}"
    s.second_base[name] = _macd(s, p)
    return F.col(name) - s.ema(name, _int(p, "signal", 9))


def _band(s: Stage, p: dict) -> tuple[Column, Column, float]:
    n = _int(p, "period")
    return s.roll("mean", "close", n), s.roll("std", "close", n), float(p.get("std_dev", 2))


def _bb_pct(s: Stage, p: dict) -> Column:
    mean, std, k = _band(s, p)
    return ratio(F.col("close") - (mean - k * std), 2 * k * std)


def _bb_width(s: Stage, p: dict) -> Column:
    mean, std, k = _band(s, p)
    return ratio(2 * k * std, mean)


def _stoch_k(s: Stage, n: int) -> Column:
    low = s.roll("min", "low", n)
    return ratio(100 * (F.col("close") - low), s.roll("max", "high", n) - low)


def _stoch_d(s: Stage, p: dict) -> Column:
    k = _int(p, "k_period")
    return s.over(f"__stoch_{k}", _stoch_k(s, k), "mean", _int(p, "d_period", 3))


def _williams(s: Stage, n: int) -> Column:
    high = s.roll("max", "high", n)
    return ratio(F.col("close") - high, high - s.roll("min", "low", n)) + 1


def _level(column: str) -> Builder:
    return lambda s, p: s.ffill(column)


def _aux_ma(column: str) -> Builder:
    return lambda s, p: ratio(s.ffill(column), s.ffill(column, "mean", _int(p, "period"))) - 1


def _aux_ret(column: str) -> Builder:
    return lambda s, p: ratio(s.ffill(column), s.ffill(column, "lag", _int(p, "period"))) - 1


def _log_ratio(column: str) -> Builder:
    def build(s: Stage, p: dict) -> Column:
        name = f"__ln_{column}"
        base = F.when(F.col(column) > 0, F.ln(column))
        return ratio(base, s.over(name, base, "mean", _int(p, "period"))) - 1

    return build


def _days(dates: tuple[date, ...]) -> Column:
    return F.array(*[F.lit(d) for d in dates])


def _cycle_phase(s: Stage, p: dict) -> Column:
    """Share of the time between the last and the next event; before the first one it counts down from it."""
    dates, day = _days((*CYCLE_DATES, NEXT_CYCLE_DATE)), F.to_date("ts")
    last = F.coalesce(F.array_max(F.filter(dates, lambda d: d <= day)), F.lit(CYCLE_DATES[0]))
    following = F.coalesce(F.array_min(F.filter(dates, lambda d: d > day)), F.lit(NEXT_CYCLE_DATE))
    return F.datediff(day, last) / F.greatest(F.datediff(following, last), F.lit(1)).cast("double")


def _days_to(s: Stage, p: dict) -> Column:
    dates, day = _days((*CYCLE_DATES, NEXT_CYCLE_DATE)), F.to_date("ts")
    following = F.coalesce(F.array_min(F.filter(dates, lambda d: d > day)), F.lit(NEXT_CYCLE_DATE))
    return F.greatest(F.datediff(following, day), F.lit(0)).cast("double")


def _days_since(s: Stage, p: dict) -> Column:
    day = F.to_date("ts")
    last = F.coalesce(F.array_max(F.filter(_days(CYCLE_DATES), lambda d: d <= day)), F.lit(CYCLE_DATES[0]))
    return F.greatest(F.datediff(day, last), F.lit(0)).cast("double")


_CORE: dict[str, Builder] = {
    "constant": lambda s, p: F.lit(0.0),
    "ma_ratio": _ma_ratio,
    "ma_cross": _ma_cross,
    "roc": lambda s, p: _roc(s, _int(p, "period")),
    "roc_spread": lambda s, p: _roc(s, _int(p, "fast")) - _roc(s, _int(p, "slow")),
    "drawdown": lambda s, p: _drawdown(s, _int(p, "period")),
    "drawdown_recovery": lambda s, p: _drawdown(s, _int(p, "short")) - _drawdown(s, _int(p, "long")),
    "rsi": lambda s, p: _rsi(s, _int(p, "period")),
    "rsi_spread": lambda s, p: _rsi(s, _int(p, "fast")) - _rsi(s, _int(p, "slow")),
    "macd": _macd,
    "macd_histogram": _macd_histogram,
    "realized_vol": lambda s, p: s.roll("std", "__ret", _int(p, "period")) * F.sqrt(F.lit(252.0)) * 100,
    "vol_ratio": lambda s, p: ratio(s.roll("std", "__ret", _int(p, "fast")), s.roll("std", "__ret", _int(p, "slow"))),
    "atr": lambda s, p: ratio(s.roll("mean", "__range", _int(p, "period")), F.col("close")),
    "bb_pct": _bb_pct,
    "bb_width": _bb_width,
    "volume_ratio": lambda s, p: ratio(F.col("volume"), s.roll("mean", "volume", _int(p, "period"))),
    "stoch_k": lambda s, p: _stoch_k(s, _int(p, "k_period")),
    "stoch_d": _stoch_d,
    "williams_r": lambda s, p: _williams(s, _int(p, "period")),
    "wr_spread": lambda s, p: _williams(s, _int(p, "fast")) - _williams(s, _int(p, "slow")),
}
_FIXED: dict[str, tuple[Builder, tuple[str, ...]]] = {
    "vix_level": (_level("vix"), ("vix",)),
    "vix_ma_ratio": (_aux_ma("vix"), ("vix",)),
    "vix_ret": (_aux_ret("vix"), ("vix",)),
    "tnx_level": (_level("tnx"), ("tnx",)),
    "tnx_ma_ratio": (_aux_ma("tnx"), ("tnx",)),
    "tnx_ret": (_aux_ret("tnx"), ("tnx",)),
    "dxy_ma_ratio": (_aux_ma("dxy"), ("dxy",)),
    "dxy_ret": (_aux_ret("dxy"), ("dxy",)),
    "day_of_week": (lambda s, p: F.weekday("ts").cast("double"), ()),
}
_CHAIN: dict[str, tuple[Builder, tuple[str, ...]]] = {
    "mvrv": (lambda s, p: F.col("mvrv"), ("mvrv",)),
    "hash_rate_ma_ratio": (_log_ratio("hash_rate"), ("hash_rate",)),
    "adr_act_ma_ratio": (_log_ratio("adr_act_cnt"), ("adr_act_cnt",)),
    "cycle_phase": (_cycle_phase, ()),
    "days_to_halving": (_days_to, ()),
    "days_since_halving": (_days_since, ()),
}


class FeatureRegistry:
    """Features by name; studies may register more."""

    def __init__(self):
        self.defs: dict[str, FeatureDef] = {n: FeatureDef(n, b, True) for n, b in _CORE.items()}
        self.defs |= {n: FeatureDef(n, b, False, needs) for n, (b, needs) in _FIXED.items()}

    def register(self, name: str, build: Builder, core: bool = False, needs: tuple[str, ...] = (), version: str = "") -> None:
        """``build(stage, params)`` returns a column; only core features are recomputed on simulated paths."""
        self.defs[name] = FeatureDef(name, build, core, needs, version)

    def register_array(self, name: str, function: ArrayFunction, core: bool = False, needs: tuple[str, ...] = (), version: str = "") -> None:
        """``function(columns, params)`` takes a whole path's columns by name as numpy arrays in the order of bars, and returns one value a bar.

        Columns are ts, open, high, low, close, volume and ``needs``; prices are doubles, NaN where missing.  What it returns
        is NULL where it is not finite.  It runs in Python on executors, one path a task at a time; where a
        column expression can say the same, ``register`` is faster.
        """
        self.defs[name] = FeatureDef(name, function, core, needs, version, whole=True)

    def get(self, name: str) -> FeatureDef:
        if name not in self.defs:
            raise ValueError(f"unknown feature {name!r}; there are {', '.join(sorted(self.defs))}")
        return self.defs[name]

    def load_plugin(self, path: str | Path) -> None:
        """Runs a file's ``register(registry)`` in a module of its own."""
        path = Path(path).resolve()
        spec = importlib.util.spec_from_file_location(f"touchline_plugin_{abs(hash(str(path)))}", path)
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        if not callable(getattr(module, "register", None)):
            raise ValueError(f"{path} has no register(registry)")
        module.register(self)


def register_chain_features(registry: FeatureRegistry) -> None:
    """Features of on-chain metrics and of the supply cycle."""
    for name, (build, needs) in _CHAIN.items():
        registry.register(name, build, False, needs)


def default_registry() -> FeatureRegistry:
    out = FeatureRegistry()
    register_chain_features(out)
    return out


def _arrays(panel: DataFrame, nodes: dict[str, Node], registry: FeatureRegistry) -> DataFrame:
    """(history_id, rep_id, bar_idx, one column per node, named by its key): array functions, grouped by path; only the columns that they need are sent."""
    needed = sorted({c for n in nodes.values() for c in registry.get(n.feature).needs} | ({"ts", *OHLCV} & set(panel.columns)))
    calls = [(column, n.id, registry.get(n.feature).build, dict(n.params), registry.get(n.feature).needs) for column, n in nodes.items()]
    kinds = dict(panel.dtypes)

    def run(path: pa.Table) -> pa.Table:
        path = path.sort_by("bar_idx")
        columns = {c: path.column(c).to_numpy() for c in needed}
        columns = {c: v if kinds[c] in ("timestamp_ntz", "timestamp", "date", "string") else v.astype(float) for c, v in columns.items()}
        out = path.select([*BY, "bar_idx"])
        for column, node_id, function, params, own in calls:
            given = {c: columns[c].copy() for c in columns if c in own or c in ("ts", *OHLCV)}
            got = np.asarray(function(given, dict(params)), float)
            if got.shape != (path.num_rows,):
                raise ValueError(f"node {node_id}: {got.shape} values for {path.num_rows} bars")
            out = out.append_column(column, pa.array(got, mask=~np.isfinite(got)))
        return out

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*BY, "bar_idx")) + "".join(f", {column} double" for column in nodes)
    return panel.select(*BY, "bar_idx", *needed).groupBy(*BY).applyInArrow(run, schema)


def wide_features(panel: DataFrame, nodes: list[Node], registry: FeatureRegistry) -> DataFrame:
    """The panel with one column per node, rounded to ROUND places."""
    return _valued(panel, nodes, registry).select(*panel.columns, *[F.col(_value(k)).alias(n.id) for k, n in enumerate(nodes)])


def _value(k: int) -> str:
    """The column of the k-th node: ids may be names that the panel has."""
    return f"__value{k}"


def _valued(panel: DataFrame, nodes: list[Node], registry: FeatureRegistry) -> DataFrame:
    stage = Stage()
    for n in nodes:
        lacking = [c for c in registry.get(n.feature).needs if c not in panel.columns]
        if lacking:
            raise ValueError(f"node {n.id} needs the columns {', '.join(lacking)}")
    whole = {_value(k): n for k, n in enumerate(nodes) if registry.get(n.feature).whole}
    values = {_value(k): registry.get(n.feature).build(stage, n.params) for k, n in enumerate(nodes) if _value(k) not in whole}
    first = {n: e for n, e in stage.emas.items() if e[0] in panel.columns}
    later = {n: e for n, e in stage.emas.items() if n not in first}
    df = filled(panel, stage.fills) if stage.fills else panel
    if first:
        df = exponential(df, first)
    if stage.rolling or stage.second or stage.second_base:
        # a window over changes from bar to bar looks one bar further back
        df = chunked(df, back=1 + sum(stage.reach))
        df = df.withColumn("__before", lag("close")).withColumn("__prev", F.coalesce("__before", "close"))
        df = df.withColumns({
            "__gain": F.greatest(F.col("close") - F.col("__prev"), F.lit(0.0)), "__loss": F.greatest(F.col("__prev") - F.col("close"), F.lit(0.0)),
            "__ret": F.ln(ratio(F.col("close"), F.col("__before"))),
            "__range": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("__prev")), F.abs(F.col("low") - F.col("__prev"))),
        })
        for columns in (stage.rolling, stage.second_base, stage.second):
            df = df.withColumns(columns) if columns else df
        df = own_rows(df)
    if later:
        df = exponential(df, later)
    df = df.select(*panel.columns, *[F.round(v, ROUND).alias(k) for k, v in values.items()])
    if whole:
        own = _arrays(panel, whole, registry).select(*BY, "bar_idx", *[F.round(c, ROUND).alias(c) for c in whole])
        df = df.join(own, [*BY, "bar_idx"])
    return df


def long_features(panel: DataFrame, nodes: list[Node], registry: FeatureRegistry) -> DataFrame:
    """(history_id, rep_id, node_id, bar_idx, value): one wide projection, then an unpivot."""
    wide = _valued(panel, nodes, registry)
    pairs = F.array(*[F.struct(F.lit(n.id).alias("node_id"), F.col(_value(k)).cast("double").alias("value")) for k, n in enumerate(nodes)])
    return wide.select(*BY, "bar_idx", F.explode(pairs).alias("x")).select(*BY, "x.node_id", "bar_idx", "x.value")


def node_batches(nodes: list[Node], registry: FeatureRegistry, most: int = BATCH) -> list[list[Node]]:
    """Nodes in batches that need at most ``most`` different window columns each (a node alone may need more).

    Nodes go to the batch that holds most of what they need, so those that share columns share a batch.
    """
    batches: list[tuple[set[str], list[Node]]] = []
    for n in nodes:
        stage = Stage()
        if not registry.get(n.feature).whole:
            registry.get(n.feature).build(stage, n.params)
        own = {*stage.rolling, *stage.second, *stage.emas}
        fitting = [b for b in batches if len(b[0] | own) <= most]
        if fitting:
            best = max(fitting, key=lambda b: len(b[0] & own))
            best[0].update(own)
            best[1].append(n)
        else:
            batches.append((own, [n]))
    return [members for _, members in batches]


def kept_features(panel: DataFrame, nodes: list[Node], registry: FeatureRegistry) -> DataFrame:
    """``long_features`` of any number of nodes, written batch by batch: several steps read them, and no plan grows with the nodes."""
    parts = [materialise(long_features(panel, own, registry), "features") for own in node_batches(nodes, registry)]
    return reduce(DataFrame.unionByName, parts)
