"""SQL for DuckDB that computes each query's rows another way: chained CTEs over the given tables."""

from __future__ import annotations

from ..config import DEFAULT_GRID
from .catalogue import catalogue_nodes
from .queries import CATALOGUE_BINS, FILTER_BIN_N, GRID, MIN_DEV, MIN_RUN, N_BINS, REPLICATES

SEED = 20260907


def _bars(name: str, table: str, ts: str, key: str, amount: str, unit: str, k: float, n0: float) -> str:
    return f"""
{name}_rows AS (SELECT date_trunc('{unit}', {ts})::TIMESTAMP AS b, {ts} AS t, {key} AS key, CAST(round({amount} * 100) AS BIGINT) AS c FROM {table}),
{name}_all AS (SELECT CAST(sum(c) AS DOUBLE) AS mc, CAST(count(*) AS DOUBLE) AS n FROM {name}_rows),
{name}_run AS (SELECT b, t, key, CAST(sum(c) OVER w AS DOUBLE) AS s, CAST(count(*) OVER w AS DOUBLE) AS m FROM {name}_rows WINDOW w AS (ORDER BY t, key ROWS UNBOUNDED PRECEDING)),
{name}_p AS (SELECT b, t, key, CAST(round(CAST(10000 AS DOUBLE) * (CAST(100 AS DOUBLE) * exp(CAST({k} AS DOUBLE) * sqrt(CAST({n0} AS DOUBLE) / n) * (s * n / mc - m)))) AS BIGINT) / CAST(10000 AS DOUBLE) AS p FROM {name}_run, {name}_all),
{name}_g AS (SELECT b AS ts, arg_min(p, (t, key)) AS open, max(p) AS high, min(p) AS low, arg_max(p, (t, key)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM {name}_p GROUP BY b),
{name} AS (SELECT 0 AS rep_id, row_number() OVER (ORDER BY ts) - 1 AS bar_idx, * FROM {name}_g)"""


DAILY = _bars("bars", "orders", "o_orderdate", "o_orderkey", "o_totalprice", "day", 0.01, 15000.0)
HOURLY = _bars("bars", "events", "ts", "event_id", "value", "hour", 0.004, 10000.0)
AUX = """
aux AS (SELECT l_shipdate AS ts, sum(l_quantity) / count(*) AS vix, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) AS tnx,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS dxy FROM lineitem WHERE day(l_shipdate) % 7 <> 0 GROUP BY l_shipdate),
panel AS (SELECT bars.*, aux.vix, aux.tnx, aux.dxy FROM bars ASOF LEFT JOIN aux ON bars.ts >= aux.ts)"""
MESSY = """
messy AS (SELECT ts, open, high, low, close, volume, bar_idx AS arrival FROM bars UNION ALL
  SELECT ts, open, high, low, close, CASE WHEN bar_idx % 10 = 0 THEN NULL ELSE volume + 1 END, bar_idx + 1000000 FROM bars WHERE bar_idx % 5 = 0),
last_rows AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY arrival DESC) AS k FROM messy) WHERE k = 1)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(p.strip() for p in parts)


def roll(f: str, x: str, n: int) -> str:
    w = f"(PARTITION BY rep_id ORDER BY bar_idx ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN count({x}) OVER {w} = {n} THEN {f}({x}) OVER {w} END)"


def back(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY rep_id ORDER BY bar_idx)"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


#: Bar-wise columns that features build on.
BASE = f"""
prev AS (SELECT *, coalesce({back("close")}, close) AS prv, {back("close")} AS bef FROM %s),
base AS (SELECT *, greatest(close - prv, 0.0) AS gain, greatest(prv - close, 0.0) AS loss, ln({div("close", "bef")}) AS ret,
  greatest(high - low, abs(high - prv), abs(low - prv)) AS rng FROM prev)"""


def rsi(n: int) -> str:
    g, d = roll("avg", "gain", n), roll("avg", "loss", n)
    return f"(CASE WHEN {d} = 0 AND {g} > 0 THEN 100.0 ELSE 100.0 - 100.0 / nullif(1 + {div(g, d)}, 0) END)"


def roc(n: int) -> str:
    return f"({div('close', back('close', n))} - 1)"


def drawdown(n: int) -> str:
    return f"({div('close', roll('max', 'close', n))} - 1)"


def stoch(n: int) -> str:
    return div(f"100 * (close - {roll('min', 'low', n)})", f"({roll('max', 'high', n)} - {roll('min', 'low', n)})")


def williams(n: int) -> str:
    return f"({div('close - ' + roll('max', 'high', n), '(' + roll('max', 'high', n) + ' - ' + roll('min', 'low', n) + ')')} + 1)"


_M, _S = roll("avg", "close", 20), roll("stddev_samp", "close", 20)
_DATES = "[DATE '2012-11-28', DATE '2016-07-09', DATE '2020-05-11', DATE '2024-04-20', DATE '2028-04-20']"
_NEXT = f"coalesce(list_min(list_filter({_DATES}, lambda d: d > ts::DATE)), DATE '2028-04-20')"
_LAST = f"coalesce(list_max(list_filter({_DATES}, lambda d: d <= ts::DATE)), DATE '2012-11-28')"
_PAST = f"coalesce(list_max(list_filter({_DATES}[1:4], lambda d: d <= ts::DATE)), DATE '2012-11-28')"

#: Features as one expression over ``base``.
ONE_STEP = {
    "constant": "0.0",
    "ma_ratio": f"{div('close', roll('avg', 'close', 20))} - 1",
    "ma_cross": f"{div(roll('avg', 'close', 10), roll('avg', 'close', 50))} - 1",
    "roc": roc(5),
    "roc_spread": f"{roc(5)} - {roc(20)}",
    "drawdown": drawdown(50),
    "drawdown_recovery": f"{drawdown(20)} - {drawdown(50)}",
    "rsi": rsi(14),
    "rsi_spread": f"{rsi(7)} - {rsi(14)}",
    "realized_vol": f"{roll('stddev_samp', 'ret', 20)} * sqrt(252.0) * 100",
    "vol_ratio": div(roll("stddev_samp", "ret", 10), roll("stddev_samp", "ret", 50)),
    "atr": div(roll("avg", "rng", 14), "close"),
    "bb_pct": div(f"close - ({_M} - 2 * {_S})", f"(4 * {_S})"),
    "bb_width": div(f"4 * {_S}", _M),
    "volume_ratio": div("volume", roll("avg", "volume", 20)),
    "stoch_k": stoch(14),
    "williams_r": williams(14),
    "wr_spread": f"{williams(7)} - {williams(28)}",
    "day_of_week": "isodow(ts) - 1",
    "mvrv": "vix / 25",
    "cycle_phase": f"date_diff('day', {_LAST}, ts::DATE) / greatest(date_diff('day', {_LAST}, {_NEXT}), 1)",
    "days_to_halving": f"greatest(date_diff('day', ts::DATE, {_NEXT}), 0)",
    "days_since_halving": f"greatest(date_diff('day', {_PAST}, ts::DATE), 0)",
}
#: Features over a column that is filled or made first: (column, expression).
TWO_STEP = {
    **{f"{c}_level": (f"last_value({c} IGNORE NULLS) OVER (ORDER BY bar_idx)", "x") for c in ("vix", "tnx")},
    **{f"{c}_ma_ratio": (f"last_value({c} IGNORE NULLS) OVER (ORDER BY bar_idx)", f"{div('x', roll('avg', 'x', 20))} - 1") for c in ("vix", "tnx", "dxy")},
    **{f"{c}_ret": (f"last_value({c} IGNORE NULLS) OVER (ORDER BY bar_idx)", f"{div('x', back('x', 5))} - 1") for c in ("vix", "tnx", "dxy")},
    "hash_rate_ma_ratio": ("CASE WHEN dxy > 0 THEN ln(dxy) END", f"{div('x', roll('avg', 'x', 20))} - 1"),
    "adr_act_ma_ratio": ("CASE WHEN vix * 100 > 0 THEN ln(vix * 100) END", f"{div('x', roll('avg', 'x', 20))} - 1"),
    "stoch_d": (stoch(14), roll("avg", "x", 3)),
}


def _feature(name: str) -> str:
    head = _with(DAILY, AUX, BASE % "panel")
    if name in ONE_STEP:
        return f"{head} SELECT bar_idx, round(CAST({ONE_STEP[name]} AS DOUBLE), 9) AS value FROM base"
    column, value = TWO_STEP[name]
    return f"{head}, two AS (SELECT *, CAST({column} AS DOUBLE) AS x FROM base) SELECT bar_idx, round({value}, 9) AS value FROM two"


_EMA = """
ema AS (SELECT bar_idx, close, close AS f, close AS s FROM bars WHERE bar_idx = 0 UNION ALL
  SELECT b.bar_idx, b.close, 2.0 / 13.0 * b.close + (1.0 - 2.0 / 13.0) * e.f, 2.0 / 27.0 * b.close + (1.0 - 2.0 / 27.0) * e.s FROM ema e JOIN bars b ON b.bar_idx = e.bar_idx + 1)"""
_SIGNAL = """
line AS (SELECT bar_idx, (f - s) / close AS x FROM ema),
sig AS (SELECT bar_idx, x, x AS y FROM line WHERE bar_idx = 0 UNION ALL
  SELECT l.bar_idx, l.x, 2.0 / 10.0 * l.x + (1.0 - 2.0 / 10.0) * g.y FROM sig g JOIN line l ON l.bar_idx = g.bar_idx + 1)"""


def _recursive(*parts: str) -> str:
    return _with(*parts).replace("WITH", "WITH RECURSIVE", 1)


def _extremes(table: str, horizons: tuple[int, ...], out: str = "exc") -> str:
    w = "(PARTITION BY rep_id ORDER BY bar_idx ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    each = " UNION ALL ".join(
        f"SELECT rep_id, bar_idx, {h} AS horizon, CASE WHEN count(low) OVER w{h} = {h} THEN min(low) OVER w{h} END / close - 1 AS down, "
        f"CASE WHEN count(high) OVER w{h} = {h} THEN max(high) OVER w{h} END / close - 1 AS up FROM {table} WINDOW w{h} AS {w.format(h=h)}"
        for h in horizons
    )
    return f"{out} AS ({each})"


BARRIERS = "barriers AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, CAST({b} AS DOUBLE))" for k, b in enumerate(GRID.barriers)) + ") AS v(barrier_idx, barrier))"
TOUCH = "CASE WHEN barrier < 0 THEN down <= barrier ELSE up >= barrier END"
_LIST = ", ".join(f"CAST({j} AS DOUBLE) / {N_BINS}" for j in range(1, N_BINS))


def _values(table: str = "base") -> str:
    def node(name: str, expression: str) -> str:
        return f"SELECT rep_id, '{name}' AS node_id, bar_idx, round(CAST({expression} AS DOUBLE), 9) AS value FROM {table}"

    return "vals AS (" + " UNION ALL ".join([node("roc_5", roc(5)), node("rsi_14", rsi(14)), node("weekday", "isodow(ts) - 1")]) + ")"


def _measure(n_bins: int = N_BINS, top: float = max(GRID.barriers)) -> str:
    cuts = ", ".join(f"CAST({j} AS DOUBLE) / {n_bins}" for j in range(1, n_bins))
    return f"""
q AS (SELECT rep_id, node_id, quantile_cont(value, [{cuts}]) AS q, min(value) AS low, max(value) AS high FROM vals WHERE value IS NOT NULL GROUP BY ALL),
edges AS (SELECT rep_id, node_id, list_sort(list_distinct(list_filter(list_transform(q, lambda e: round(e, 9)), lambda e: e > low AND e <= high))) AS edges FROM q),
bins AS (SELECT v.rep_id, v.node_id, v.bar_idx, v.value, CAST(len(list_filter(e.edges, lambda x: x < v.value)) AS INTEGER) AS bin FROM vals v JOIN edges e ON e.rep_id = v.rep_id AND e.node_id = v.node_id WHERE v.value IS NOT NULL),
known AS (SELECT * FROM exc WHERE down IS NOT NULL AND up IS NOT NULL),
baseline AS (SELECT rep_id, horizon, barrier_idx, barrier, count(*) AS n_obs, count_if({TOUCH}) AS n_hit FROM known, barriers GROUP BY ALL),
surface AS (SELECT b.rep_id, node_id, bin, horizon, barrier_idx, barrier, count(*) AS n_obs, count_if({TOUCH}) AS n_hit FROM bins b JOIN known k ON k.rep_id = b.rep_id AND k.bar_idx = b.bar_idx, barriers GROUP BY ALL),
base_rate AS (SELECT *, CASE WHEN n_obs >= 30 THEN CAST(n_hit AS DOUBLE) / n_obs END AS p FROM baseline),
rate AS (SELECT *, CASE WHEN n_obs >= 30 THEN CAST(n_hit AS DOUBLE) / n_obs END AS p FROM surface),
shifts AS (SELECT r.*, b.p AS base_p, r.p - b.p AS shift FROM rate r JOIN base_rate b ON b.rep_id = r.rep_id AND b.horizon = r.horizon AND b.barrier_idx = r.barrier_idx),
pairs AS (SELECT u.rep_id, u.node_id, u.bin, u.horizon, u.barrier AS d, abs(u.shift - d.shift) AS diff, u.n_obs FROM shifts u JOIN shifts d ON d.rep_id = u.rep_id AND d.node_id = u.node_id AND d.bin = u.bin AND d.horizon = u.horizon AND d.barrier = -u.barrier WHERE u.barrier > 0),
usable AS (SELECT *, diff IS NOT NULL AND n_obs >= 30 AS ok FROM pairs),
counted AS (SELECT *, ok AND count_if(ok) OVER (PARTITION BY rep_id, node_id, horizon, d) >= 2 AS good FROM usable),
scores AS (SELECT rep_id, node_id, bin, round(sum(CASE WHEN good THEN diff * (d / {top}) ELSE 0.0 END), 9) AS score, bool_or(good) AS supported FROM counted GROUP BY ALL)"""

MEASURE = _measure()
MEASURED = _with(DAILY, BASE % "bars", _values(), _extremes("bars", GRID.horizons), BARRIERS, MEASURE)

FILTER = f"""
signs AS (SELECT *, CASE WHEN abs(shift) >= {MIN_DEV} THEN sign(shift) END AS sg FROM shifts WHERE n_obs >= {FILTER_BIN_N}),
breaks AS (SELECT *, CASE WHEN sg IS NULL OR (lag(sg) OVER w) IS DISTINCT FROM sg THEN 1 ELSE 0 END AS fresh FROM signs WINDOW w AS (PARTITION BY node_id, bin, horizon ORDER BY barrier_idx)),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY node_id, bin, horizon ORDER BY barrier_idx) AS island FROM breaks),
placed AS (SELECT *, row_number() OVER (PARTITION BY node_id, bin, horizon, island ORDER BY barrier_idx) AS place, count(*) OVER (PARTITION BY node_id, bin, horizon, island) AS size FROM islands WHERE sg IS NOT NULL),
best AS (SELECT node_id, horizon, bin, barrier, shift AS dev, CAST(greatest({MIN_RUN}, place) AS INTEGER) AS run, n_obs, n_hit FROM placed WHERE size >= {MIN_RUN}
  QUALIFY row_number() OVER (PARTITION BY node_id, horizon ORDER BY abs(shift) DESC, bin, barrier_idx) = 1),
top AS (SELECT node_id, horizon, bin, barrier, dev, run FROM best QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY abs(dev) DESC, horizon) = 1)"""

COMPONENTS = f"""
cb AS (SELECT *, coalesce({back("close")}, close) AS prv FROM bars),
comp AS (SELECT * FROM (SELECT bar_idx, ln(open / prv) AS g_open, ln(close / open) AS g_close, ln(high / greatest(open, close)) AS g_high, ln(low / least(open, close)) AS g_low FROM cb)
  WHERE g_open IS NOT NULL AND g_close IS NOT NULL AND g_high IS NOT NULL AND g_low IS NOT NULL)"""
_NAMES = ("g_open", "g_close", "g_high", "g_low")


def _fit() -> str:
    pairs = [(i, j) for i in range(4) for j in range(i + 1)]
    moments = [f"round(avg({c}), 12) AS m{i}" for i, c in enumerate(_NAMES)]
    moments += [f"round(covar_samp({_NAMES[i]}, {_NAMES[j]}), 15) AS s{i}{j}" for i, j in pairs]
    out = [f"f0 AS (SELECT {', '.join(moments)} FROM comp)", "f1 AS (SELECT *, 1e-12 * greatest(abs(s00), abs(s11), abs(s22), abs(s33), 1.0) AS jit FROM f0)"]
    at = 1
    for i, j in pairs:
        rest = " + ".join(["0.0", *[f"l{i}{k} * l{j}{k}" for k in range(j)]])
        value = f"sqrt(s{i}{i} + jit - ({rest}))" if i == j else f"(s{i}{j} - ({rest})) / nullif(l{j}{j}, 0)"
        out.append(f"f{at + 1} AS (SELECT *, {value} AS l{i}{j} FROM f{at})")
        at += 1
    out.append(f"fit AS (SELECT {', '.join(f'm{i}' for i in range(4))}, {', '.join(f'round(l{i}{j}, 12) AS l{i}{j}' for i, j in pairs)} FROM f{at})")
    return ",\n".join(out)


def _paths(replicates: int = REPLICATES) -> str:
    u = [f"(CAST(('0x' || substr(md5('{SEED}:' || rep_id || ':' || bar_idx || ':{k}'), 1, 13)) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0" for k in range(4)]
    z = [f"round(sqrt(-2.0 * ln({u[a]})) * {f}(2.0 * pi() * ({u[b]})), 12) AS z{k}" for k, (a, b, f) in enumerate(((0, 1, "cos"), (0, 1, "sin"), (2, 3, "cos"), (2, 3, "sin")))]
    g = [f"CAST(round(({' + '.join([f'm{i}', *[f'z{k} * l{i}{k}' for k in range(i + 1)]])}) * 1e12) AS BIGINT) AS g{i}" for i in range(4)]
    return f"""
n0 AS (SELECT r.rep_id::INTEGER AS rep_id, bar_idx, ts, volume FROM bars, (SELECT unnest(range(1, {replicates + 1})) AS rep_id) r),
n1 AS (SELECT *, {", ".join(z)} FROM n0),
n2 AS (SELECT n1.*, {", ".join(g)}, (SELECT close FROM bars WHERE bar_idx = 0) AS c0 FROM n1, fit),
n3 AS (SELECT *, c0 * exp(CAST(sum(g0 + g1) OVER (PARTITION BY rep_id ORDER BY bar_idx ROWS UNBOUNDED PRECEDING) AS DOUBLE) / 1e12) AS c FROM n2),
n4 AS (SELECT *, coalesce(lag(c) OVER (PARTITION BY rep_id ORDER BY bar_idx), c0) AS pv FROM n3),
n5 AS (SELECT *, pv * exp(g0 / 1e12) AS o FROM n4),
paths AS (SELECT rep_id, bar_idx, ts, round(o, 4) AS open, round(greatest(o, c) * exp(g2 / 1e12), 4) AS high, round(least(o, c) * exp(g3 / 1e12), 4) AS low, round(c, 4) AS close, volume FROM n5)"""


BOTH = "both_paths AS (SELECT rep_id, bar_idx, ts, open, high, low, close, volume FROM bars UNION ALL SELECT rep_id, bar_idx, ts, open, high, low, close, volume FROM paths)"


def _tests(threshold: float, replicates: int = REPLICATES) -> str:
    return f"""
obs AS (SELECT node_id, bin, score AS bin_score FROM scores WHERE rep_id = 0 AND supported),
null_all AS (SELECT o.node_id, o.bin, o.bin_score, r.rep_id, coalesce(CASE WHEN s.supported THEN s.score END, 0.0) AS score, coalesce(s.supported, false) AS sup
  FROM obs o CROSS JOIN (SELECT unnest(range(1, {replicates + 1})) AS rep_id) r LEFT JOIN scores s ON s.rep_id = r.rep_id AND s.node_id = o.node_id AND s.bin = o.bin),
tests AS (SELECT node_id, bin, bin_score, (1 + count_if(score >= bin_score)) / {1.0 + replicates} AS p, (1 + count_if(score >= bin_score)) / {1.0 + replicates} < {threshold} AS cleared,
  quantile_cont(score, 0.95) AS p95, count_if(sup) AS n_sup FROM null_all GROUP BY node_id, bin, bin_score)"""


def _ema_columns(spans: tuple[int, ...]) -> str:
    """Exponential averages of the close by recursion, e<span>."""
    first = ", ".join(f"close AS e{n}" for n in spans)
    following = ", ".join(f"2.0 / {n + 1}.0 * b.close + (1.0 - 2.0 / {n + 1}.0) * e.e{n}" for n in spans)
    return f"emas AS (SELECT bar_idx, {first} FROM bars WHERE bar_idx = 0 UNION ALL SELECT b.bar_idx, {following} FROM emas e JOIN bars b ON b.bar_idx = e.bar_idx + 1)"


def _catalogue_value(feature: str, p: dict) -> str:
    """A node's feature as an expression over ``wide``."""
    n, fast, slow = p.get("period"), p.get("fast"), p.get("slow")
    series = {"vix": "fvix", "tnx": "ftnx", "dxy": "fdxy"}.get(feature.split("_")[0])
    if series:
        return series if feature.endswith("level") else f"{div(series, roll('avg', series, n))} - 1" if feature.endswith("ratio") else f"{div(series, back(series, n))} - 1"
    mean, std = (roll(f, "close", n) for f in ("avg", "stddev_samp")) if n else ("", "")
    return {
        "constant": lambda: "0.0",
        "rsi": lambda: rsi(n),
        "rsi_spread": lambda: f"{rsi(fast)} - {rsi(slow)}",
        "williams_r": lambda: williams(n),
        "wr_spread": lambda: f"{williams(fast)} - {williams(slow)}",
        "stoch_k": lambda: stoch(p["k_period"]),
        "stoch_d": lambda: roll("avg", "st14", p["d_period"]),
        "roc": lambda: roc(n),
        "roc_spread": lambda: f"{roc(fast)} - {roc(slow)}",
        "ma_ratio": lambda: f"{div('close', mean)} - 1",
        "ma_cross": lambda: f"{div(roll('avg', 'close', fast), roll('avg', 'close', slow))} - 1",
        "macd": lambda: f"(e{fast} - e{slow}) / close",
        "macd_histogram": lambda: "x - y",
        "realized_vol": lambda: f"{roll('stddev_samp', 'ret', n)} * sqrt(252.0) * 100",
        "vol_ratio": lambda: div(roll("stddev_samp", "ret", fast), roll("stddev_samp", "ret", slow)),
        "atr": lambda: div(roll("avg", "rng", n), "close"),
        "bb_pct": lambda: div(f"close - ({mean} - 2 * {std})", f"(4 * {std})"),
        "bb_width": lambda: div(f"4 * {std}", mean),
        "volume_ratio": lambda: div("volume", roll("avg", "volume", n)),
        "drawdown": lambda: drawdown(n),
        "drawdown_recovery": lambda: f"{drawdown(p['short'])} - {drawdown(p['long'])}",
        "day_of_week": lambda: "isodow(ts) - 1",
    }[feature]()


def _catalogue() -> str:
    filled = ", ".join(f"last_value({c} IGNORE NULLS) OVER (ORDER BY bar_idx) AS f{c}" for c in ("vix", "tnx", "dxy"))
    nodes = " UNION ALL ".join(f"SELECT rep_id, '{n.id}' AS node_id, bar_idx, round(CAST({_catalogue_value(n.feature, n.params)} AS DOUBLE), 9) AS value FROM wide" for n in catalogue_nodes())
    barriers = "barriers AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, CAST({b} AS DOUBLE))" for k, b in enumerate(DEFAULT_GRID.barriers)) + ") AS v(barrier_idx, barrier))"
    return _recursive(
        DAILY, AUX, BASE % "panel", _ema_columns((9, 12, 21, 26)), "line AS (SELECT bar_idx, (e12 - e26) / close AS x FROM emas JOIN bars USING (bar_idx))",
        "sig AS (SELECT bar_idx, x, x AS y FROM line WHERE bar_idx = 0 UNION ALL SELECT l.bar_idx, l.x, 2.0 / 10.0 * l.x + (1.0 - 2.0 / 10.0) * g.y FROM sig g JOIN line l ON l.bar_idx = g.bar_idx + 1)",
        f"wide AS (SELECT base.*, {filled}, {stoch(14)} AS st14, e9, e12, e21, e26, x, y FROM base JOIN emas USING (bar_idx) JOIN sig USING (bar_idx))",
        f"vals AS ({nodes})", _extremes("bars", DEFAULT_GRID.horizons), barriers, _measure(CATALOGUE_BINS, max(DEFAULT_GRID.barriers)),
    ) + " SELECT node_id, bin, horizon, barrier_idx, n_obs, n_hit, round(shift, 9) AS shift FROM shifts"


_FOUND = "node_id, bin, round(bin_score, 6) AS bin_score, round(p, 9) AS monte_carlo_p_value, round(p95, 6) AS null_p95, n_sup AS n_supported_null FROM tests"


def _histories() -> str:
    """Each history alone, with its own nodes."""
    each = (("daily", DAILY, "('roc_5', 'weekday')"), ("hourly", HOURLY, "('rsi_14')"))
    return " UNION ALL ".join(f"SELECT * FROM ({_inference(0.05, bars)} SELECT '{name}' AS history_id, {_FOUND} WHERE node_id IN {nodes})" for name, bars, nodes in each)


def _inference(threshold: float, bars: str = DAILY, replicates: int = REPLICATES) -> str:
    return _with(bars, COMPONENTS, _fit(), _paths(replicates), BOTH, BASE % "both_paths", _values(), _extremes("both_paths", GRID.horizons), BARRIERS, MEASURE, _tests(threshold, replicates))


SELECTED = "chosen AS (SELECT row_number() OVER (ORDER BY p, bin_score DESC, node_id, bin) AS selection_number, node_id, bin, bin_score, p FROM tests WHERE cleared)"


def _pivot(value: str, places: int = 4, horizons: tuple[int, ...] = GRID.horizons, alias: str = "") -> str:
    return ", ".join(f"round(max(CASE WHEN {alias}horizon = {h} THEN {value} END), {places}) AS h{h}" for h in horizons)


_BODY = "greatest(open, close)"
_LEAST = "least(open, close)"
HISTOGRAM = """
h0 AS (SELECT node_id, bin, list_sort(list(score)) AS s, count(*) AS n, quantile_cont(score, 0.75) - quantile_cont(score, 0.25) AS iqr, min(score) AS lo, max(score) AS hi FROM null_all GROUP BY node_id, bin),
h1 AS (SELECT *, CAST(least(80, greatest(24, coalesce(ceil(round((hi - lo) / nullif(2.0 * iqr / cbrt(n), 0), 9)), 1))) AS INTEGER) AS n_bars FROM h0),
h2 AS (SELECT *, CASE WHEN hi = lo THEN lo - 0.5 ELSE lo END AS l0, CASE WHEN hi = lo THEN 1.0 / n_bars ELSE (hi - lo) / n_bars END AS step FROM h1),
h3 AS (SELECT node_id, bin, n_bars, l0, step, unnest(s) AS x FROM h2),
h4 AS (SELECT node_id, bin, n_bars, l0, step, CAST(least(n_bars - 1, floor(round((x - l0) / step, 9))) AS INTEGER) AS bar, count(*) AS n FROM h3 GROUP BY ALL)"""

LONE = _with(
    HOURLY, BASE % "bars", _values(), _extremes("bars", (1, 5)),
    f"""q AS (SELECT rep_id, node_id, quantile_cont(value, [{_LIST}]) AS q, min(value) AS low, max(value) AS high FROM vals WHERE value IS NOT NULL GROUP BY ALL),
edges AS (SELECT rep_id, node_id, list_sort(list_distinct(list_filter(list_transform(q, lambda e: round(e, 9)), lambda e: e > low AND e <= high))) AS edges FROM q),
bins AS (SELECT v.node_id, v.bar_idx, CAST(len(list_filter(e.edges, lambda x: x < v.value)) AS INTEGER) AS bin FROM vals v JOIN edges e ON e.node_id = v.node_id WHERE v.value IS NOT NULL)""",
)

ORACLES: dict[str, str] = {
    "bars_daily": _with(DAILY) + " SELECT bar_idx, ts, open, high, low, close, volume FROM bars",
    "bars_hourly": _with(HOURLY) + " SELECT bar_idx, ts, open, high, low, close, volume FROM bars",
    "dedup_keep_last": _with(DAILY, MESSY) + " SELECT ts, close, volume FROM last_rows",
    "clean_bars": _with(DAILY, MESSY) + " SELECT ts, open, high, low, close, volume FROM last_rows WHERE ts >= TIMESTAMP '1996-01-01' AND volume IS NOT NULL",
    "ffill_aux": _with(DAILY, AUX) + ", gaps AS (SELECT ts, CASE WHEN day(ts) % 5 <> 0 THEN vix END AS vix, tnx FROM aux) SELECT ts, last_value(vix IGNORE NULLS) OVER (ORDER BY ts) AS vix, last_value(tnx IGNORE NULLS) OVER (ORDER BY ts) AS tnx FROM gaps",
    "asof_align": _with(DAILY, AUX) + " SELECT bar_idx, ts, close, vix, tnx, dxy FROM panel",
    "default_columns": _with(DAILY) + " SELECT bar_idx, close AS open, close AS high, close AS low, close, CAST(1 AS DOUBLE) AS volume FROM bars",
    "validate_bars": _with(DAILY) + f""", broken AS (SELECT bar_idx, ts, high, CASE WHEN bar_idx % 100 = 1 THEN high + 1 ELSE low END AS low, CASE WHEN bar_idx % 100 = 2 THEN NULL ELSE close END AS close,
  CASE WHEN bar_idx % 100 = 3 THEN -1.0 ELSE volume END AS volume, CASE WHEN bar_idx % 100 = 4 THEN 0.0 ELSE open END AS open FROM bars)
SELECT 'empty' AS rule, CAST(CASE WHEN count(*) = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_bars FROM broken UNION ALL SELECT 'null_timestamp', count_if(ts IS NULL) FROM broken
UNION ALL SELECT 'not_increasing', count_if(b >= ts) FROM (SELECT ts, lag(ts) OVER (ORDER BY bar_idx) AS b FROM broken)
UNION ALL SELECT 'not_finite', count_if(open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL) FROM broken
UNION ALL SELECT 'price_not_positive', count_if(coalesce(open <= 0, false) OR coalesce(high <= 0, false) OR coalesce(low <= 0, false) OR coalesce(close <= 0, false)) FROM broken
UNION ALL SELECT 'negative_volume', count_if(volume < 0) FROM broken UNION ALL SELECT 'low_above_body', count_if(low > {_LEAST}) FROM broken
UNION ALL SELECT 'high_below_body', count_if(high < {_BODY}) FROM broken UNION ALL SELECT 'low_above_high', count_if(low > high) FROM broken UNION ALL SELECT 'auxiliary_infinite', 0""",
    "node_coverage": _with(DAILY, BASE % "bars", _values()) + " SELECT node_id, count(value) AS n_valid, count(value) >= 100 AS enough FROM vals GROUP BY node_id",
    **{f"feature_{n}": _feature(n) for n in (*ONE_STEP, *TWO_STEP)},
    "feature_macd": _recursive(DAILY, _EMA) + " SELECT bar_idx, round((f - s) / close, 9) AS value FROM ema",
    "feature_macd_histogram": _recursive(DAILY, _EMA, _SIGNAL) + " SELECT bar_idx, round(x - y, 9) AS value FROM sig",
    "forward_excursions": _with(HOURLY, _extremes("bars", tuple(range(1, 31)))) + " SELECT bar_idx, horizon, round(down, 9) AS down, round(up, 9) AS up FROM exc",
    "quantile_edges": MEASURED + " SELECT node_id, CAST(i - 1 AS INTEGER) AS edge_idx, edges[i] AS edge FROM (SELECT node_id, edges, unnest(range(1, len(edges) + 1)) AS i FROM edges)",
    "bin_assignment": MEASURED + " SELECT node_id, bar_idx, value, bin FROM bins",
    "touch_rate_baseline": MEASURED + " SELECT horizon, barrier_idx, barrier, n_obs, n_hit, round(p, 9) AS p FROM base_rate",
    "conditional_surface": MEASURED + " SELECT node_id, bin, horizon, barrier_idx, barrier, n_obs, n_hit, round(p, 9) AS p FROM rate",
    "shift_surface": MEASURED + " SELECT node_id, bin, horizon, barrier, n_obs, round(base_p, 9) AS base_p, round(shift, 9) AS shift FROM shifts",
    "barrier_pairs": f"WITH {BARRIERS}, top AS (SELECT max(abs(a.barrier)) AS m FROM barriers a JOIN barriers b ON b.barrier = -a.barrier AND a.barrier <> 0) SELECT a.barrier_idx, a.barrier, coalesce(b.barrier_idx, a.barrier_idx) AS mirror_idx, CASE WHEN b.barrier_idx IS NULL THEN 0.0 ELSE abs(a.barrier) / m / 2 END AS weight FROM barriers a LEFT JOIN barriers b ON b.barrier = -a.barrier AND a.barrier <> 0, top",
    "bin_scores": MEASURED + " SELECT node_id, bin, round(score, 6) AS score, supported FROM scores",
    "economic_filter": f"{MEASURED}, {FILTER} SELECT node_id, horizon, bin, barrier, round(dev, 9) AS dev, run, n_obs, n_hit FROM best",
    "strongest_cell": f"{MEASURED}, {FILTER} SELECT node_id, horizon, bin, barrier, round(dev, 9) AS dev, run FROM top",
    "inspection_target": MEASURED + " SELECT barrier AS target_barrier, 5 AS target_horizon FROM base_rate WHERE horizon = 5 AND barrier < 0 ORDER BY abs(p - 0.30), barrier_idx LIMIT 1",
    "log_components": _with(DAILY, COMPONENTS) + " SELECT bar_idx, " + ", ".join(f"round({c}, 9) AS {c}" for c in _NAMES) + " FROM comp",
    "null_fit": _with(DAILY, COMPONENTS, _fit()) + " SELECT " + ", ".join([*[f"round(m{i}, 9) AS m{i}" for i in range(4)], *[f"round(l{i}{j}, 9) AS l{i}{j}" for i in range(4) for j in range(i + 1)]]) + " FROM fit",
    "null_paths": _with(DAILY, COMPONENTS, _fit(), _paths()) + " SELECT rep_id, bar_idx, open, high, low, close, volume FROM paths",
    "monte_carlo_pvalue": _inference(0.05) + f" SELECT node_id, bin, round(bin_score, 6) AS bin_score, round(p, 9) AS monte_carlo_p_value, cleared, round(p95, 6) AS null_p95, CAST({REPLICATES} AS BIGINT) AS n_null_replicates, n_sup AS n_supported_null FROM tests",
    "catalogue_surface": _catalogue(),
    "monte_carlo_histories": _histories(),
    "ensemble_extended": f"{_inference(0.05, HOURLY, 2 * REPLICATES)} SELECT {_FOUND} WHERE node_id IN ('roc_5', 'rsi_14')",
    "selection": f"{_inference(0.5)}, {SELECTED} SELECT selection_number, node_id, bin, round(bin_score, 6) AS bin_score, round(p, 9) AS monte_carlo_p_value FROM chosen",
    "selected_heatmap": f"{_inference(0.5)}, {SELECTED} SELECT s.node_id, s.bin, barrier_idx, barrier, {_pivot('shift', alias='s.')} FROM shifts s JOIN chosen c ON c.node_id = s.node_id AND c.bin = s.bin WHERE s.rep_id = 0 AND abs(barrier) > 1e-12 GROUP BY ALL",
    "selected_null": f"{_inference(0.5)}, {SELECTED} SELECT t.node_id, t.bin, round(p95, 6) AS null_p95 FROM tests t JOIN chosen c ON c.node_id = t.node_id AND c.bin = t.bin",
    "skipped_bins": LONE + " SELECT DISTINCT node_id, bin, 'no eligible cells' AS reason FROM bins WHERE node_id = 'roc_5'",
    "status_by_family": f"{_inference(0.5)}, fam AS (SELECT * FROM (VALUES ('roc_5', 'momentum'), ('rsi_14', 'rsi'), ('weekday', 'calendar')) AS v(node_id, family)), per AS (SELECT family, count(DISTINCT f.node_id) AS nodes, count(DISTINCT s.node_id) AS measured FROM fam f LEFT JOIN surface s ON s.node_id = f.node_id AND s.rep_id = 0 GROUP BY family), tst AS (SELECT family, count(*) AS tested, count_if(cleared) AS cleared FROM tests t JOIN fam f ON f.node_id = t.node_id GROUP BY family), a AS (SELECT per.family, nodes, measured, coalesce(tested, 0) AS tested, coalesce(cleared, 0) AS cleared FROM per LEFT JOIN tst ON tst.family = per.family) SELECT * FROM a UNION ALL SELECT 'TOTAL', CAST(sum(nodes) AS BIGINT), CAST(sum(measured) AS BIGINT), CAST(sum(tested) AS BIGINT), CAST(sum(cleared) AS BIGINT) FROM a",
    "node_status": f"{MEASURED}, {FILTER}, wide AS (SELECT s.node_id, s.bin, barrier_idx, s.barrier, {_pivot('shift', 9, (1, 5), 's.')} FROM shifts s JOIN top ON top.node_id = s.node_id AND top.bin = s.bin WHERE s.node_id = 'roc_5' GROUP BY ALL) SELECT * FROM wide WHERE greatest(abs(h1), abs(h5)) >= {MIN_DEV}",
    "surface_pivot": f"{MEASURED} SELECT node_id, bin, barrier_idx, barrier, {_pivot('p')} FROM rate GROUP BY ALL",
    "shift_pivot": f"{MEASURED} SELECT node_id, bin, barrier_idx, barrier, {_pivot('shift')} FROM shifts GROUP BY ALL",
    "null_histogram": f"{_inference(0.05)}, {HISTOGRAM} SELECT node_id, bin, n_bars, bar, round(l0 + bar * step, 6) AS \"left\", round(l0 + bar * step + step, 6) AS \"right\", n FROM h4",
    "stream_bars": "SELECT date_trunc('hour', ts)::TIMESTAMP AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY date_trunc('hour', ts)",
    "sheet_counts": f"{MEASURED} SELECT node_id, bin, barrier_idx, barrier, {_pivot('CAST(n_obs AS DOUBLE)')} FROM rate GROUP BY ALL",
    "bin_sheet": f"""{MEASURED}, own AS (SELECT * FROM rate WHERE node_id = 'roc_5' AND bin = 0)
SELECT 'n' AS "row", CAST(NULL AS DOUBLE) AS barrier, {_pivot('CAST(n_obs AS DOUBLE)', 4)} FROM own UNION ALL SELECT 'p', barrier, {_pivot('p')} FROM own GROUP BY barrier""",
    "null_markers": f"{_inference(0.05)} SELECT node_id, bin, 'observed' AS marker, round(bin_score, 6) AS \"at\" FROM tests UNION ALL SELECT node_id, bin, 'p95', round(p95, 6) FROM tests",
    "selection_summary": f"{_inference(0.5)}, {SELECTED} SELECT count(*) AS n_bins, count(DISTINCT node_id) AS n_nodes FROM chosen",
    "measure_given": MEASURED + " SELECT node_id, bin, horizon, barrier_idx, n_obs, n_hit, round(p, 9) AS p FROM rate",
    "feature_restore": _with(DAILY, BASE % "bars", _values()) + " SELECT node_id, bar_idx, value FROM vals",
    "missing_nodes": "SELECT 'late' AS node_id",
}
