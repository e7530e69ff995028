"""The engine's operators as queries over the driver's tables, with their SQL.

Hourly bars come from ``events`` and daily bars from ``orders``.  Both sides
round doubles to six decimals; the SQL of a query states its semantics anew,
with plain windows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .config import AUDIT_COSTS, INSTITUTIONAL_COSTS, BacktestConfig, CrisisConfig, PatternConfig, RegimeConfig
from .functions import scalars
from .operators import backtest as bt
from .operators import checks, eda, features, frames, montecarlo, patterns, signals, verdicts
from .operators import walkforward as wf
from .operators.drawdowns import drawdown_series, episodes, events
from .plans import exports, research, views
from .sources import cleaning, fixtures

Query = Callable[[SparkSession, str], DataFrame]

K = ["symbol", "interval"]
KS = [*K, "strategy_id"]
#: Window sizes that fit a month of hours, and seven years of days.
HOURLY = BacktestConfig(train_bars=240, purge_bars=24, test_bars=72, step_bars=72, mc_runs=500, min_trades=10)
DAILY = BacktestConfig(train_bars=365, purge_bars=7, test_bars=90, step_bars=90, annualization_factor=365.0, mc_runs=2000)
DAILY_REGIME = RegimeConfig(trend_window=200, vol_window=30)
CRISIS = CrisisConfig(min_depth=-0.05)
SMALL_PATTERNS = PatternConfig(min_samples=20)


def out(df: DataFrame, *drop: str) -> DataFrame:
    """Columns as the SQL gives them: rounded doubles, long integers, times without a zone."""
    cols = []
    for f in df.schema:
        if f.name in ("interval", "idx", *drop):
            continue
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def hours(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.hourly(spark, d)


def days(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.daily(spark, d)


# ---------------------------------------------------------------- SQL parts

H = """b AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS t, arg_min(value, ts) + 1000.0 AS o, max(value) + 1000.0 AS h,
  min(value) + 1000.0 AS l, arg_max(value, ts) + 1000.0 AS c, round(sum(value), 6) AS v, count(*) AS n FROM events GROUP BY 1, 2)"""
H_RAW = H.replace(" + 1000.0", "")
D = """b AS (SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate) AS t, arg_min(o_totalprice, o_orderkey) + 1000000.0 AS o,
  max(o_totalprice) + 1000000.0 AS h, min(o_totalprice) + 1000000.0 AS l, arg_max(o_totalprice, o_orderkey) + 1000000.0 AS c,
  round(sum(o_totalprice), 6) AS v, count(*) AS n FROM orders GROUP BY 1, 2)"""


def R(expr: str, name: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0 AS {name}"


def rounded(names: str, prefix: str = "") -> str:
    return ", ".join(R(prefix + n, n) for n in names.split())


def full(agg: str, x: str, n: int, shift: int = 0, least: int | None = None) -> str:
    frame = f"OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN {n - 1 + shift} PRECEDING AND {f'{shift} PRECEDING' if shift else 'CURRENT ROW'})"
    return f"CASE WHEN count({x}) {frame} >= {n if least is None else least} THEN {agg} {frame} END"


W = "OVER (PARTITION BY symbol ORDER BY t)"
ENRICHED = f"""r AS (SELECT *, lead(o) {W} / nullif(o, 0) - 1 AS r, CASE WHEN c / nullif(o, 0) > 0 THEN ln(c / nullif(o, 0)) END AS lr FROM b),
e AS (SELECT *, {full('avg(c)', 'c', 20)} AS sma_20, {full('avg(c)', 'c', 50)} AS sma_50, {full('stddev_samp(r)', 'r', 24)} AS vol,
  CAST(isodow(t) - 1 AS BIGINT) AS wd, CAST(isodow(lead(t) {W}) - 1 AS BIGINT) AS nwd FROM r),
m AS (SELECT symbol, date_trunc('month', t) AS month, arg_max(c, t) / arg_min(c, t) - 1 AS mr FROM b GROUP BY ALL),
x AS (SELECT e.*, CASE WHEN mr >= 0.05 THEN 'Bull' WHEN mr <= -0.05 THEN 'Bear' ELSE 'Lateral' END AS regime
  FROM e JOIN m ON e.symbol = m.symbol AND date_trunc('month', e.t) = m.month)"""


def signal_sql(kind: str, day: int, shift: int = 0) -> str:
    on = f"isodow(lead(t + INTERVAL '{shift} hours') OVER w) - 1 = {day}"
    return f"CASE WHEN {on} THEN {1.0 if kind == 'long' else 0.0} ELSE {0.0 if kind == 'long' else 1.0} END"


def bt_sql(src: str, keys: str = "symbol", cost: str = "0.0015", name: str = "") -> str:
    """CTEs from ``src`` (keys, t, o, sig): bt with positions, returns, equity and drawdowns."""
    n = name
    return f"""p{n} AS (SELECT *, row_number() OVER w - 1 AS idx, coalesce(lag(sig) OVER w, 0) AS pos, coalesce(lag(sig, 2) OVER w, 0) AS prev,
  lead(o) OVER w / nullif(o, 0) - 1 AS mr FROM {src} WINDOW w AS (PARTITION BY {keys} ORDER BY t)),
r{n}0 AS (SELECT *, pos * mr - abs(pos - prev) * ({cost}) AS sr FROM p{n} WHERE mr IS NOT NULL),
{eq_sql(f'r{n}0', keys, f'bt{n}')}"""


def eq_sql(src: str, keys: str, to: str) -> str:
    return f"""{to}_e AS (SELECT *, 10000 * product(1 + sr) OVER w AS eq, 10000 * product(1 + mr) OVER w AS beq FROM {src}
  WINDOW w AS (PARTITION BY {keys} ORDER BY t ROWS UNBOUNDED PRECEDING)),
{to} AS (SELECT *, eq / max(eq) OVER w - 1 AS dd, beq / max(beq) OVER w - 1 AS bdd FROM {to}_e WINDOW w AS (PARTITION BY {keys} ORDER BY t ROWS UNBOUNDED PRECEDING))"""


def metrics_sql(src: str, keys: str, af: float, label: str = "m") -> str:
    """A CTE ``label`` with the strategy's and the benchmark's metrics."""
    parts = []
    for who, ret, eq, dd in (("strategy", "sr", "eq", "dd"), ("benchmark", "mr", "beq", "bdd")):
        last, mean, std, down = f"arg_max({eq}, t)", f"avg({ret})", f"nullif(stddev_samp({ret}), 0)", f"nullif(stddev_samp(CASE WHEN {ret} < 0 THEN {ret} END), 0)"
        cagr = f"(CASE WHEN isfinite(pow({last} / 10000, 1 / (count({ret}) / {af})) - 1) THEN pow({last} / 10000, 1 / (count({ret}) / {af})) - 1 END)"
        parts.append(
            f"""{last} / 10000 - 1 AS {who}_total_return, {cagr} AS {who}_cagr, {mean} / {std} * {math.sqrt(af)!r} AS {who}_sharpe,
  {mean} / {down} * {math.sqrt(af)!r} AS {who}_sortino, CASE WHEN min({dd}) < 0 THEN {cagr} / abs(min({dd})) END AS {who}_calmar,
  min({dd}) AS {who}_max_drawdown, {last} AS {who}_final_equity, {mean} AS {who}_mean_period_return, stddev_samp({ret}) AS {who}_std_period_return,
  CAST(count({ret}) AS DOUBLE) AS {who}_n_bars, count({ret}) / {af} AS {who}_years"""
        )
    return f"{label} AS (SELECT {keys}, {', '.join(parts)} FROM {src} GROUP BY {keys})"


METRIC_NAMES = " ".join(f"{w}_{m}" for w in ("strategy", "benchmark") for m in bt.METRICS)
EXCESS = ", ".join(
    [
        R("strategy_total_return - benchmark_total_return", "excess_total_return_vs_benchmark"),
        R("strategy_sharpe - benchmark_sharpe", "excess_sharpe_vs_benchmark"),
    ]
)


def metric_select(keys: str, src: str = "m") -> str:
    return f"SELECT {keys}, {rounded(METRIC_NAMES)}, {EXCESS} FROM {src}"


AUDIT_SIGNALS = " UNION ALL ".join(
    f"SELECT *, '{name}' AS strategy_id, {signal_sql('long' if is_long else 'avoid', day)} AS sig FROM {{src}} WINDOW w AS (PARTITION BY {{keys}} ORDER BY t)"
    for name, (is_long, day) in research.RULES.items()
)


def windows_sql(c: BacktestConfig, sides: tuple[str, ...] = ("train", "test")) -> str:
    """wi: each bar in its windows, with window_id and side."""
    span = c.train_bars + c.purge_bars + c.test_bars
    cuts = {"train": (0, c.train_bars), "test": (c.train_bars + c.purge_bars, span)}
    each = " UNION ALL ".join(
        f"SELECT i.*, k + 1 AS window_id, '{s}' AS side FROM i JOIN g ON g.symbol = i.symbol AND i.idx >= k * {c.step_bars} + {cuts[s][0]} AND i.idx < k * {c.step_bars} + {cuts[s][1]}"
        for s in sides
    )
    return f"""i AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS idx FROM b),
g AS (SELECT symbol, unnest(range(CAST(floor((count(*) - {span}) / {c.step_bars}) + 1 AS BIGINT))) AS k FROM b GROUP BY symbol HAVING count(*) >= {span}),
wi AS (SELECT * EXCLUDE (idx) FROM ({each}))"""


def aggregate_sql(src: str, by: str) -> str:
    r, e = "strategy_total_return", "strategy_total_return - benchmark_total_return"
    return f"""SELECT {by}, count(*) AS wf_window_count, {R(f'avg(CAST({r} > 0 AS INT))', 'wf_positive_window_rate')},
  {R(f'avg(CAST({e} > 0 AS INT))', 'wf_beat_benchmark_window_rate')}, {R(f'median({r})', 'wf_median_test_return')}, {R(f'avg({r})', 'wf_mean_test_return')},
  {R(f'min({r})', 'wf_worst_test_return')}, {R(f'avg({e})', 'wf_mean_excess_vs_benchmark')}, {R(f'median({e})', 'wf_median_excess_vs_benchmark')},
  {R('min(strategy_max_drawdown)', 'wf_worst_drawdown')}, {R('avg(strategy_sharpe)', 'wf_mean_test_sharpe')} FROM {src} GROUP BY {by}"""


BASE = f"""f0 AS (SELECT *, c / lag(c) {W} - 1 AS simple_return, ln(c / lag(c) {W}) AS log_return, (h - l) / c AS range_pct, abs(c - o) / o AS body_pct,
  (h - greatest(o, c)) / o AS upper_wick_pct, (least(o, c) - l) / o AS lower_wick_pct, v / nullif(lag(v) {W}, 0) - 1 AS volume_change_pct,
  CAST(hour(t) AS BIGINT) AS hour_utc, dayname(t) AS day_of_week, strftime(t, '%Y-%m-%d') AS date_utc FROM b),
f AS (SELECT *, abs(log_return) AS abs_log_return, log_return * log_return AS squared_log_return,
  {full('stddev_samp(log_return)', 'log_return', 24)} AS rolling_volatility, {full('avg(log_return)', 'log_return', 24)} AS rolling_mean_return FROM f0)"""
SUMMARY_LONG = "u AS (" + " UNION ALL ".join(f"SELECT symbol, '{c}' AS metric, {'v' if c == 'volume' else c} AS x FROM f" for c in eda.SUMMARY_METRICS) + ")"


def pattern_features_sql(config: PatternConfig) -> str:
    n = config.context_window
    first = ", ".join(
        [f"ln(lead(c, {h}) {W} / c) AS fwd_log_return_{h}h, lead(c, {h}) {W} / c - 1 AS fwd_simple_return_{h}h" for h in config.forward_horizons]
        + [f"ln(c / lag(c, {m}) {W}) AS past_{m}" for m in config.momentum_windows]
    )
    second = ", ".join(
        f"{full(f'quantile_cont(past_{m}, {q})', f'past_{m}', n, 1)} AS past_{m}_q{round(q * 100)}" for m in config.momentum_windows for q in (config.low_quantile, config.high_quantile)
    )
    events_ = ", ".join(
        f"coalesce(past_{m} > past_{m}_q80, false) AS momentum_up_{m}h_event, coalesce(past_{m} < past_{m}_q20, false) AS momentum_down_{m}h_event" for m in config.momentum_windows
    )
    return f"""p0 AS (SELECT *, c / lag(c) {W} - 1 AS simple_return, ln(c / lag(c) {W}) AS log_return, (h - l) / c AS range_pct, CAST(hour(t) AS BIGINT) AS hour_utc,
  dayname(t) AS day_of_week, {first} FROM b),
p1 AS (SELECT *, abs(log_return) AS abs_log_return, {full('stddev_samp(log_return)', 'log_return', config.short_vol_window, 1)} AS rolling_vol_24h_past,
  {full(f'quantile_cont(range_pct, {config.low_quantile})', 'range_pct', n, 1)} AS rq20, {full(f'quantile_cont(range_pct, {config.high_quantile})', 'range_pct', n, 1)} AS rq80,
  {full('quantile_cont(range_pct, 0.5)', 'range_pct', n, 1)} AS rq50,
  (v - ({full('avg(v)', 'v', n, 1)})) / nullif(({full('stddev_samp(v)', 'v', n, 1)}), 0) AS vz, {second} FROM p0),
pf AS (SELECT *, coalesce(range_pct > rq80, false) AS vol_expansion_event, coalesce(range_pct < rq20, false) AS vol_contraction_event,
  coalesce(vz > 1, false) AS high_volume_event, coalesce(vz < -1, false) AS low_volume_event, {events_} FROM p1)"""


def conditions_sql(config: PatternConfig) -> list[tuple[str, str, str]]:
    out_ = [("hour_behavior", f"hour_utc_{h:02d}", f"hour_utc = {h}") for h in range(24)]
    out_ += [("day_behavior", f"day_{es}", f"day_of_week = '{d}'") for d, es in zip(scalars.DAYS, scalars.DAYS_ES)]
    e = {k: f"{v}_event" for k, v in (("w", "vol_expansion"), ("n", "vol_contraction"), ("l", "high_volume"), ("q", "low_volume"))}
    out_ += [
        ("volatility_volume", a, b)
        for a, b in (
            ("vol_expansion_range_gt_q80_168h", e["w"]),
            ("vol_contraction_range_lt_q20_168h", e["n"]),
            ("high_volume_zscore_gt_1_168h", e["l"]),
            ("low_volume_zscore_lt_minus_1_168h", e["q"]),
            ("vol_expansion_and_high_volume", f"{e['w']} AND {e['l']}"),
            ("vol_contraction_and_low_volume", f"{e['n']} AND {e['q']}"),
        )
    ]
    for m in config.momentum_windows:
        for kind, a, b in (("momentum", "momentum_up", "momentum_down"), ("mean_reversion", "after_extreme_rally", "after_extreme_drop")):
            out_ += [(kind, f"{a}_{m}h", f"momentum_up_{m}h_event"), (kind, f"{b}_{m}h", f"momentum_down_{m}h_event")]
    return out_


RESEARCH_SQL = f"""q0 AS (SELECT *, c / lag(c) {W} - 1 AS simple_return_1h, ln(c / lag(c) {W}) AS log_return_1h, (h - l) / c AS range_pct, abs(c - o) / c AS body_pct,
  CAST(hour(t) AS BIGINT) AS hour_utc, CAST(isodow(t) - 1 AS BIGINT) AS day_of_week_utc, CAST(isodow(t) >= 6 AS BIGINT) AS is_weekend, ln(1 + v) AS lv,
  {', '.join(f'c / lag(c, {n}) {W} - 1 AS return_{n}h' for n in features.RETURN_WINDOWS)},
  {', '.join(full('avg(c)', 'c', n) + f' AS sma_{n}' for n in features.SMA_WINDOWS)},
  {', '.join(full('max(h)', 'h', n, 1, max(5, n // 3)) + f' AS rolling_high_prev_{n}h, ' + full('min(l)', 'l', n, 1, max(5, n // 3)) + f' AS rolling_low_prev_{n}h' for n in features.CONTEXT_WINDOWS)} FROM b),
q1 AS (SELECT *, {', '.join(full('stddev_pop(log_return_1h)', 'log_return_1h', n, 0, max(5, n // 3)) + f' AS rolling_vol_{n}h, (lv - (' + full('avg(lv)', 'lv', n) + ')) / nullif((' + full('stddev_pop(lv)', 'lv', n) + f'), 0) AS volume_zscore_{n}h, (range_pct - (' + full('avg(range_pct)', 'range_pct', n) + ')) / nullif((' + full('stddev_pop(range_pct)', 'range_pct', n) + f'), 0) AS range_zscore_{n}h' for n in features.CONTEXT_WINDOWS)} FROM q0),
q2 AS (SELECT *, {full('quantile_cont(rolling_vol_24h, 0.33)', 'rolling_vol_24h', 168, 1, 50)} AS a33, {full('quantile_cont(rolling_vol_24h, 0.67)', 'rolling_vol_24h', 168, 1, 50)} AS a67,
  {full('quantile_cont(volume_zscore_168h, 0.33)', 'volume_zscore_168h', 168, 1, 50)} AS z33, {full('quantile_cont(volume_zscore_168h, 0.67)', 'volume_zscore_168h', 168, 1, 50)} AS z67 FROM q1),
rf AS (SELECT *, CASE WHEN rolling_vol_24h <= a33 THEN 'low' WHEN rolling_vol_24h <= a67 THEN 'mid' ELSE 'high' END AS volatility_regime_24h,
  CASE WHEN volume_zscore_168h <= z33 THEN 'low' WHEN volume_zscore_168h <= z67 THEN 'mid' ELSE 'high' END AS volume_regime_168h FROM q2)"""
RESEARCH_COLUMNS = (
    "simple_return_1h log_return_1h range_pct body_pct "
    + " ".join(f"return_{n}h" for n in features.RETURN_WINDOWS)
    + " "
    + " ".join(f"sma_{n}" for n in features.SMA_WINDOWS)
    + " "
    + " ".join(f"{p}_{n}h" for n in features.CONTEXT_WINDOWS for p in ("rolling_high_prev", "rolling_low_prev", "rolling_vol", "volume_zscore", "range_zscore"))
)


def variant_sql(v: signals.Variant) -> str:
    p = v.params
    if v.hypothesis_id == "H1":
        s = f"return_{p['lookback']}h > {p['min_return']} AND volume_zscore_{p['volume_window']}h > {p['volume_z']}" + (" AND c > sma_200" if p["use_trend_filter"] else "")
    elif v.hypothesis_id == "H2":
        s = f"return_{p['lookback']}h < -{p['drop_threshold']} AND rolling_vol_{p['vol_window']}h <= {signals.quantile_column(p['vol_window'], p['max_vol_quantile'])}"
    elif v.hypothesis_id == "H3":
        s = f"c > rolling_high_prev_{p['breakout_window']}h AND volume_zscore_{p['volume_window']}h > {p['volume_z']} AND c > sma_{p['trend_sma']}"
    else:
        s = f"c > sma_{p['trend_sma']} AND return_{p['confirm_return_window']}h > {p['min_confirm_return']}"
    return s + (" AND is_weekend = 0" if p["avoid_weekend"] else "")


def trades_sql(src: str, keys: str, to: str = "tr", cost: str = "0.0015") -> str:
    """CTE ``to``: the trades of positions in ``src`` (keys, t, o, pos)."""
    return f"""{to}0 AS (SELECT {keys}, t, o, pos, row_number() OVER w - 1 AS i, CASE WHEN pos > 0 AND coalesce(lag(pos) OVER w, 0) <= 0 THEN 1 ELSE 0 END AS en
  FROM {src} WINDOW w AS (PARTITION BY {keys} ORDER BY t)),
{to}1 AS (SELECT *, sum(en) OVER (PARTITION BY {keys} ORDER BY i ROWS UNBOUNDED PRECEDING) AS trade_id, max(i) OVER (PARTITION BY {keys}) AS li,
  arg_max(o, i) OVER (PARTITION BY {keys}) AS lo, max(t) OVER (PARTITION BY {keys}) AS lt FROM {to}0),
{to} AS (SELECT {keys}, CAST(trade_id AS BIGINT) AS trade_id, min(t) AS entry_time, coalesce(min(CASE WHEN pos <= 0 THEN t END), any_value(lt)) AS exit_time, arg_min(o, i) AS entry_price,
  coalesce(arg_min(o, i) FILTER (WHERE pos <= 0), any_value(lo)) AS exit_price, coalesce(min(CASE WHEN pos <= 0 THEN i END), any_value(li)) - min(i) AS bars_held,
  coalesce(arg_min(o, i) FILTER (WHERE pos <= 0), any_value(lo)) / arg_min(o, i) - 1 AS gross_return,
  coalesce(arg_min(o, i) FILTER (WHERE pos <= 0), any_value(lo)) / arg_min(o, i) - 1 - 2 * {cost} AS net_return FROM {to}1 WHERE trade_id > 0 GROUP BY {keys}, trade_id)"""


def trade_metrics_sql(src: str, keys: str) -> str:
    return f"""SELECT {keys}, CAST(count(*) AS DOUBLE) AS strategy_trade_count, {R('avg(CAST(net_return > 0 AS INT))', 'strategy_win_rate')},
  {R('coalesce(sum(CASE WHEN net_return > 0 THEN net_return END), 0) / nullif(abs(sum(CASE WHEN net_return < 0 THEN net_return END)), 0)', 'strategy_profit_factor')},
  {R('avg(net_return)', 'strategy_expectancy')}, {R('avg(net_return)', 'strategy_avg_trade_return')}, {R('avg(bars_held)', 'strategy_avg_bars_held')} FROM {src} GROUP BY {keys}"""


#: name -> (query, SQL or None)
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        REGISTRY[name] = (f, sql)
        return f

    return put


# ---------------------------------------------------------------- backtests


@register(
    "backtest_wednesday_metrics",
    f"WITH {H}, s AS (SELECT *, {signal_sql('long', 2)} AS sig FROM b WINDOW w AS (PARTITION BY symbol ORDER BY t)), {bt_sql('s')}, {metrics_sql('bt', 'symbol', 8760.0)} {metric_select('symbol')}",
)
def backtest_wednesday_metrics(spark, d):
    rows = signals.with_signals(hours(spark, d), [signals.build("S2_H2_WEDNESDAY_LONG")], K)
    return out(bt.metrics(bt.backtest(rows, K), K))


@register(
    "backtest_bars",
    f"WITH {H}, s AS (SELECT *, {signal_sql('avoid', 3)} AS sig FROM b WINDOW w AS (PARTITION BY symbol ORDER BY t)), {bt_sql('s')} "
    f"SELECT symbol, t AS open_time_utc, {rounded('position market_return turnover cost strategy_return equity bh_equity drawdown bh_drawdown')} FROM "
    "(SELECT *, pos AS position, mr AS market_return, abs(pos - prev) AS turnover, abs(pos - prev) * 0.0015 AS cost, sr AS strategy_return, eq AS equity, beq AS bh_equity, dd AS drawdown, bdd AS bh_drawdown FROM bt)",
)
def backtest_bars(spark, d):
    rows = signals.with_signals(hours(spark, d), [signals.build("S2_H4_AVOID_THURSDAY")], K)
    return out(bt.backtest(rows, K)).select(
        "symbol", "open_time_utc", "position", "market_return", "turnover", "cost", "strategy_return", "equity", "bh_equity", "drawdown", "bh_drawdown"
    )


SMA_SQL = f"s AS (SELECT *, CASE WHEN ({full('avg(c)', 'c', 5)}) > ({full('avg(c)', 'c', 20)}) THEN 1.0 ELSE 0.0 END AS sig FROM b)"


def sma_backtest(spark, d):
    rule = signals.Strategy("SMA_CROSS_5_20", "", signals.sma_cross(5, 20), back=20)
    return bt.backtest(signals.with_signals(hours(spark, d), [rule], K), K, whole_positions=True)


@register(
    "trades",
    f"WITH {H}, {SMA_SQL}, {bt_sql('s')}, {trades_sql('bt', 'symbol')} SELECT symbol, trade_id, entry_time, exit_time, {rounded('entry_price exit_price')}, CAST(bars_held AS BIGINT) AS bars_held, {rounded('gross_return net_return')}, {R('(epoch(exit_time) - epoch(entry_time)) / 3600', 'hours_held')} FROM tr",
)
def trades(spark, d):
    return out(bt.trades(sma_backtest(spark, d), K))


@register("trade_metrics", f"WITH {H}, {SMA_SQL}, {bt_sql('s')}, {trades_sql('bt', 'symbol')} {trade_metrics_sql('tr', 'symbol')}")
def trade_metrics(spark, d):
    return out(bt.trade_metrics(bt.trades(sma_backtest(spark, d), K), K))


SAMPLES_SQL = f"""{H}, s AS ({AUDIT_SIGNALS.format(src='b', keys='symbol')}), {bt_sql('s', 'symbol, strategy_id')},
n0 AS (SELECT *, count(*) OVER (PARTITION BY symbol, strategy_id) AS nn FROM bt),
sa AS (SELECT symbol, strategy_id, t, o, pos, sr, mr, unnest(['full', CASE WHEN idx < floor(nn * CAST(0.7 AS DOUBLE)) THEN 'in_sample' ELSE 'out_of_sample' END]) AS sample FROM n0),
{eq_sql('sa', 'symbol, strategy_id, sample', 'sb')}, {metrics_sql('sb', 'symbol, strategy_id, sample', 8760.0)}, {trades_sql('sb', 'symbol, strategy_id, sample')}"""


@register(
    "metrics_by_sample",
    f"WITH {SAMPLES_SQL}, tm AS ({trade_metrics_sql('tr', 'symbol, strategy_id, sample')}) SELECT m.symbol, m.strategy_id, m.sample, {rounded(METRIC_NAMES, 'm.')}, {EXCESS}, "
    "coalesce(strategy_trade_count, 0.0) AS strategy_trade_count, strategy_win_rate, strategy_profit_factor, strategy_expectancy, strategy_avg_trade_return, strategy_avg_bars_held "
    "FROM m LEFT JOIN tm USING (symbol, strategy_id, sample)",
)
def metrics_by_sample(spark, d):
    rows = signals.with_signals(hours(spark, d), signals.AUDITED, K)
    return out(bt.metrics_by_sample(bt.backtest(rows, KS), KS, HOURLY))


def _restarted_sql(base: str, label: str, af: float) -> str:
    keys = f"symbol, {label}, strategy_id"
    signals_of = AUDIT_SIGNALS.format(src="sl", keys=f"symbol, {label}")
    return f"{base}, s AS (SELECT {keys}, t, o, sig FROM ({signals_of})), {bt_sql('s', keys)}, {metrics_sql('bt', keys, af)}, {trades_sql('bt', keys)}"


@register(
    "samples_restarted",
    f"""WITH {_restarted_sql(f"""{H}, nb AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) AS k, count(*) OVER (PARTITION BY symbol) AS nn FROM b),
sl AS (SELECT symbol, t, o, 'full' AS sample FROM nb UNION ALL SELECT symbol, t, o, CASE WHEN k <= floor(nn * CAST(0.7 AS DOUBLE)) THEN 'in_sample' ELSE 'out_of_sample' END FROM nb)""", 'sample', 8760.0)},
tm AS ({trade_metrics_sql('tr', 'symbol, sample, strategy_id')}) SELECT m.symbol, m.strategy_id, m.sample, {rounded(METRIC_NAMES, 'm.')}, {EXCESS},
coalesce(strategy_trade_count, 0.0) AS strategy_trade_count, strategy_win_rate, strategy_profit_factor, strategy_expectancy, strategy_avg_trade_return, strategy_avg_bars_held
FROM m LEFT JOIN tm USING (symbol, strategy_id, sample)""",
)
def samples_restarted(spark, d):
    return out(wf.samples_restarted(hours(spark, d), signals.AUDITED, K, HOURLY))


@register(
    "yearly_restarted",
    f"""WITH {_restarted_sql(f"{D}, sl AS (SELECT symbol, t, o, CAST(year(t) AS BIGINT) AS year FROM b QUALIFY count(*) OVER (PARTITION BY symbol, year(t)) >= 100)", 'year', 365.0)}
SELECT symbol, strategy_id, year, {rounded(METRIC_NAMES)}, {EXCESS}, strategy_total_return > benchmark_total_return AS beats_benchmark_total_return, strategy_total_return > 0 AS positive_strategy_return FROM m""",
)
def yearly_restarted(spark, d):
    return out(wf.yearly_restarted(days(spark, d), signals.AUDITED, K, DAILY))


@register(
    "buy_hold_trade",
    f"WITH {H}, mv AS (SELECT symbol, lead(o) OVER (PARTITION BY symbol ORDER BY t) / o - 1 AS r FROM b), g AS (SELECT symbol, product(1 + r) - 1 AS r, CAST(count(r) AS DOUBLE) AS n FROM mv WHERE r IS NOT NULL GROUP BY symbol) "
    f"SELECT symbol, CAST(1 AS DOUBLE) AS buy_hold_trade_count, CAST(r > 0 AS DOUBLE) AS buy_hold_win_rate, CASE WHEN r < 0 THEN CAST(0 AS DOUBLE) END AS buy_hold_profit_factor, {R('r', 'buy_hold_expectancy')}, {R('r', 'buy_hold_avg_trade_return')}, n AS buy_hold_avg_bars_held FROM g",
)
def buy_hold_trade(spark, d):
    run = bt.backtest(signals.with_signals(hours(spark, d), signals.BASELINES[:1], K), KS, HOURLY)
    return out(bt.trade_metrics(bt.buy_hold_trade(run, KS, HOURLY), KS, "buy_hold").drop("strategy_id"))


CATALOG_SQL = f"""{H}, rc0 AS (SELECT *, coalesce((h - l) / nullif(c, 0), 0) AS rp, hour(lead(t) {W}) AS nh, isodow(lead(t) {W}) - 1 AS nd FROM b),
rc AS (SELECT *, coalesce(rp < ({full('quantile_cont(rp, 0.2)', 'rp', 168, 1)}), false) AS low FROM rc0),
s AS (SELECT symbol, t, o, unnest([
 struct_pack(strategy_id := 'S2_H1_TUESDAY_24H_LONG', sig := CASE WHEN nd = 1 THEN 1.0 ELSE 0.0 END),
 struct_pack(strategy_id := 'S2_H2_WEDNESDAY_LONG', sig := CASE WHEN nd = 2 THEN 1.0 ELSE 0.0 END),
 struct_pack(strategy_id := 'S2_H3_HOUR21_LONG', sig := CASE WHEN nh = 21 THEN 1.0 ELSE 0.0 END),
 struct_pack(strategy_id := 'S2_H4_AVOID_THURSDAY', sig := CASE WHEN nd = 3 THEN 0.0 ELSE 1.0 END),
 struct_pack(strategy_id := 'S2_H5_AVOID_LOW_RANGE_CONTRACTION', sig := CASE WHEN low THEN 0.0 ELSE 1.0 END),
 struct_pack(strategy_id := 'S2_H6_AVOID_THU_AND_CONTRACTION', sig := CASE WHEN nd = 3 OR low THEN 0.0 ELSE 1.0 END),
 struct_pack(strategy_id := 'BUY_AND_HOLD', sig := 1.0), struct_pack(strategy_id := 'NO_TRADE', sig := 0.0)], recursive := true) FROM rc)"""


@register(
    "strategy_catalog_metrics",
    f"WITH {CATALOG_SQL}, {bt_sql('s', 'symbol, strategy_id')}, {metrics_sql('bt', 'symbol, strategy_id', 8760.0)} {metric_select('symbol, strategy_id')}",
)
def strategy_catalog_metrics(spark, d):
    rules = [*signals.CATALOG, *signals.BASELINES[:2]]
    return out(bt.metrics(bt.backtest(signals.with_signals(hours(spark, d), rules, K), KS), KS))


@register(
    "yearly_robustness",
    f"WITH {D}, s AS ({AUDIT_SIGNALS.format(src='b', keys='symbol')}), {bt_sql('s', 'symbol, strategy_id')}, "
    "y AS (SELECT symbol, strategy_id, CAST(year(t) AS BIGINT) AS year, t, sr, mr FROM bt), "
    f"{eq_sql('y', 'symbol, strategy_id, year', 'yb')}, {metrics_sql('yb', 'symbol, strategy_id, year', 365.0)} "
    f"SELECT symbol, strategy_id, year, {rounded(METRIC_NAMES)}, {EXCESS}, strategy_total_return > benchmark_total_return AS beats_benchmark_total_return, strategy_total_return > 0 AS positive_strategy_return FROM m",
)
def yearly_robustness(spark, d):
    rows = signals.with_signals(days(spark, d), signals.AUDITED, K)
    return out(bt.yearly(bt.backtest(rows, KS, DAILY), KS, DAILY))


def _grid_sql() -> str:
    chosen = signals.variants()
    quantiles = sorted({(v.params["vol_window"], v.params["max_vol_quantile"]) for v in chosen if v.hypothesis_id == "H2"})
    q = ", ".join(f"quantile_cont(rolling_vol_{w}h, {p}) AS {signals.quantile_column(w, p)}" for w, p in quantiles)
    each = ", ".join(f"('{v.variant_id}', '{v.hypothesis_id}', CASE WHEN {variant_sql(v)} THEN 1.0 ELSE 0.0 END)" for v in chosen)
    return f"""{H}, {RESEARCH_SQL}, ql AS (SELECT symbol, {q} FROM rf GROUP BY symbol),
z AS (SELECT symbol, t, o, unnest([{each}]) AS u FROM rf JOIN ql USING (symbol)),
s AS (SELECT symbol, t, o, u[1] AS variant_id, u[2] AS hypothesis_id, u[3] AS sig FROM z)"""


@register(
    "grid_metrics",
    f"WITH {_grid_sql()}, {bt_sql('s', 'symbol, variant_id, hypothesis_id')}, {metrics_sql('bt', 'symbol, variant_id, hypothesis_id', 8760.0)} {metric_select('symbol, variant_id, hypothesis_id')}",
)
def grid_metrics(spark, d):
    by = [*K, "variant_id", "hypothesis_id"]
    return out(bt.metrics(bt.backtest(signals.grid_signals(hours(spark, d), signals.variants(), K), by), by))


def _lab(spark, d):
    return research.grid_lab(hours(spark, d), signals.variants(), HOURLY, K)


def _lab_sql() -> str:
    params = ", ".join(f"('{v.variant_id}', '{v.params_json}')" for v in signals.variants())
    by = "symbol, variant_id, hypothesis_id"
    pivot = ", ".join(
        f"max({c}) FILTER (WHERE sample = '{s}') AS {s}_{c}"
        for s in ("full", "in_sample", "out_of_sample")
        for c in ("strategy_total_return", "strategy_sharpe", "strategy_calmar", "strategy_max_drawdown", "benchmark_total_return", "trade_count")
    )
    return f"""{_grid_sql()},
{bt_sql('s', by)}, n0 AS (SELECT *, count(*) OVER (PARTITION BY {by}) AS nn FROM bt),
sa AS (SELECT {by}, t, o, pos, sr, mr, unnest(['full', CASE WHEN idx < floor(nn * CAST(0.7 AS DOUBLE)) THEN 'in_sample' ELSE 'out_of_sample' END]) AS sample FROM n0),
{eq_sql('sa', by + ', sample', 'sb')}, {metrics_sql('sb', by + ', sample', 8760.0)}, {trades_sql('sb', by + ', sample')},
mt AS (SELECT m.*, CAST(coalesce(k, 0) AS DOUBLE) AS trade_count FROM m LEFT JOIN (SELECT {by}, sample, count(*) AS k FROM tr GROUP BY ALL) USING ({by}, sample)),
pv AS (SELECT {by}, {pivot} FROM mt GROUP BY {by}),
pj AS (SELECT u[1] AS variant_id, u[2] AS params_json FROM (SELECT unnest([{params}]) AS u))"""


@register(
    "overfit_flags",
    f"""WITH {_lab_sql()}, fl AS (SELECT *, coalesce(in_sample_strategy_total_return > 0 AND in_sample_strategy_sharpe > 0, false) AS in_sample_good,
  coalesce(out_of_sample_strategy_total_return < 0, false) OR coalesce(out_of_sample_strategy_sharpe < 0, false) AS oos_bad,
  full_trade_count < 10 OR coalesce(out_of_sample_trade_count < 5, false) AS low_trade_count,
  coalesce(out_of_sample_strategy_total_return < out_of_sample_benchmark_total_return, false) AS underperforms_benchmark_oos,
  coalesce(out_of_sample_strategy_max_drawdown < -0.5, false) AS severe_oos_drawdown FROM pv)
SELECT symbol, variant_id, in_sample_good, oos_bad, low_trade_count, underperforms_benchmark_oos, severe_oos_drawdown,
  {R('CASE WHEN abs(in_sample_strategy_sharpe) > 0.1 THEN out_of_sample_strategy_sharpe / in_sample_strategy_sharpe END', 'generalization_ratio_sharpe')},
  CASE WHEN in_sample_good AND oos_bad THEN 'REJECT_OVERFIT_RISK' WHEN low_trade_count THEN 'INCONCLUSIVE_LOW_TRADES'
    WHEN underperforms_benchmark_oos AND out_of_sample_strategy_total_return < 0 THEN 'REJECT_OOS_WEAK' WHEN severe_oos_drawdown THEN 'INCONCLUSIVE_RISK_TOO_HIGH'
    WHEN out_of_sample_strategy_total_return > 0 AND out_of_sample_strategy_sharpe > 0 AND NOT underperforms_benchmark_oos THEN 'CANDIDATE_NEEDS_ROBUSTNESS' ELSE 'INCONCLUSIVE' END AS research_status FROM fl""",
)
def overfit_flags(spark, d):
    rows = verdicts.overfit_flags(_lab(spark, d), HOURLY.min_trades)
    return out(
        rows.select(
            "symbol", "variant_id", "in_sample_good", "oos_bad", "low_trade_count", "underperforms_benchmark_oos", "severe_oos_drawdown", "generalization_ratio_sharpe", "research_status"
        )
    )


@register(
    "leaderboard",
    f"""WITH {_lab_sql()}, en AS (SELECT *, coalesce(full_trade_count, 0) >= 5 AS enough, max(coalesce(full_trade_count, 0) >= 5) OVER (PARTITION BY symbol) AS any_enough FROM pv),
sc AS (SELECT symbol, hypothesis_id, variant_id, CASE WHEN any_enough THEN coalesce(in_sample_strategy_sharpe, -999.0) + coalesce(in_sample_strategy_calmar, -999.0) * 0.25 + coalesce(in_sample_strategy_total_return, -999.0) * 0.10
  ELSE coalesce(in_sample_strategy_sharpe, -999.0) END AS raw_score, CAST(printf('%.9e', CAST(raw_score AS DOUBLE)) AS DOUBLE) AS score FROM en WHERE enough OR NOT any_enough),
rk AS (SELECT *, row_number() OVER (PARTITION BY symbol, hypothesis_id ORDER BY score DESC, variant_id) AS rank FROM sc)
SELECT symbol, hypothesis_id, variant_id, {R('score', 'selection_score')}, rank FROM rk WHERE rank <= 3""",
)
def leaderboard(spark, d):
    rows = verdicts.leaderboard(_lab(spark, d), K, HOURLY.min_trades)
    return out(rows.select("symbol", "hypothesis_id", "variant_id", "selection_score", "rank"))


@register(
    "leaderboard_flags",
    f"""WITH {_lab_sql()}, en AS (SELECT *, coalesce(full_trade_count, 0) >= 5 AS enough, max(coalesce(full_trade_count, 0) >= 5) OVER (PARTITION BY symbol) AS any_enough FROM pv WHERE symbol = 'click'),
sc AS (SELECT *, coalesce(in_sample_strategy_sharpe, -999.0) + CASE WHEN any_enough THEN coalesce(in_sample_strategy_calmar, -999.0) * 0.25 + coalesce(in_sample_strategy_total_return, -999.0) * 0.10 ELSE 0 END AS raw_score, CAST(printf('%.9e', CAST(raw_score AS DOUBLE)) AS DOUBLE) AS score FROM en WHERE enough OR NOT any_enough)
SELECT symbol, hypothesis_id, variant_id, coalesce(out_of_sample_strategy_total_return < 0, false) OR coalesce(out_of_sample_strategy_sharpe < 0, false) AS oos_bad
FROM sc QUALIFY row_number() OVER (PARTITION BY symbol, hypothesis_id ORDER BY score DESC, variant_id) <= 3""",
)
def leaderboard_flags(spark, d):
    """The flags of the variants on the leaderboard, of one symbol's lab."""
    wide = research.grid_lab(hours(spark, d).where("symbol = 'click'"), signals.variants(), HOURLY, K)
    best = verdicts.leaderboard(wide, K, HOURLY.min_trades)
    found = verdicts.on_leaderboard(verdicts.overfit_flags(wide, HOURLY.min_trades), best, [*K, "variant_id"])
    return out(found.select("symbol", "hypothesis_id", "variant_id", "oos_bad"))


@register(
    "parameter_sensitivity",
    f"""WITH {_lab_sql()}, ex AS (SELECT pv.*, unnest(json_keys(params_json)) AS param_name, params_json FROM pv JOIN pj USING (variant_id))
SELECT symbol, hypothesis_id, param_name, json_extract_string(params_json, '$.' || param_name) AS param_value, count(*) AS variants,
  {R('median(out_of_sample_strategy_total_return)', 'median_oos_total_return')}, {R('median(out_of_sample_strategy_sharpe)', 'median_oos_sharpe')},
  {R('median(out_of_sample_strategy_max_drawdown)', 'median_oos_max_drawdown')}, {R('avg(CAST(coalesce(out_of_sample_strategy_total_return > 0, false) AS INT))', 'positive_oos_rate')}
FROM ex GROUP BY ALL""",
)
def parameter_sensitivity(spark, d):
    return out(verdicts.parameter_sensitivity(_lab(spark, d), K))


# ---------------------------------------------------------------- walk-forward and stress


@register(
    "walk_forward_windows",
    f"WITH {D}, g AS (SELECT symbol, unnest(range(CAST(floor((count(*) - 462) / 90) + 1 AS BIGINT))) AS k FROM b GROUP BY symbol HAVING count(*) >= 462) "
    "SELECT symbol, k + 1 AS window_id, k * 90 AS train_start, k * 90 + 365 AS train_end, k * 90 + 372 AS test_start, k * 90 + 462 AS test_end FROM g",
)
def walk_forward_windows(spark, d):
    return out(wf.windows(days(spark, d).groupBy(*K).agg(F.count("*").alias("n")), DAILY))


WF_SQL = f"{H}, {windows_sql(HOURLY)}, s AS ({AUDIT_SIGNALS.format(src='wi', keys='symbol, window_id, side')}), {bt_sql('s', 'symbol, window_id, side, strategy_id')}, {metrics_sql('bt', 'symbol, window_id, side, strategy_id', 8760.0)}"


@register("walk_forward_audit", f"WITH {WF_SQL} {metric_select('symbol, window_id, side, strategy_id')}")
def walk_forward_audit(spark, d):
    return out(wf.frozen_rules(hours(spark, d), signals.AUDITED, K, HOURLY))


@register("walk_forward_aggregate", f"WITH {WF_SQL}, te AS (SELECT * FROM m WHERE side = 'test') {aggregate_sql('te', 'symbol, strategy_id')}")
def walk_forward_aggregate(spark, d):
    tests = wf.frozen_rules(hours(spark, d), signals.AUDITED, K, HOURLY, sides=("test",))
    return out(wf.aggregated(tests, KS))


@register(
    "walk_forward_signal",
    f"WITH {D}, s0 AS (SELECT *, {signal_sql('long', 2)} AS sig FROM b WINDOW w AS (PARTITION BY symbol ORDER BY t)), {windows_sql(DAILY).replace('FROM b)', 'FROM s0)', 1)}, "
    f"{bt_sql('wi', 'symbol, window_id, side')}, {metrics_sql('bt', 'symbol, window_id, side', 365.0)} {metric_select('symbol, window_id, side')}",
)
def walk_forward_signal(spark, d):
    rows = signals.with_signals(days(spark, d), [signals.build("S2_H2_WEDNESDAY_LONG")], K)
    by = [*K, "window_id", "side"]
    return out(bt.metrics(wf.walk_forward(rows, K, DAILY), by, DAILY))


def _costs_sql(costs, c: BacktestConfig) -> str:
    each = ", ".join(f"('{n}', {a} + {b})" for n, a, b in costs)
    by = "symbol, window_id, strategy_id, scenario"
    return f"""{H}, {windows_sql(c, ('test',))}, s1 AS ({AUDIT_SIGNALS.format(src='wi', keys='symbol, window_id')}),
s AS (SELECT *, u[1] AS scenario, u[2] AS rate FROM (SELECT *, unnest([{each}]) AS u FROM s1)), {bt_sql('s', by, 'rate')}, {metrics_sql('bt', by, 8760.0)}"""


@register("cost_stress", f"WITH {_costs_sql(AUDIT_COSTS, HOURLY)} {aggregate_sql('m', 'symbol, strategy_id, scenario')}")
def cost_stress(spark, d):
    return out(wf.cost_stress(hours(spark, d), signals.AUDITED, K, AUDIT_COSTS, HOURLY))


@register("institutional_cost_stress", f"WITH {_costs_sql(INSTITUTIONAL_COSTS, HOURLY)} {aggregate_sql('m', 'symbol, strategy_id, scenario')}")
def institutional_cost_stress(spark, d):
    return out(wf.cost_stress(hours(spark, d), signals.AUDITED, K, INSTITUTIONAL_COSTS, HOURLY))


TZ_SQL = " UNION ALL ".join(
    f"SELECT symbol, t, o, '{n}' AS strategy_id, CAST({h} AS BIGINT) AS timezone_shift_hours, {signal_sql('long' if is_long else 'avoid', day, h)} AS sig FROM b WINDOW w AS (PARTITION BY symbol ORDER BY t)"
    for n, (is_long, day) in research.RULES.items()
    for h in wf.TIMEZONE_SHIFTS
)


@register(
    "timezone_fragility",
    f"WITH {H}, s AS ({TZ_SQL}), {bt_sql('s', 'symbol, strategy_id, timezone_shift_hours')}, {metrics_sql('bt', 'symbol, strategy_id, timezone_shift_hours', 8760.0)} {metric_select('symbol, strategy_id, timezone_shift_hours')}",
)
def timezone_fragility(spark, d):
    return out(wf.timezone_fragility(hours(spark, d), research.RULES, K))


CONTROLS_SQL = " UNION ALL ".join(
    f"SELECT symbol, t, o, '{f}' AS control_family, CAST({k} AS BIGINT) AS weekday_num, {signal_sql('long' if f == 'weekday_long' else 'avoid', k)} AS sig FROM b WINDOW w AS (PARTITION BY symbol ORDER BY t)"
    for f in ("weekday_long", "avoid_weekday")
    for k in range(7)
)
DAY_LIST = "[" + ", ".join(f"'{x.lower()}'" for x in scalars.DAYS) + "]"


@register(
    "selection_controls",
    f"WITH {H}, s AS ({CONTROLS_SQL}), {bt_sql('s', 'symbol, control_family, weekday_num')}, {metrics_sql('bt', 'symbol, control_family, weekday_num', 8760.0)} "
    f"SELECT symbol, control_family, weekday_num, {rounded(METRIC_NAMES)}, {EXCESS}, CASE control_family WHEN 'weekday_long' THEN 'long_' ELSE 'avoid_' END || {DAY_LIST}[weekday_num + 1] AS tested_condition, "
    "(control_family = 'weekday_long' AND weekday_num = 2) OR (control_family = 'avoid_weekday' AND weekday_num = 3) AS is_original_rule, "
    "rank() OVER (PARTITION BY symbol, control_family ORDER BY strategy_total_return DESC) AS rank_return_desc FROM m",
)
def selection_controls(spark, d):
    return out(wf.selection_controls(hours(spark, d), K))


EPISODES_SQL = """ep0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS i, sum(CASE WHEN bdd >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING) AS gr FROM bt),
ep1 AS (SELECT symbol, gr, min(i) AS top_i, min(t) AS top_t, min(i) FILTER (WHERE bdd < 0) AS start_idx, min(t) FILTER (WHERE bdd < 0) AS start_time, max(i) FILTER (WHERE bdd < 0) AS last_i,
  max(t) FILTER (WHERE bdd < 0) AS last_t, min(bdd) AS depth, arg_min(i, (bdd, i)) AS trough_idx, arg_min(t, (bdd, i)) AS trough_time FROM ep0 GROUP BY symbol, gr),
ep AS (SELECT a.symbol, a.start_idx, a.trough_idx, coalesce(z.top_i, a.last_i) AS end_idx, a.depth, a.start_time, a.trough_time, coalesce(z.top_t, a.last_t) AS end_time
  FROM ep1 a LEFT JOIN ep1 z ON a.symbol = z.symbol AND z.gr = a.gr + 1 WHERE a.start_idx IS NOT NULL)"""
HOLD_SQL = f"{D}, s AS (SELECT *, 1.0 AS sig FROM b), {bt_sql('s')}"


@register(
    "drawdown_episodes",
    f"WITH {HOLD_SQL}, {EPISODES_SQL} SELECT symbol, CAST(start_idx AS BIGINT) AS start_idx, CAST(trough_idx AS BIGINT) AS trough_idx, CAST(end_idx AS BIGINT) AS end_idx, {R('depth', 'depth')}, start_time, trough_time, end_time FROM ep WHERE depth <= -0.05",
)
def drawdown_episodes(spark, d):
    held = bt.backtest(days(spark, d).withColumn("signal", F.lit(1.0)), K, DAILY)
    return out(episodes(held, K, "bh_drawdown").where("depth <= -0.05"))


@register(
    "crisis_stress",
    f"WITH {HOLD_SQL}, {EPISODES_SQL}, wo AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY depth, start_idx) AS crisis_rank FROM ep WHERE depth <= -0.05), "
    "ib AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS i FROM b), "
    "seg AS (SELECT ib.symbol, ib.t, ib.o, crisis_rank FROM ib JOIN wo ON ib.symbol = wo.symbol AND i BETWEEN start_idx AND end_idx WHERE crisis_rank <= 3), "
    f"s2 AS ({AUDIT_SIGNALS.format(src='seg', keys='symbol, crisis_rank')}), {bt_sql('s2', 'symbol, crisis_rank, strategy_id', name='2')}, {metrics_sql('bt2', 'symbol, crisis_rank, strategy_id', 365.0)} "
    f"SELECT m.symbol, crisis_rank, strategy_id, {R('benchmark_total_return', 'benchmark_total_return_in_episode')}, {R('benchmark_max_drawdown', 'benchmark_max_drawdown_in_episode')}, "
    f"{R('strategy_total_return', 'strategy_total_return_in_episode')}, {R('strategy_max_drawdown', 'strategy_max_drawdown_in_episode')}, {R('strategy_total_return - benchmark_total_return', 'excess_return_in_episode')}, "
    f"strategy_total_return >= benchmark_total_return AS strategy_nonworse_than_benchmark, start_time, trough_time, end_time, {R('depth', 'benchmark_drawdown_depth')} FROM m JOIN wo USING (symbol, crisis_rank)",
)
def crisis_stress(spark, d):
    return out(wf.crisis_stress(days(spark, d), signals.AUDITED, K, DAILY, CRISIS))


REGIME_SQL = f"""g0 AS (SELECT *, ln(c / lag(c) {W}) AS lr FROM b),
g1 AS (SELECT *, {full('avg(c)', 'c', 200, 0, 50)} AS sma_trend, ({full('stddev_samp(lr)', 'lr', 30, 0, 50)}) * {math.sqrt(365.0)!r} AS realized_vol FROM g0),
gq AS (SELECT symbol, CASE WHEN count(realized_vol) >= 50 THEN quantile_cont(realized_vol, 0.33) END AS ql, CASE WHEN count(realized_vol) >= 50 THEN quantile_cont(realized_vol, 0.67) END AS qh FROM g1 GROUP BY symbol),
g2 AS (SELECT g1.*, ql, qh, CASE WHEN c / sma_trend - 1 > 0.02 THEN 'BULL' WHEN c / sma_trend - 1 < -0.02 THEN 'BEAR' WHEN sma_trend IS NOT NULL THEN 'RANGE' ELSE 'WARMUP' END AS trend_regime,
  CASE WHEN realized_vol <= ql THEN 'LOWVOL' WHEN realized_vol >= qh THEN 'HIGHVOL' WHEN realized_vol IS NOT NULL AND ql IS NOT NULL THEN 'MEDVOL' ELSE 'WARMUP' END AS vol_regime FROM g1 JOIN gq USING (symbol)),
rg AS (SELECT *, CASE WHEN trend_regime = 'WARMUP' OR vol_regime = 'WARMUP' THEN 'WARMUP' ELSE trend_regime || '_' || vol_regime END AS regime_label FROM g2)"""
WIDE_REGIME = RegimeConfig(trend_window=200, vol_window=90)
REGIME_SQL = REGIME_SQL.replace(full("stddev_samp(lr)", "lr", 30, 0, 50), full("stddev_samp(lr)", "lr", 90, 0, 50))


@register(
    "regime_trend_vol",
    f"WITH {D}, {REGIME_SQL} SELECT symbol, t AS open_time_utc, {rounded('sma_trend realized_vol')}, trend_regime, vol_regime, regime_label FROM rg",
)
def regime_trend_vol(spark, d):
    rows = features.trend_volatility_regimes(days(spark, d), WIDE_REGIME, 365.0, K)
    return out(rows.select("symbol", "open_time_utc", "sma_trend", "realized_vol", "trend_regime", "vol_regime", "regime_label"))


@register(
    "walk_forward_by_regime",
    f"WITH {D}, {REGIME_SQL}, {windows_sql(DAILY, ('test',)).replace('FROM b)', 'FROM rg)', 1)}, "
    "dm AS (SELECT symbol, window_id, coalesce(arg_min(regime_label, (-n, regime_label)), 'WARMUP') AS regime FROM (SELECT symbol, window_id, regime_label, count(*) AS n FROM wi WHERE regime_label <> 'WARMUP' GROUP BY ALL) GROUP BY ALL), "
    "dw AS (SELECT DISTINCT w.symbol, w.window_id, coalesce(regime, 'WARMUP') AS regime FROM wi w LEFT JOIN dm USING (symbol, window_id)), "
    f"s AS ({AUDIT_SIGNALS.format(src='wi', keys='symbol, window_id')}), {bt_sql('s', 'symbol, window_id, strategy_id')}, {metrics_sql('bt', 'symbol, window_id, strategy_id', 365.0)} "
    f"SELECT symbol, strategy_id, regime, count(*) AS window_count, {R('avg(CAST(strategy_total_return > 0 AS INT))', 'positive_window_rate')}, {R('avg(CAST(strategy_total_return > benchmark_total_return AS INT))', 'beat_benchmark_window_rate')}, "
    f"{R('median(strategy_total_return)', 'median_test_return')}, {R('median(strategy_total_return - benchmark_total_return)', 'median_excess_vs_benchmark')}, {R('min(strategy_total_return)', 'worst_test_return')} FROM m JOIN dw USING (symbol, window_id) GROUP BY symbol, strategy_id, regime",
)
def walk_forward_by_regime(spark, d):
    rows = frames.indexed(days(spark, d), K)
    labelled = features.trend_volatility_regimes(rows, WIDE_REGIME, 365.0, K)
    tests = wf.frozen_rules(rows, signals.AUDITED, K, DAILY, sides=("test",))
    return out(wf.by_regime(tests, wf.dominant_regimes(labelled, K, DAILY), K))


@register("leakage_review")
def leakage_review(spark, d):
    return wf.leakage_review(signals.catalog_table(spark, signals.AUDITED))


# ---------------------------------------------------------------- quality and cleaning


def _quality_sql(src_cte: str, returns: str | None, extra: str = "") -> str:
    def row(name: str, failed: str, limit: float, detail: str = "''") -> str:
        return f"SELECT symbol, '{name}' AS check_name, CAST(total AS BIGINT) AS total, CAST({failed} AS BIGINT) AS failed, {limit} AS lim, {detail} AS detail FROM ag"

    nulls = " || ', ' || ".join(f"'{n}: ' || n{k}" for k, n in enumerate(("open_time_utc", "open", "high", "low", "close", "volume")))
    cols = ("t", "o", "h", "l", "c", "v")
    outlier = (
        "count(*) FILTER (WHERE nr >= 10 AND abs(r - mean) > 4 * std)" if returns else "0"
    )
    q = f"""{src_cte}{extra}, st AS (SELECT *, {'avg(r) OVER (PARTITION BY symbol) AS mean, stddev_samp(r) OVER (PARTITION BY symbol) AS std, count(r) OVER (PARTITION BY symbol) AS nr' if returns else '0 AS nr'} FROM {returns or 'b'}),
ag AS (SELECT symbol, count(*) AS total, count(*) FILTER (WHERE {' OR '.join(f'{x} IS NULL' for x in cols)}) AS nul, {', '.join(f'count(*) FILTER (WHERE {x} IS NULL) AS n{k}' for k, x in enumerate(cols))},
  count(*) FILTER (WHERE h < greatest(o, c) OR l > least(o, c) OR h < l) AS ohlc, count(*) FILTER (WHERE least(o, h, l, c) <= 0) AS pr, count(*) FILTER (WHERE v < 0) AS vo,
  count(*) - count(DISTINCT t) - max(CASE WHEN t IS NULL THEN 1 ELSE 0 END) AS du, {outlier} AS ou, max(nr) AS nr FROM st GROUP BY symbol),
ch AS ({row('NULL_CHECK', 'nul', 0.01, nulls)} UNION ALL {row('OHLC_VALIDITY', 'ohlc', 0.01)} UNION ALL {row('NEGATIVE_PRICES', 'pr', 0.0001)} UNION ALL {row('NEGATIVE_VOLUME', 'vo', 0.0001)}
  UNION ALL {row('DUPLICATE_BARS', 'du', 0.0001)} UNION ALL {row('RETURN_OUTLIER', 'ou', 0.02, "CASE WHEN nr >= 10 THEN '' ELSE 'Insufficient data - skipped' END" if returns else "'Column not available - skipped'")})"""
    return f"""WITH {q} SELECT symbol, check_name, CASE WHEN failed = 0 THEN 'PASS' WHEN failed / total >= lim THEN 'FAIL' ELSE 'WARN' END AS severity, total AS total_rows,
  total - failed AS passed_rows, failed AS failed_rows, {R('round((total - failed) / total, 4)', 'pass_rate')}, detail FROM ch"""


@register("quality_checks_raw", _quality_sql(H_RAW, None))
def quality_checks_raw(spark, d):
    return out(checks.validate(fixtures.hourly(spark, d, 0.0), K))


@register("quality_checks_enriched", _quality_sql(H, "r", f", r AS (SELECT *, lead(o) {W} / nullif(o, 0) - 1 AS r FROM b)"))
def quality_checks_enriched(spark, d):
    return out(checks.validate(features.add_returns(hours(spark, d), K), K))


BAD = """b0 AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS t, arg_min(value, ts) AS o, max(value) AS h, min(value) AS l, arg_max(value, ts) AS c, round(sum(value), 6) AS v FROM events GROUP BY 1, 2),
b1 AS (SELECT symbol, t, CASE WHEN hour(t) = 5 THEN NULL ELSE o END AS o, CASE WHEN hour(t) = 10 THEN -100.0 WHEN hour(t) = 20 THEN l - 1 ELSE h END AS h, l, c, CASE WHEN hour(t) = 7 THEN -v ELSE v END AS v FROM b0),
b AS (SELECT * FROM b1 UNION ALL SELECT * FROM b1 WHERE hour(t) = 3)"""


@register("quality_checks_bad", _quality_sql(BAD, None))
def quality_checks_bad(spark, d):
    hour = F.hour("open_time_utc")
    rows = fixtures.hourly(spark, d, 0.0).withColumns(
        {
            "open": F.when(hour == 5, F.lit(None)).otherwise(F.col("open")),
            "high": F.when(hour == 10, F.lit(-100.0)).when(hour == 20, F.col("low") - 1).otherwise(F.col("high")),
            "volume": F.when(hour == 7, -F.col("volume")).otherwise(F.col("volume")),
        }
    )
    return out(checks.validate(rows.unionByName(rows.where(hour == 3)), K))


@register(
    "time_gaps",
    f"WITH {H}, gp AS (SELECT symbol, t, floor((epoch(t) - epoch(lag(t) {W})) / 3600) - 1 AS miss FROM b), "
    "ag AS (SELECT symbol, count(*) AS total, CAST(coalesce(sum(miss) FILTER (WHERE miss > 0), 0) AS BIGINT) AS failed, count(*) FILTER (WHERE miss > 0) AS gaps FROM gp GROUP BY symbol) "
    "SELECT symbol, 'TIME_GAPS' AS check_name, CASE WHEN failed = 0 THEN 'PASS' WHEN failed / total >= 0.01 THEN 'FAIL' ELSE 'WARN' END AS severity, total AS total_rows, total - failed AS passed_rows, failed AS failed_rows, "
    f"{R('round((total - failed) / total, 4)', 'pass_rate')}, gaps || ' gaps' AS detail FROM ag",
)
def time_gaps(spark, d):
    return out(checks.time_gaps(hours(spark, d), K))


@register(
    "temporal_order",
    "WITH o AS (SELECT o_orderpriority AS symbol, o_orderkey, o_orderdate < lag(o_orderdate) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS bad FROM orders) "
    "SELECT symbol, count(*) FILTER (WHERE bad) AS unordered FROM o GROUP BY symbol",
)
def temporal_order(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("open_time_utc"), "o_orderkey")
    return out(checks.order_violations(rows, ["symbol"], "o_orderkey"))


@register(
    "dedupe_keep_last",
    "SELECT o_custkey, o_orderdate, arg_max(o_totalprice, o_orderkey) AS o_totalprice, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey, o_orderdate",
)
def dedupe_keep_last(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_custkey", "o_orderdate", "o_totalprice", "o_orderkey")
    return cleaning.deduplicated(rows, ["o_custkey", "o_orderdate"], ["o_orderkey"])


@register(
    "dedupe_keep_first",
    "SELECT o_custkey, o_orderdate, arg_min(o_totalprice, o_orderkey) AS o_totalprice, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey, o_orderdate",
)
def dedupe_keep_first(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_custkey", "o_orderdate", "o_totalprice", "o_orderkey")
    return cleaning.deduplicated(rows, ["o_custkey", "o_orderdate"], ["o_orderkey"], keep="first")


@register("epoch_normalise", "SELECT event_id, date_trunc('millisecond', ts) AS open_time_utc FROM events")
def epoch_normalise(spark, d):
    """Epochs in ms, us and ns, mixed by row, and as text."""
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    unit = F.when(F.col("event_id") % 3 == 0, F.lit(1)).when(F.col("event_id") % 3 == 1, F.lit(1000)).otherwise(F.lit(1_000_000))
    rows = rows.select("event_id", (F.col("ms") * unit).cast("string").alias("open_time"))
    return out(rows.select("event_id", cleaning.parsed_time(rows, "open_time").alias("open_time_utc")))


@register(
    "standardize_headers",
    "SELECT event_id, date_trunc('second', ts) AS open_time_utc, CASE WHEN event_id % 2 = 0 THEN value ELSE -1.0 END AS open, value AS close FROM events",
)
def standardize_headers(spark, d):
    """Upper-case and alias headers; of two columns for one name the first non-null value counts."""
    rows = spark.read.parquet(f"{d}/events.parquet")
    text = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    raw = rows.select(F.col("event_id").alias(" EVENT_ID "), text.alias("Timestamp"), F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("OPEN"), F.lit(-1.0).alias("o"), F.col("value").cast("string").alias("Close"))
    clean = cleaning.normalised_headers(raw)
    clean = cleaning.numbers(clean.withColumn("open_time_utc", cleaning.parsed_time(clean, "open_time_utc")))
    return clean.select("event_id", F.col("open_time_utc").cast("timestamp_ntz").alias("open_time_utc"), "open", "close")


# ---------------------------------------------------------------- features and regimes


@register(
    "features_enriched",
    f"WITH {H}, {ENRICHED} SELECT symbol, t AS open_time_utc, {R('r', 'open_to_open_return')}, {R('lr', 'log_return')}, {R('vol', 'rolling_vol_24h')}, {rounded('sma_20 sma_50')}, wd AS weekday, nwd AS next_bar_weekday, regime AS market_regime FROM x",
)
def features_enriched(spark, d):
    rows = features.transform(hours(spark, d), K)
    return out(rows.select("symbol", "open_time_utc", "open_to_open_return", "log_return", "rolling_vol_24h", "sma_20", "sma_50", "weekday", "next_bar_weekday", "market_regime"))


BASE_COLUMNS = "simple_return log_return abs_log_return squared_log_return range_pct body_pct upper_wick_pct lower_wick_pct volume_change_pct rolling_volatility rolling_mean_return"


@register("features_base", f"WITH {H}, {BASE} SELECT symbol, t AS open_time_utc, {rounded(BASE_COLUMNS)}, hour_utc, day_of_week, date_utc FROM f")
def features_base(spark, d):
    return out(features.base_features(hours(spark, d), keys=K).select("symbol", "open_time_utc", *BASE_COLUMNS.split(), "hour_utc", "day_of_week", "date_utc"))


@register(
    "features_research",
    f"WITH {H}, {RESEARCH_SQL} SELECT symbol, t AS open_time_utc, {rounded(RESEARCH_COLUMNS)}, hour_utc, day_of_week_utc, is_weekend, volatility_regime_24h, volume_regime_168h FROM rf",
)
def features_research(spark, d):
    rows = features.research_features(hours(spark, d), K)
    return out(rows.select("symbol", "open_time_utc", *RESEARCH_COLUMNS.split(), "hour_utc", "day_of_week_utc", "is_weekend", "volatility_regime_24h", "volume_regime_168h"))


PATTERN_EVENTS = "vol_expansion_event vol_contraction_event high_volume_event low_volume_event " + " ".join(
    f"momentum_{x}_{m}h_event" for m in SMALL_PATTERNS.momentum_windows for x in ("up", "down")
)


@register(
    "features_pattern",
    f"WITH {H}, {pattern_features_sql(SMALL_PATTERNS)} SELECT symbol, t AS open_time_utc, {rounded('log_return rolling_vol_24h_past ' + ' '.join(f'fwd_log_return_{h}h fwd_simple_return_{h}h' for h in SMALL_PATTERNS.forward_horizons))}, "
    f"{R('rq50', 'rolling_range_median_168h_past')}, {R('vz', 'volume_zscore_168h_past')}, {PATTERN_EVENTS.replace(' ', ', ')} FROM pf",
)
def features_pattern(spark, d):
    rows = features.pattern_features(hours(spark, d), SMALL_PATTERNS, K)
    names = ["log_return", "rolling_vol_24h_past", *[f"fwd_{x}_return_{h}h" for h in SMALL_PATTERNS.forward_horizons for x in ("log", "simple")]]
    return out(rows.select("symbol", "open_time_utc", *names, "rolling_range_median_168h_past", "volume_zscore_168h_past", *PATTERN_EVENTS.split()))


@register(
    "regime_monthly",
    f"WITH {D}, m AS (SELECT symbol, CAST(date_trunc('month', t) AS DATE) AS month, arg_min(c, t) AS first_close, arg_max(c, t) AS last_close, arg_max(c, t) / arg_min(c, t) - 1 AS monthly_return FROM b GROUP BY ALL) "
    f"SELECT symbol, month, {rounded('first_close last_close monthly_return')}, CASE WHEN monthly_return >= 0.05 THEN 'Bull' WHEN monthly_return <= -0.05 THEN 'Bear' ELSE 'Lateral' END AS market_regime FROM m",
)
def regime_monthly(spark, d):
    return out(features.monthly_regimes(days(spark, d), K))


@register(
    "resample_daily_vol",
    f"WITH {H}, z AS (SELECT symbol, CAST(t AS DATE) AS day, ln(c / lag(c) {W}) AS r FROM b), pd AS (SELECT symbol, day, stddev_samp(r) * {math.sqrt(365)!r} AS dv FROM z GROUP BY ALL), "
    "sp AS (SELECT symbol, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM z GROUP BY symbol), "
    "j AS (SELECT sp.symbol, sp.day, dv FROM sp LEFT JOIN pd ON sp.symbol = pd.symbol AND sp.day = pd.day), "
    "fr AS (SELECT *, CASE WHEN count(dv) OVER w >= 7 THEN avg(dv) OVER w END AS rv FROM j WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS 6 PRECEDING)) "
    f"SELECT symbol, day, {R('dv', 'daily_vol')}, {R('rv', 'rolling_vol')} FROM fr",
)
def resample_daily_vol(spark, d):
    return out(features.daily_volatility(hours(spark, d), 7, K))


@register(
    "daily_ohlcv",
    f"WITH {H} SELECT symbol, CAST(t AS DATE) AS trade_date, {R('arg_min(o, t)', 'open_price')}, {R('max(h)', 'high_price')}, {R('min(l)', 'low_price')}, {R('arg_max(c, t)', 'close_price')}, {R('sum(v)', 'volume')}, count(*) AS bars, "
    f"{R('arg_max(c, t) / arg_min(o, t) - 1', 'daily_return')}, CAST(strftime(CAST(t AS DATE), '%Y%m%d') AS BIGINT) AS date_id FROM b GROUP BY symbol, CAST(t AS DATE)",
)
def daily_ohlcv(spark, d):
    return out(features.daily_ohlcv(hours(spark, d), K))


@register(
    "monthly_returns",
    f"WITH {D} SELECT symbol, strftime(t, '%Y-%m') AS year_month, {R('arg_min(o, t)', 'open_price')}, {R('max(h)', 'high_price')}, {R('min(l)', 'low_price')}, {R('arg_max(c, t)', 'close_price')}, {R('sum(v)', 'volume')}, count(*) AS bars, "
    f"{R('arg_max(c, t) / arg_min(o, t) - 1', 'monthly_return')} FROM b GROUP BY symbol, strftime(t, '%Y-%m')",
)
def monthly_returns(spark, d):
    return out(features.monthly_returns(days(spark, d), K))


@register(
    "silver",
    f"WITH {H} SELECT symbol, t AS open_time_utc, {R('c / o - 1', 'bar_return')}, {R('ln(c / o)', 'log_return')}, {R('(h - l) / o', 'range_pct')}, CAST(isodow(t) - 1 AS BIGINT) AS weekday, strftime(t, '%Y-%m') AS year_month FROM b",
)
def silver(spark, d):
    rows = hours(spark, d).withColumns({c: F.col(c).cast("string") for c in ("open", "high", "low", "close")})
    return out(features.silver(rows).select("symbol", "open_time_utc", "bar_return", "log_return", "range_pct", "weekday", "year_month"))


@register(
    "range_contraction",
    f"WITH {H}, rp AS (SELECT *, coalesce((h - l) / nullif(c, 0), 0) AS rp FROM b) SELECT symbol, t AS open_time_utc, {R('rp', 'range_pct')}, coalesce(rp < ({full('quantile_cont(rp, 0.2)', 'rp', 168, 1)}), false) AS low_range_contraction FROM rp",
)
def range_contraction(spark, d):
    return out(features.range_contraction(hours(spark, d), keys=K).select("symbol", "open_time_utc", "range_pct", "low_range_contraction"))


# ---------------------------------------------------------------- EDA


def _base(spark, d):
    return features.base_features(hours(spark, d), keys=K)


@register(
    "summary_stats",
    f"WITH {H}, {BASE}, {SUMMARY_LONG} SELECT symbol, metric, count(x) AS count, {R('avg(x)', 'mean')}, {R('median(x)', 'median')}, {R('stddev_samp(x)', 'std')}, {R('min(x)', 'min')}, "
    + ", ".join(R(f"quantile_cont(x, {q})", f"q{round(q * 100):02d}") for q in (0.01, 0.05, 0.95, 0.99))
    + f", {R('max(x)', 'max')}, {R('skewness(x)', 'skew')}, {R('kurtosis(x)', 'excess_kurtosis')}, "
    + R("CASE WHEN metric IN ('simple_return', 'log_return') THEN avg(x) * 8760 END", "annualized_mean_approx")
    + ", "
    + R(f"CASE WHEN metric IN ('simple_return', 'log_return') THEN stddev_samp(x) * {math.sqrt(8760.0)!r} END", "annualized_volatility_approx")
    + " FROM u WHERE x IS NOT NULL GROUP BY symbol, metric",
)
def summary_stats(spark, d):
    return out(eda.summary(_base(spark, d), K))


QUANTILE_LIST = "[" + ", ".join(map(str, eda.QUANTILES)) + "]"


@register(
    "return_quantiles",
    f"WITH {H}, {BASE}, q AS (SELECT symbol, unnest({QUANTILE_LIST}) AS quantile, "
    + ", ".join(f"unnest(quantile_cont({c}, {QUANTILE_LIST})) AS {c}" for c in ("simple_return", "log_return", "abs_log_return", "range_pct"))
    + f" FROM f GROUP BY symbol) SELECT symbol, {R('quantile', 'quantile')}, {rounded('simple_return log_return abs_log_return range_pct')} FROM q",
)
def return_quantiles(spark, d):
    return out(eda.return_quantiles(_base(spark, d), K))


VOL_SQL = f"count(log_return) AS observations, {R('avg(log_return)', 'mean_log_return')}, {R('stddev_samp(log_return)', 'volatility_std')}, {R('avg(abs_log_return)', 'mean_abs_return')}, {R('avg(range_pct)', 'mean_range_pct')}, {R('median(v)', 'median_volume')}"


@register("volatility_by_hour", f"WITH {H}, {BASE} SELECT symbol, hour_utc, {VOL_SQL} FROM f GROUP BY symbol, hour_utc")
def volatility_by_hour(spark, d):
    return out(eda.volatility_by_hour(_base(spark, d), K))


ES = "CASE day_of_week " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in zip(scalars.DAYS, scalars.DAYS_ES)) + " END"


@register("volatility_by_weekday", f"WITH {H}, {BASE} SELECT symbol, day_of_week, {ES} AS day_of_week_es, {VOL_SQL} FROM f GROUP BY symbol, day_of_week")
def volatility_by_weekday(spark, d):
    return out(eda.volatility_by_weekday(_base(spark, d), K))


def _behavior_sql(by: str) -> str:
    return f"""WITH {H}, {pattern_features_sql(SMALL_PATTERNS)} SELECT symbol, {by}, count(t) AS candles, {R('avg(log_return)', 'mean_log_return')}, {R('median(log_return)', 'median_log_return')}, {R('stddev_samp(log_return)', 'volatility')},
  {R('avg(abs_log_return)', 'mean_abs_log_return')}, {R('avg(range_pct)', 'mean_range_pct')}, {R('median(v)', 'median_volume')}, {R('avg(CAST(coalesce(log_return > 0, false) AS INT))', 'positive_rate')},
  {R('avg(fwd_log_return_1h)', 'mean_fwd_1h')}, {R('avg(CAST(coalesce(fwd_log_return_1h > 0, false) AS INT))', 'positive_fwd_1h_rate')} FROM pf GROUP BY symbol, {by}"""


@register("hourly_behavior", _behavior_sql("hour_utc"))
def hourly_behavior(spark, d):
    return out(eda.behavior(features.pattern_features(hours(spark, d), SMALL_PATTERNS, K), "hour_utc", K))


@register("weekday_behavior", _behavior_sql("day_of_week"))
def weekday_behavior(spark, d):
    return out(eda.behavior(features.pattern_features(hours(spark, d), SMALL_PATTERNS, K), "day_of_week", K))


STREAK_SQL = f"""d0 AS (SELECT symbol, t, log_return, CASE WHEN log_return > 0 THEN 'up' WHEN log_return < 0 THEN 'down' ELSE 'flat' END AS direction FROM f WHERE log_return IS NOT NULL),
d1 AS (SELECT *, CASE WHEN direction IS DISTINCT FROM lag(direction) {W} THEN 1 ELSE 0 END AS nw FROM d0),
d2 AS (SELECT *, sum(nw) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING) AS gr FROM d1),
sk AS (SELECT symbol, direction, min(t) AS start_time_utc, max(t) AS end_time_utc, count(*) AS length_bars, sum(log_return) AS cumulative_log_return FROM d2 WHERE direction <> 'flat' GROUP BY symbol, gr, direction)"""


@register("streaks", f"WITH {H}, {BASE}, {STREAK_SQL} SELECT symbol, direction, start_time_utc, end_time_utc, length_bars, {rounded('cumulative_log_return')} FROM sk")
def streaks(spark, d):
    return out(eda.streaks(_base(spark, d), K))


@register(
    "streak_summary",
    f"WITH {H}, {BASE}, {STREAK_SQL} SELECT symbol, direction, count(*) AS streak_count, {R('avg(length_bars)', 'mean_length')}, {R('median(length_bars)', 'median_length')}, max(length_bars) AS max_length, "
    f"{R('avg(cumulative_log_return)', 'mean_cumulative_log_return')}, {R('max(abs(cumulative_log_return))', 'max_abs_cumulative_log_return')} FROM sk GROUP BY symbol, direction",
)
def streak_summary(spark, d):
    return out(eda.streak_summary(eda.streaks(_base(spark, d), K), K))


@register(
    "trend_persistence",
    f"WITH {H}, {BASE}, d0 AS (SELECT symbol, t, CASE WHEN log_return > 0 THEN 'up' ELSE 'down' END AS cur FROM f WHERE log_return > 0 OR log_return < 0), d1 AS (SELECT *, lead(cur) {W} AS nxt FROM d0), d2 AS (SELECT * FROM d1 WHERE nxt IS NOT NULL) "
    f"SELECT symbol, cur AS current_direction, {R("avg(CAST(nxt = 'up' AS INT))", 'prob_next_up')}, {R("avg(CAST(nxt = 'down' AS INT))", 'prob_next_down')}, {R('avg(CAST(cur = nxt AS INT))', 'persistence_probability')} FROM d2 GROUP BY symbol, cur "
    f"UNION ALL SELECT symbol, 'overall', NULL, NULL, {R('avg(CAST(cur = nxt AS INT))', 'persistence_probability')} FROM d2 GROUP BY symbol",
)
def trend_persistence(spark, d):
    return out(eda.persistence(_base(spark, d), K))


@register(
    "autocorrelation",
    f"WITH {H}, {BASE}, lr AS (SELECT symbol, t, log_return AS r FROM f WHERE log_return IS NOT NULL), "
    + "al AS ("
    + " UNION ALL ".join(f"SELECT symbol, {k} AS lag, r, lag(r, {k}) {W} AS p FROM lr" for k in range(1, 49))
    + f") SELECT symbol, CAST(lag AS BIGINT) AS lag, {R('corr(r, p)', 'autocorrelation')} FROM al GROUP BY symbol, lag",
)
def autocorrelation(spark, d):
    return out(eda.autocorrelation(_base(spark, d), 48, K))


PAIRS_SQL = " UNION ALL ".join(f"SELECT symbol, '{x}' AS x, '{y}' AS y, {'v' if x == 'volume' else 'ln(1 + v)'} AS a, {y} AS b FROM f" for x, y in eda.PAIRS)


@register(
    "correlations",
    f"WITH {H}, {BASE}, pr AS (SELECT * FROM ({PAIRS_SQL}) WHERE a IS NOT NULL AND b IS NOT NULL), "
    "rk AS (SELECT *, rank() OVER (PARTITION BY symbol, x, y ORDER BY a) + (count(*) OVER (PARTITION BY symbol, x, y, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY symbol, x, y ORDER BY b) + (count(*) OVER (PARTITION BY symbol, x, y, b) - 1) / 2.0 AS rb FROM pr) "
    f"SELECT symbol, x, y, {R('corr(a, b)', 'pearson_correlation')}, {R('corr(ra, rb)', 'spearman_correlation')}, count(*) AS observations FROM rk GROUP BY symbol, x, y",
)
def correlations(spark, d):
    return out(eda.correlations(_base(spark, d), K))


EVENTS_SQL = f"""dd0 AS (SELECT symbol, t, c, c / max(c) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM b),
dd1 AS (SELECT *, sum(CASE WHEN dd = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING) AS gr, max(t) OVER (PARTITION BY symbol) AS lt FROM dd0),
dd2 AS (SELECT symbol, gr, min(t) AS pt, arg_min(c, t) AS pc, arg_min(t, (dd, t)) FILTER (WHERE dd < 0) AS tt, arg_min(c, (dd, t)) FILTER (WHERE dd < 0) AS tc, min(dd) FILTER (WHERE dd < 0) AS md, any_value(lt) AS lt FROM dd1 GROUP BY symbol, gr),
ev AS (SELECT a.symbol, a.pt AS peak_time_utc, a.tt AS trough_time_utc, z.pt AS recovery_time_utc, a.pc AS peak_close, a.tc AS trough_close, a.md AS max_drawdown,
  (epoch(coalesce(z.pt, a.lt)) - epoch(a.pt)) / 3600 AS duration_hours_peak_to_recovery, (epoch(z.pt) - epoch(a.tt)) / 3600 AS duration_hours_trough_to_recovery, z.pt IS NOT NULL AS recovered
  FROM dd2 a LEFT JOIN dd2 z ON a.symbol = z.symbol AND z.gr = a.gr + 1 WHERE a.md IS NOT NULL)"""


@register(
    "drawdown_events",
    f"WITH {D}, {EVENTS_SQL} SELECT symbol, peak_time_utc, trough_time_utc, recovery_time_utc, {rounded('peak_close trough_close max_drawdown duration_hours_peak_to_recovery duration_hours_trough_to_recovery')}, recovered FROM ev",
)
def drawdown_events(spark, d):
    return out(events(drawdown_series(days(spark, d), K), K))


@register(
    "extreme_bars",
    f"WITH {H}, {BASE}, cm AS (SELECT symbol, t, abs_log_return AS a FROM f WHERE log_return IS NOT NULL AND v IS NOT NULL AND range_pct IS NOT NULL), cu AS (SELECT symbol, quantile_cont(a, 0.999) AS k FROM cm GROUP BY symbol), "
    "rk AS (SELECT cm.symbol, t, a, row_number() OVER (PARTITION BY cm.symbol ORDER BY a DESC, t) AS n FROM cm JOIN cu USING (symbol) WHERE a >= k) "
    f"SELECT symbol, 'extreme_bar' AS type, {R('a', 'value')}, t AS timestamp_utc FROM rk WHERE n <= 20",
)
def extreme_bars(spark, d):
    found = research.exploration(hours(spark, d), keys=K)["anomalies"].where("type = 'extreme_bar'")
    return out(found.select("symbol", "type", "value", "timestamp_utc"))


@register("anomalies")
def anomalies(spark, d):
    return out(research.exploration(hours(spark, d), keys=K)["anomalies"])


@register(
    "price_histogram",
    f"WITH {H}, mm AS (SELECT symbol, min(c) AS a, max(c) AS z FROM b GROUP BY symbol), bn AS (SELECT b.symbol, least(CAST(floor((c - a) / nullif((z - a) / 50, 0)) AS BIGINT), 49) AS bin, a, (z - a) / 50 AS w FROM b JOIN mm USING (symbol)) "
    f"SELECT symbol, coalesce(bin, 0) AS bin, {R('any_value(a + coalesce(bin, 0) * w)', 'left')}, count(*) AS count FROM bn GROUP BY symbol, coalesce(bin, 0)".replace("AS left", 'AS "left"'),
)
def price_histogram(spark, d):
    return out(eda.histogram(hours(spark, d), "close", 50, K))


# ---------------------------------------------------------------- patterns


def _pattern_sql() -> str:
    each = ", ".join(f"CASE WHEN {c} THEN ('{k}', '{n}') END" for k, n, c in conditions_sql(SMALL_PATTERNS))
    names = ", ".join(f"('{k}', '{n}')" for k, n, _ in conditions_sql(SMALL_PATTERNS))
    fw = " UNION ALL ".join(f"SELECT *, {h} AS hz, fwd_log_return_{h}h AS r FROM pf WHERE fwd_log_return_{h}h IS NOT NULL" for h in SMALL_PATTERNS.forward_horizons)
    return f"""WITH {H}, {pattern_features_sql(SMALL_PATTERNS)}, fw AS ({fw}), lo AS (SELECT symbol, hz, r, unnest(list_filter([{each}], lambda u: u IS NOT NULL)) AS u FROM fw),
sm AS (SELECT symbol, hz, u[1] AS category, u[2] AS condition_name, count(*) AS n, avg(r) AS mean, median(r) AS med, stddev_samp(r) AS sd, avg(CAST(r > 0 AS INT)) AS pr FROM lo GROUP BY ALL),
ba AS (SELECT symbol, hz, count(*) AS bn, avg(r) AS bm, avg(CAST(r > 0 AS INT)) AS bp FROM fw GROUP BY ALL),
nm AS (SELECT u[1] AS category, u[2] AS condition_name FROM (SELECT unnest([{names}]) AS u))
SELECT ba.symbol, nm.category, nm.condition_name, CAST(ba.hz AS BIGINT) AS forward_horizon_h, coalesce(n, 0) AS sample_count, bn AS baseline_count, {R('coalesce(n, 0) / bn', 'frequency')}, {R('mean', 'sample_mean_fwd_log_return')},
  {R('med', 'sample_median_fwd_log_return')}, {R('sd', 'sample_std_fwd_log_return')}, {R('pr', 'sample_positive_rate')}, {R('bm', 'baseline_mean_fwd_log_return')}, {R('bp', 'baseline_positive_rate')}, {R('mean - bm', 'mean_diff_vs_baseline')}
FROM ba CROSS JOIN nm LEFT JOIN sm ON sm.symbol = ba.symbol AND sm.hz = ba.hz AND sm.category = nm.category AND sm.condition_name = nm.condition_name"""


@register("pattern_stats", _pattern_sql())
def pattern_stats(spark, d):
    return out(patterns.pattern_stats(features.pattern_features(hours(spark, d), SMALL_PATTERNS, K), SMALL_PATTERNS, K))


@register("pattern_evidence")
def pattern_evidence(spark, d):
    return out(patterns.top_evidence(research.pattern_discovery(hours(spark, d), SMALL_PATTERNS, K)))


# ---------------------------------------------------------------- views, queries and exports

KLINES_SQL = f"""{H}, {ENRICHED}, klines AS (SELECT symbol, '1h' AS interval, t AS open_time_utc, o AS open, h AS high, l AS low, c AS close, r AS open_to_open_return, vol AS rolling_vol_24h, nwd AS next_bar_weekday, regime AS market_regime FROM x)"""


def _klines(spark, d):
    return features.transform(hours(spark, d), K)


def pct(expr: str, name: str, digits: int = 4) -> str:
    return f"round(100 * ({expr}), {digits}) + 0.0 AS {name}"


DAY_LIST = str(list(scalars.DAYS))
RETURN_STATS = ", ".join(pct(f"{f}(open_to_open_return)", f"{n}_return_pct") for n, f in (("avg", "avg"), ("stddev", "stddev_samp"), ("min", "min"), ("max", "max")))
REGIME_SQL = f"""SELECT symbol, market_regime, CAST(next_bar_weekday AS BIGINT) AS next_bar_weekday, {DAY_LIST}[next_bar_weekday + 1] AS weekday_name, count(open_to_open_return) AS bar_count, {RETURN_STATS}
FROM klines GROUP BY symbol, market_regime, next_bar_weekday HAVING count(open_to_open_return) > 0 AND market_regime IS NOT NULL AND next_bar_weekday IS NOT NULL"""


@register(
    "vw_daily_returns",
    f"WITH {KLINES_SQL} SELECT symbol, CAST(date_trunc('day', open_time_utc) AS DATE) AS trade_date, {R('sum(open_to_open_return)', 'daily_return')}, {R('avg(rolling_vol_24h)', 'avg_volatility')}, "
    f"{R('max(high)', 'day_high')}, {R('min(low)', 'day_low')}, max(market_regime) AS market_regime, count(*) AS bars_count FROM (FROM klines WHERE open_to_open_return = open_to_open_return) GROUP BY ALL",
)
def vw_daily_returns(spark, d):
    return out(views.daily_returns(_klines(spark, d)))


@register("vw_regime_stats", f"WITH {KLINES_SQL} {REGIME_SQL}")
def vw_regime_stats(spark, d):
    views.register(spark, klines=_klines(spark, d))
    return out(spark.table("vw_regime_stats"))


@register(
    "q_availability",
    f"WITH {KLINES_SQL}, n AS (SELECT symbol, market_regime, count(*) AS bars, min(open_time_utc) AS a, max(open_time_utc) AS b FROM klines GROUP BY ALL) SELECT symbol, CAST(sum(bars) AS BIGINT) AS total_bars, "
    "CAST(min(a) AS DATE) AS first_date, CAST(max(b) AS DATE) AS last_date, "
    + ", ".join(f"CAST(coalesce(sum(CASE market_regime WHEN '{x}' THEN bars END), 0) AS BIGINT) AS {x.lower()}_bars" for x in ("Bull", "Bear", "Lateral"))
    + " FROM n GROUP BY symbol",
)
def q_availability(spark, d):
    views.register(spark, klines=_klines(spark, d))
    return out(views.query(spark, "availability"))


@register(
    "q_weekday_returns",
    f"WITH {KLINES_SQL}, v AS (SELECT symbol, CASE WHEN next_bar_weekday IS NOT NULL THEN next_bar_weekday::BIGINT::VARCHAR || '-' || {DAY_LIST}[next_bar_weekday + 1] END AS weekday, open_to_open_return AS r FROM klines) "
    f"SELECT symbol, weekday, count(r) AS bars, {pct('avg(r)', 'avg_return_pct')}, {pct('sqrt(var_samp(r))', 'stddev_pct')} FROM v WHERE r IS NOT NULL GROUP BY symbol, weekday",
)
def q_weekday_returns(spark, d):
    return out(views.weekday_returns(_klines(spark, d)))


@register(
    "q_worst_days_by_regime",
    f"WITH {KLINES_SQL}, s AS ({REGIME_SQL}) SELECT market_regime, weekday_name, avg_return_pct, bar_count FROM s WHERE symbol = 'click'",
)
def q_worst_days_by_regime(spark, d):
    return out(views.worst_days_by_regime(_klines(spark, d), "click"))


@register(
    "q_return_outliers",
    f"WITH {KLINES_SQL}, f AS (SELECT *, row_number() OVER (ORDER BY greatest(open_to_open_return, -open_to_open_return) DESC, symbol, open_time_utc) AS place FROM klines WHERE open_to_open_return NOT BETWEEN -0.10 AND 0.10) "
    f"SELECT symbol, open_time_utc, {rounded('open close')}, {pct('open_to_open_return', 'return_pct')}, market_regime FROM f WHERE place <= 20",
)
def q_return_outliers(spark, d):
    return out(views.return_outliers(_klines(spark, d)))


KPI_INNER = f"""{CATALOG_SQL}, {bt_sql('s', 'symbol, strategy_id')}, {metrics_sql('bt', 'symbol, strategy_id', 8760.0)},
{trades_sql('bt', 'symbol, strategy_id')}, tm AS ({trade_metrics_sql('tr', 'symbol, strategy_id')}), ex AS (SELECT symbol, strategy_id, avg(CAST(pos > 0 AS INT)) AS pos_pct FROM bt GROUP BY ALL),
re AS (SELECT m.symbol, strategy_id AS strategy_name, strategy_total_return AS total_return, benchmark_total_return AS bh_return, strategy_total_return - benchmark_total_return AS excess_return, strategy_sharpe AS sharpe_ratio,
  strategy_max_drawdown AS max_drawdown, strategy_cagr AS cagr, strategy_win_rate AS win_rate, strategy_profit_factor AS profit_factor, CAST(coalesce(strategy_trade_count, 0) AS BIGINT) AS total_trades, pos_pct,
  CAST(NULL AS DOUBLE) AS beat_pct, CAST(NULL AS DOUBLE) AS mc_percentile FROM m LEFT JOIN tm USING (symbol, strategy_id) JOIN ex USING (symbol, strategy_id)),
backtest_results AS (SELECT *, DATE '2024-02-01' AS run_date FROM re UNION ALL SELECT * REPLACE (total_return - 1 AS total_return), DATE '2024-01-01' FROM re)"""


def results_table(spark, d):
    """Two runs of the catalog; the older one with other returns."""
    rules = [*signals.CATALOG, *signals.BASELINES[:2]]
    run = bt.backtest(signals.with_signals(hours(spark, d), rules, K), KS)
    held = run.groupBy(*KS).agg(F.avg((F.col("position") > 0).cast("double")).alias("pos_pct"))
    rows = bt.metrics(run, KS).join(bt.trade_metrics(bt.trades(run, KS), KS), KS, "left").join(held, KS)
    none = F.lit(None).cast("double")
    now = rows.select(
        "symbol",
        F.col("strategy_id").alias("strategy_name"),
        F.lit("2024-02-01").cast("date").alias("run_date"),
        F.col("strategy_total_return").alias("total_return"),
        F.col("benchmark_total_return").alias("bh_return"),
        F.col("excess_total_return_vs_benchmark").alias("excess_return"),
        F.col("strategy_sharpe").alias("sharpe_ratio"),
        F.col("strategy_max_drawdown").alias("max_drawdown"),
        F.col("strategy_cagr").alias("cagr"),
        F.col("strategy_win_rate").alias("win_rate"),
        F.col("strategy_profit_factor").alias("profit_factor"),
        F.coalesce("strategy_trade_count", F.lit(0.0)).cast("long").alias("total_trades"),
        "pos_pct",
        none.alias("beat_pct"),
        none.alias("mc_percentile"),
    )
    return now.unionByName(now.withColumns({"run_date": F.lit("2024-01-01").cast("date"), "total_return": F.col("total_return") - 1}))


KPI_PCT = {"total_return": "total_return_pct", "bh_return": "bh_return_pct", "excess_return": "excess_return_pct", "max_drawdown": "max_drawdown_pct", "cagr": "cagr_pct", "pos_pct": "exposure_pct",
           "beat_pct": "beat_bh_months_pct", "mc_percentile": "mc_percentile_pct"}
KPI_SQL = f"""{KPI_INNER}, rk AS (SELECT *, rank() OVER (PARTITION BY symbol, strategy_name ORDER BY run_date DESC) AS place FROM backtest_results),
kpi AS (SELECT symbol, strategy_name, run_date, {", ".join(pct(old, new, 2) for old, new in KPI_PCT.items())}, round(sharpe_ratio, 2) + 0.0 AS sharpe_ratio, {rounded('win_rate profit_factor')}, total_trades FROM rk WHERE place = 1)"""


@register("vw_strategy_kpi", f"WITH {KPI_SQL} SELECT * FROM kpi")
def vw_strategy_kpi(spark, d):
    views.register(spark, backtest_results=results_table(spark, d))
    return out(spark.table("vw_strategy_kpi"))


@register("q_strategy_comparison", f"WITH {KPI_SQL} SELECT symbol, strategy_name, total_return_pct, sharpe_ratio, max_drawdown_pct, exposure_pct, mc_percentile_pct FROM kpi")
def q_strategy_comparison(spark, d):
    return out(views.strategy_comparison(results_table(spark, d)))


@register(
    "bi_measures",
    f"WITH {KPI_SQL}, own AS (SELECT symbol, total_return_pct AS mine FROM kpi WHERE strategy_name = 'S2_H2_WEDNESDAY_LONG') SELECT symbol, {R('max(total_return_pct)', 'best_return_pct')}, "
    f"{R('sum(sharpe_ratio) / count(sharpe_ratio)', 'avg_sharpe')}, {R('max(mine)', 'strategy_return_pct')} FROM kpi LEFT JOIN own USING (symbol) GROUP BY symbol",
)
def bi_measures(spark, d):
    views.register(spark, backtest_results=results_table(spark, d))
    return out(views.query(spark, "measures", strategy="S2_H2_WEDNESDAY_LONG"))


QUALITY_INNER = _quality_sql(BAD, None)


@register(
    "vw_data_quality_summary",
    f"SELECT symbol, check_name, severity, TIMESTAMP '2024-02-01' AS last_run, CAST(sum(total_rows) AS BIGINT) AS total_rows, CAST(sum(failed_rows) AS BIGINT) AS total_failed, round(avg(pass_rate) * 100, 2) + 0.0 AS avg_pass_rate_pct FROM ({QUALITY_INNER}) GROUP BY ALL",
)
def vw_data_quality_summary(spark, d):
    return out(views.quality_overview(quality_checks_bad(spark, d).withColumn("run_at", F.lit("2024-02-01").cast("timestamp"))))


@register(
    "export_weekday_returns",
    f"WITH {H}, {ENRICHED}, w AS (SELECT symbol, nwd, count(r) AS n, avg(r) AS a, stddev_samp(r) AS s, min(r) AS mi, max(r) AS ma, avg(CAST(r > 0 AS INT)) AS p FROM x WHERE r IS NOT NULL AND nwd IS NOT NULL GROUP BY ALL) "
    f"SELECT symbol, nwd AS next_bar_weekday, {str(list(scalars.DAYS))}[nwd + 1] AS weekday_name, n AS bar_count, {R('a', 'avg_return')}, {R('s', 'std_return')}, {R('mi', 'min_return')}, {R('ma', 'max_return')}, {R('p', 'pos_rate')}, "
    "round_even(a * 100, 4) + 0.0 AS avg_return_pct, round_even(s * 100, 4) + 0.0 AS std_return_pct, round_even(a / s, 4) + 0.0 AS sharpe FROM w",
)
def export_weekday_returns(spark, d):
    return out(exports.weekday_returns(hours(spark, d), K))


@register(
    "export_regime_heatmap",
    f"WITH {D}, {ENRICHED} SELECT symbol, regime AS market_regime, nwd AS next_bar_weekday, {str(list(scalars.DAYS))}[nwd + 1] AS weekday_name, count(*) AS bar_count, {R('avg(r)', 'avg_return')}, round_even(avg(r) * 100, 4) + 0.0 AS avg_return_pct "
    "FROM x WHERE r IS NOT NULL AND nwd IS NOT NULL GROUP BY symbol, regime, nwd",
)
def export_regime_heatmap(spark, d):
    return out(exports.regime_heatmap(days(spark, d), K))


@register(
    "export_equity_curves",
    f"WITH {H}, s AS ({AUDIT_SIGNALS.format(src='b', keys='symbol')}), {bt_sql('s', 'symbol, strategy_id')} SELECT symbol, strategy_id AS strategy, t AS date, {R('eq', 'equity')} FROM bt",
)
def export_equity_curves(spark, d):
    run = bt.backtest(signals.with_signals(hours(spark, d), signals.AUDITED, K), KS)
    return out(exports.equity_curves(run.select("symbol", "strategy_id", "open_time_utc", "equity")))


@register(
    "export_strategy_kpi",
    f"WITH {KPI_INNER} SELECT symbol, strategy_name AS strategy, round_even(total_return * 100, 2) + 0.0 AS total_return_pct, round_even(bh_return * 100, 2) + 0.0 AS bh_return_pct, round_even(excess_return * 100, 2) + 0.0 AS excess_return_pct, "
    f"{R('sharpe_ratio', 'sharpe')}, round_even(max_drawdown * 100, 2) + 0.0 AS max_drawdown_pct, {rounded('win_rate profit_factor')}, round_even(pos_pct * 100, 1) + 0.0 AS exposure_pct FROM backtest_results WHERE run_date = DATE '2024-02-01'",
)
def export_strategy_kpi(spark, d):
    rows = results_table(spark, d).where("run_date = '2024-02-01'").withColumnsRenamed({"strategy_name": "strategy", "excess_return": "excess", "sharpe_ratio": "sharpe"})
    return out(exports.strategy_kpi(rows).drop("beat_bh_pct", "mc_percentile"))


# ---------------------------------------------------------------- exposure, resampling and verdicts


def _exposure_sql() -> str:
    on = ", ".join(f"product(CASE WHEN wd = {k} THEN 1 + r ELSE 1.0 END) - 1 AS on{k}, product(CASE WHEN wd <> {k} THEN 1 + r ELSE 1.0 END) - 1 AS off{k}" for k in range(7))
    each = ", ".join(f"('{rule}', {k}, {side}{k}, {p})" for rule, side, p in (("long_wednesday", "on", "p2"), ("avoid_thursday", "off", "p3")) for k in range(7))
    return f"""{H}, mk AS (SELECT symbol, CAST(isodow(t) - 1 AS BIGINT) AS wd, lead(o) {W} / o - 1 AS r FROM b), mr AS (SELECT * FROM mk WHERE r IS NOT NULL),
sh AS (SELECT symbol, product(1 + r) - 1 AS bh, avg(CAST(wd = 2 AS INT)) AS p2, avg(CAST(wd <> 3 AS INT)) AS p3, {on} FROM mr GROUP BY symbol),
fr AS (SELECT mr.symbol, product(1 + p2 * r) - 1 AS f2, product(1 + p3 * r) - 1 AS f3 FROM mr JOIN sh USING (symbol) GROUP BY mr.symbol),
un AS (SELECT symbol, bh, unnest([{each}]) AS u FROM sh),
ra AS (SELECT symbol, bh, u[1] AS rule, u[2] AS weekday, u[3] AS tr, u[4] AS ex, rank() OVER (PARTITION BY symbol, u[1] ORDER BY u[3] DESC) AS day_rank, first_value(u[2]) OVER (PARTITION BY symbol, u[1] ORDER BY u[3] DESC) AS best FROM un),
eb AS (SELECT ra.symbol, bh, rule, weekday, tr, ex, day_rank, best, CASE rule WHEN 'long_wednesday' THEN f2 ELSE f3 END AS fb FROM ra JOIN fr USING (symbol) WHERE weekday = CASE rule WHEN 'long_wednesday' THEN 2 ELSE 3 END)"""


@register(
    "exposure_benchmark",
    f"WITH {_exposure_sql()} SELECT symbol, {R('bh', 'buy_hold')}, rule, CAST(weekday AS BIGINT) AS weekday, {R('tr', 'total_return')}, {R('ex', 'exposure')}, day_rank, CAST(best AS BIGINT) AS best_weekday, {R('fb', 'fractional_buy_hold')}, {R('tr - bh', 'excess_vs_buy_hold')}, {R('tr - fb', 'excess_vs_fractional')} FROM eb",
)
def exposure_benchmark(spark, d):
    return out(montecarlo.exposure_benchmark(montecarlo.exposure_returns(hours(spark, d), K), K))


@register("verdict_exposure")
def verdict_exposure(spark, d):
    returns = montecarlo.exposure_returns(hours(spark, d), K)
    found = montecarlo.exposure_benchmark(returns, K)
    runs = montecarlo.exposure_runs(returns, found, K).select(*K, "rule", "mc_percentile")
    return out(verdicts.exposure_verdict(found.join(runs, [*K, "rule"])))


@register(
    "verdict_exposure_by_rank",
    f"""WITH {_exposure_sql()}, vr AS (SELECT rule, count(*) AS assets, count(*) FILTER (WHERE tr - fb > 0) AS beat, avg(tr - fb) AS me, median((7 - day_rank) / 7.0) AS mp FROM eb GROUP BY rule)
SELECT rule, assets, beat, {R('me', 'mean_excess')}, {R('mp', 'median_percentile')}, CASE WHEN beat >= 3 AND mp > 0.7 THEN 'GENUINE_EDGE' WHEN beat >= 2 AND mp > 0.5 THEN 'PARTIAL_EDGE' ELSE 'EXPOSURE_ARTEFACT' END AS verdict FROM vr""",
)
def verdict_exposure_by_rank(spark, d):
    """The verdict rule over a percentile without chance: the share of weekdays the rule's day beats."""
    found = montecarlo.exposure_benchmark(montecarlo.exposure_returns(hours(spark, d), K), K)
    return out(verdicts.exposure_verdict(found.withColumn("rank_percentile", (7 - F.col("day_rank")) / 7.0), "rank_percentile"))


@register("mc_block_bootstrap")
def mc_block_bootstrap(spark, d):
    run = bt.backtest(signals.with_signals(hours(spark, d), signals.AUDITED, K), KS, HOURLY)
    return out(montecarlo.summary(montecarlo.block_bootstrap(run, KS, HOURLY), KS))


@register("mc_exposure")
def mc_exposure(spark, d):
    returns = montecarlo.exposure_returns(hours(spark, d), K)
    return out(montecarlo.exposure_runs(returns, montecarlo.exposure_benchmark(returns, K), K))


@register("verdict_research_status")
def verdict_research_status(spark, d):
    return out(research.strategy_lab(days(spark, d), DAILY, K)["status"])


@register("verdict_audit")
def verdict_audit(spark, d):
    return out(research.audit(hours(spark, d), HOURLY, K)["verdict"])


@register("verdict_institutional")
def verdict_institutional(spark, d):
    bars = days(spark, d)
    audited = research.audit(bars, DAILY, K)["verdict"]
    return out(research.institutional(bars, audited, DAILY, WIDE_REGIME, CRISIS, K)["verdict"])


@register(
    "upsert_merge",
    f"WITH {H}, nw AS (SELECT * REPLACE (c + 1 AS c) FROM b WHERE hour(t) < 6), al AS (SELECT *, 0 AS side FROM b WHERE hour(t) < 12 UNION ALL SELECT *, 1 FROM nw), rk AS (SELECT *, row_number() OVER (PARTITION BY symbol, t ORDER BY side DESC) AS k FROM al) "
    f"SELECT symbol, t AS open_time_utc, {R('c', 'close')} FROM rk WHERE k = 1",
)
def upsert_merge(spark, d):
    from .sources.sinks import merged

    bars = hours(spark, d)
    old = bars.where(F.hour("open_time_utc") < 12)
    new = bars.where(F.hour("open_time_utc") < 6).withColumn("close", F.col("close") + 1)
    return out(merged(old, new, ("symbol", "interval", "open_time_utc")).select("symbol", "open_time_utc", "close"))


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
