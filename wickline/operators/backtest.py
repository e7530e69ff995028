"""Open-to-open backtests, their trades and their metrics.

A signal at one bar's close is a position in the next bar, from its open to
the open after it.  Every function works on long tables: ``keys`` name the
series, and may hold strategies, variants, scenarios, samples or windows
besides the instrument, so a grid or a stress test is more rows, not a loop.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BacktestConfig
from ..functions.scalars import change, clipped, divide, finite
from . import frames

#: What a metric table has besides its keys, before the label.
METRICS = (
    "total_return",
    "cagr",
    "sharpe",
    "sortino",
    "calmar",
    "max_drawdown",
    "final_equity",
    "mean_period_return",
    "std_period_return",
    "n_bars",
    "years",
)
TRADE_METRICS = ("trade_count", "win_rate", "profit_factor", "expectancy", "avg_trade_return", "avg_bars_held")


def backtest(
    signals: DataFrame,
    keys: Sequence[str],
    config: BacktestConfig = BacktestConfig(),
    cost_rate: Column | None = None,
    whole_positions: bool = False,
    chunk: int | None = None,
) -> DataFrame:
    """Bars of ``signals`` (keys, open_time_utc, open, signal, ...) with positions, returns, equity and drawdown.

    Each series' last bar, which has no next open, is left out.  A period that
    loses everything is an error.  ``cost_rate``: costs a side where they vary
    by row.  ``whole_positions``: other signals than 0 and 1 are an error.
    """
    rows = signals if "idx" in signals.columns else frames.indexed(signals, keys, chunk=chunk)
    signal = clipped(F.col("signal"))
    if whole_positions:
        signal = F.when(signal.isin(0.0, 1.0), signal).otherwise(F.raise_error(F.lit("a position must be 0 or 1")))
    rate = F.lit(config.cost_rate) if cost_rate is None else cost_rate
    rows = frames.spread(rows.withColumn("_target", signal), 2, 1, chunk)
    w = frames.over(keys, rows)
    start = F.col("idx") == 0
    rows = rows.withColumns(
        {
            "position": F.when(start, F.lit(0.0)).otherwise(F.coalesce(F.lag("_target").over(w), F.lit(0.0))),
            "_before": F.when(F.col("idx") <= 1, F.lit(0.0)).otherwise(F.coalesce(F.lag("_target", 2).over(w), F.lit(0.0))),
            "market_return": change(F.lead("open").over(w), F.col("open")),
        }
    )
    rows = frames.trim(rows, chunk).where("market_return IS NOT NULL")
    rows = rows.withColumn("turnover", F.abs(F.col("position") - F.col("_before"))).withColumn("cost", F.col("turnover") * rate)
    net = F.col("position") * F.col("market_return") - F.col("cost")
    rows = rows.withColumn("strategy_return", F.when(net > -1, net).otherwise(F.raise_error(F.lit("a period loses all capital")).cast("double")))
    rows = rows.withColumn("bh_return", F.col("market_return")).drop("_target", "_before")
    return with_equity(rows, keys, config.initial_capital, chunk)


def with_equity(rows: DataFrame, keys: Sequence[str], capital: float, chunk: int | None = None) -> DataFrame:
    """equity, bh_equity and their drawdowns from the returns; null returns count as 0."""
    growth = {n: ("product", 1 + F.coalesce(F.col(r), F.lit(0.0))) for n, r in (("equity", "strategy_return"), ("bh_equity", "bh_return"))}
    rows = frames.running(rows, keys, growth, chunk).withColumns({n: F.col(n) * capital for n in growth})
    rows = frames.running(rows, keys, {"_peak": ("max", F.col("equity")), "_bh_peak": ("max", F.col("bh_equity"))}, chunk)
    return rows.withColumns(
        {"drawdown": F.col("equity") / F.col("_peak") - 1, "bh_drawdown": F.col("bh_equity") / F.col("_bh_peak") - 1}
    ).drop("_peak", "_bh_peak")


def _metric_columns(ret: str, equity: str, drawdown: str, config: BacktestConfig, from_first: bool) -> tuple[list[Column], dict[str, Column]]:
    """Aggregates, and the metrics from them."""
    r = finite(F.col(ret))
    p = f"_{equity}"
    aggs = [
        F.count(r).alias(f"{p}_n"),
        F.avg(r).alias(f"{p}_mean"),
        F.stddev_samp(r).alias(f"{p}_std"),
        F.stddev_samp(F.when(r < 0, r)).alias(f"{p}_down"),
        F.max_by(equity, "idx").alias(f"{p}_last"),
        F.min_by(equity, "idx").alias(f"{p}_first"),
        F.min(drawdown).alias(f"{p}_dd"),
    ]
    c = lambda n: F.col(f"{p}_{n}")
    base = c("first") if from_first else F.lit(config.initial_capital)
    years = F.greatest(c("n") / config.annualization_factor, F.lit(1e-12))
    grown = divide(c("last"), base)
    root = math.sqrt(config.annualization_factor)
    # A power beyond double's range is no rate.
    cagr = finite(F.when(c("last") > 0, F.pow(grown, 1 / years) - 1))
    out = {
        "total_return": c("last") / config.initial_capital - 1,
        "cagr": cagr,
        "sharpe": divide(c("mean"), c("std")) * root,
        "sortino": divide(c("mean"), c("down")) * root,
        "calmar": F.when(c("dd") < 0, divide(cagr, F.abs(c("dd")))),
        "max_drawdown": c("dd"),
        "final_equity": c("last"),
        "mean_period_return": c("mean"),
        "std_period_return": c("std"),
        "n_bars": c("n").cast("double"),
        "years": years,
    }
    return aggs, out


def metrics(
    bt: DataFrame, keys: Sequence[str], config: BacktestConfig = BacktestConfig(), strategy: str = "strategy", benchmark: str | None = "benchmark", cagr_from_first: bool = False
) -> DataFrame:
    """A row a series: the strategy's metrics and the frictionless buy-and-hold's, and the excesses.

    ``cagr_from_first``: growth counts from the first equity point instead of the capital.
    """
    aggs, made = _metric_columns("strategy_return", "equity", "drawdown", config, cagr_from_first)
    out = {f"{strategy}_{k}": v for k, v in made.items()}
    if benchmark:
        more, made = _metric_columns("bh_return", "bh_equity", "bh_drawdown", config, cagr_from_first)
        aggs += more
        out |= {f"{benchmark}_{k}": v for k, v in made.items()}
    rows = bt.groupBy(*keys).agg(*aggs).select(*keys, *[v.alias(k) for k, v in out.items()])
    if benchmark:
        rows = rows.withColumns(
            {
                "excess_total_return_vs_benchmark": F.col(f"{strategy}_total_return") - F.col(f"{benchmark}_total_return"),
                "excess_sharpe_vs_benchmark": F.col(f"{strategy}_sharpe") - F.col(f"{benchmark}_sharpe"),
            }
        )
    return rows


def trades(bt: DataFrame, keys: Sequence[str], config: BacktestConfig = BacktestConfig(), cost_rate: Column | None = None, chunk: int | None = None) -> DataFrame:
    """Long trades: entry where the position turns positive, exit at the first later bar without one, else the last bar.

    Entries number the bars by a running sum, and a trade is an aggregate over
    its number's bars.  Trades with a price that is not positive are left out.
    """
    renumbered = frames.indexed(bt.drop("idx"), keys, chunk=chunk)
    rows = frames.spread(renumbered, 1, 0, chunk)
    before = F.coalesce(F.lag("position").over(frames.over(keys, rows)), F.lit(0.0))
    rows = frames.trim(rows.withColumn("_entry", ((F.col("position") > 0) & (before <= 0)).cast("long")), chunk)
    rows = frames.running(rows, keys, {"trade_id": ("sum", F.col("_entry"))}, chunk).where("trade_id > 0")
    end = F.struct(F.col("idx").alias("i"), F.col("open").alias("o"), F.col("open_time_utc").alias("t"))
    if frames.chunk_rows(bt, chunk):
        rows = rows.join(rows.groupBy(*keys).agg(F.max(end).alias("_end")), list(keys))
    else:
        rows = rows.withColumn("_end", F.max(end).over(frames.whole(keys)))
    out = lambda c: F.min_by(F.when(F.col("position") <= 0, c), F.when(F.col("position") <= 0, F.col("idx")))
    each = rows.groupBy(*keys, "trade_id").agg(
        F.min("idx").alias("entry_idx"),
        F.min_by("open", "idx").alias("entry_price"),
        F.min_by("open_time_utc", "idx").alias("entry_time"),
        F.min(F.when(F.col("position") <= 0, F.col("idx"))).alias("_exit"),
        out(F.col("open")).alias("_exit_open"),
        out(F.col("open_time_utc")).alias("_exit_time"),
        F.first("_end").alias("_end"),
    )
    each = each.select(
        *keys,
        "trade_id",
        "entry_time",
        F.coalesce("_exit_time", "_end.t").alias("exit_time"),
        "entry_price",
        F.when(F.col("_exit").isNull(), F.col("_end.o")).otherwise(F.col("_exit_open")).alias("exit_price"),
        (F.coalesce("_exit", "_end.i") - F.col("entry_idx")).alias("bars_held"),
    )
    rate = F.lit(config.cost_rate) if cost_rate is None else cost_rate
    good = (F.col("entry_price") > 0) & (F.col("exit_price") > 0)
    gross = change(F.col("exit_price"), F.col("entry_price"))
    each = each.where(good).withColumn("gross_return", gross).withColumn("net_return", F.col("gross_return") - 2 * rate)
    hours = (F.unix_timestamp("exit_time") - F.unix_timestamp("entry_time")) / 3600
    return each.withColumn("hours_held", hours)


def trade_metrics(found: DataFrame, keys: Sequence[str], label: str = "strategy") -> DataFrame:
    r = F.col("net_return")
    rows = found.groupBy(*keys).agg(
        F.count("*").cast("double").alias("trade_count"),
        F.avg((r > 0).cast("double")).alias("win_rate"),
        divide(F.sum(F.when(r > 0, r)), F.abs(F.sum(F.when(r < 0, r)))).alias("profit_factor"),
        F.avg(r).alias("expectancy"),
        F.avg(r).alias("avg_trade_return"),
        F.avg("bars_held").alias("avg_bars_held"),
    )
    # No win is a profit of 0, as no loss is a divisor of 0.
    return rows.select(*keys, *[(F.coalesce(c, F.when(F.col("win_rate") == 0, F.lit(0.0))) if c == "profit_factor" else F.col(c)).alias(f"{label}_{c}") for c in TRADE_METRICS])


def buy_hold_trade(bt: DataFrame, keys: Sequence[str], config: BacktestConfig = BacktestConfig()) -> DataFrame:
    """Buy and hold as one trade over all bars, for ``trade_metrics``."""
    last = F.max_by("bh_equity", "idx")
    return bt.groupBy(*keys).agg((last / config.initial_capital - 1).alias("net_return"), F.count("*").alias("bars_held"))


def evaluate(signals: DataFrame, keys: Sequence[str], config: BacktestConfig = BacktestConfig(), cost_rate: Column | None = None, with_trades: bool = True) -> DataFrame:
    """Backtest, metrics and, if asked, trade metrics of every series; without a trade their count is 0."""
    bt = backtest(signals, keys, config, cost_rate)
    out = metrics(bt, keys, config)
    if with_trades:
        found = trade_metrics(trades(bt, keys, config, cost_rate), keys)
        out = out.join(found, list(keys), "left").withColumn("strategy_trade_count", F.coalesce("strategy_trade_count", F.lit(0.0)))
    return out


def samples(bt: DataFrame, keys: Sequence[str], ratio: float) -> DataFrame:
    """Each bar in the sample "full" and in "in_sample" or "out_of_sample", by position; adds ``sample``."""
    counts = {"_n": F.count("*"), "_first": F.min("idx")}
    if frames.chunk_rows(bt, None):
        rows = bt.join(bt.groupBy(*keys).agg(*[c.alias(n) for n, c in counts.items()]), list(keys))
    else:  # one pass over the series, which is in one task anyway
        rows = bt.withColumns({n: c.over(frames.whole(keys)) for n, c in counts.items()})
    early = F.col("idx") - F.col("_first") < F.floor(F.col("_n") * ratio)
    part = F.when(early, "in_sample").otherwise("out_of_sample")
    return rows.withColumn("sample", F.explode(F.array(F.lit("full"), part))).drop("_n", "_first")


def rebased(bt: DataFrame, keys: Sequence[str], config: BacktestConfig) -> DataFrame:
    """Equity and drawdown anew for series that are parts of others, from the capital on."""
    rows = frames.indexed(bt.drop("idx", "equity", "bh_equity", "drawdown", "bh_drawdown"), keys)
    return with_equity(rows, keys, config.initial_capital)


def metrics_by_sample(bt: DataFrame, keys: Sequence[str], config: BacktestConfig = BacktestConfig()) -> DataFrame:
    """Full, in-sample and out-of-sample metrics of one backtest, each rebased; with trades."""
    part = [*keys, "sample"]
    rows = rebased(samples(bt, keys, config.split_ratio), part, config)
    found = trade_metrics(trades(rows, part, config), part)
    out = metrics(rows, part, config).join(found, part, "left")
    return out.withColumn("strategy_trade_count", F.coalesce("strategy_trade_count", F.lit(0.0)))


def wide_metrics(by_sample: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row a series, columns sample_metric."""
    names = ["full", "in_sample", "out_of_sample"]
    return by_sample.groupBy(*keys).agg(*[F.max(F.when(F.col("sample") == s, F.col(v))).alias(f"{s}_{v}") for s in names for v in values])


def yearly(bt: DataFrame, keys: Sequence[str], config: BacktestConfig = BacktestConfig()) -> DataFrame:
    """Rebased metrics of each calendar year, with whether it gained and beat the benchmark."""
    part = [*keys, "year"]
    out = metrics(rebased(bt.withColumn("year", F.year("open_time_utc")), part, config), part, config)
    return out.withColumns(
        {
            "beats_benchmark_total_return": F.col("strategy_total_return") > F.col("benchmark_total_return"),
            "positive_strategy_return": F.col("strategy_total_return") > 0,
        }
    )
