"""Export tables for a dashboard; rounding is half to even, as the CSV contract has it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import KEYS
from ..functions.scalars import DAYS, divide
from ..operators import features
from ..sources.readers import date_and_value_columns
from ..sources.sinks import write_csv


def strategy_kpi(results: DataFrame, percentiles: DataFrame | None = None) -> DataFrame:
    """Percentages of strategy results, with the resampling percentile by symbol and strategy where given."""
    rows = results
    if percentiles is not None:
        rows = rows.join(percentiles.select("symbol", "strategy", "mc_percentile"), ["symbol", "strategy"], "left")
    pct = lambda c, d: F.bround(F.col(c) * 100, d)
    rows = rows.withColumns(
        {
            "total_return_pct": pct("total_return", 2),
            "bh_return_pct": pct("bh_return", 2),
            "excess_return_pct": pct("excess", 2),
            "max_drawdown_pct": pct("max_drawdown", 2),
            "exposure_pct": pct("pos_pct", 1),
            "beat_bh_pct": pct("beat_pct", 1),
        }
    )
    wanted = (
        "symbol strategy total_return_pct bh_return_pct excess_return_pct sharpe max_drawdown_pct win_rate profit_factor exposure_pct beat_bh_pct mc_percentile"
    ).split()
    return rows.select(*[c for c in wanted if c in rows.columns])


def _returns(bars: DataFrame, keys: Sequence[str], regime: bool = False) -> DataFrame:
    rows = bars
    if "open_to_open_return" not in rows.columns or "next_bar_weekday" not in rows.columns:
        rows = features.add_features(features.add_returns(bars, keys), keys)
    if regime and "market_regime" not in rows.columns:
        rows = features.add_regime(rows, keys)  # over all bars, before any is left out
    names = F.try_element_at(F.array(*[F.lit(d) for d in DAYS]), (F.col("next_bar_weekday") + 1).cast("int"))
    return rows.where("open_to_open_return IS NOT NULL AND next_bar_weekday IS NOT NULL").withColumn("weekday_name", names)


def weekday_returns(bars: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    r = F.col("open_to_open_return")
    out = _returns(bars, keys).groupBy(*keys, "next_bar_weekday", "weekday_name").agg(
        F.count(r).alias("bar_count"),
        F.avg(r).alias("avg_return"),
        F.stddev_samp(r).alias("std_return"),
        F.min(r).alias("min_return"),
        F.max(r).alias("max_return"),
        F.avg((r > 0).cast("double")).alias("pos_rate"),
    )
    return out.withColumns(
        {
            "avg_return_pct": F.bround(F.col("avg_return") * 100, 4),
            "std_return_pct": F.bround(F.col("std_return") * 100, 4),
            "sharpe": F.bround(divide(F.col("avg_return"), F.col("std_return")), 4),
        }
    )


def regime_heatmap(bars: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    out = _returns(bars, keys, regime=True).where("market_regime IS NOT NULL").groupBy(*keys, "market_regime", "next_bar_weekday", "weekday_name").agg(
        F.count("*").alias("bar_count"), F.avg("open_to_open_return").alias("avg_return")
    )
    return out.withColumn("avg_return_pct", F.bround(F.col("avg_return") * 100, 4))


def equity_curves(bt: DataFrame) -> DataFrame:
    """Curves in long form from any table whose columns name a time and an equity."""
    time, value = date_and_value_columns(bt.columns)
    if time is None or value is None:
        raise ValueError("no time or equity column")
    return bt.select("symbol", F.col("strategy_id").alias("strategy"), F.col(time).alias("date"), F.col(value).alias("equity"))


def run_all(bars: DataFrame, results: DataFrame, bt: DataFrame, folder: str, percentiles: DataFrame | None = None) -> None:
    """The four CSV exports."""
    write_csv(strategy_kpi(results, percentiles), f"{folder}/strategy_kpi")
    write_csv(weekday_returns(bars), f"{folder}/weekday_returns")
    write_csv(regime_heatmap(bars), f"{folder}/regime_heatmap")
    write_csv(equity_curves(bt), f"{folder}/equity_curves")
