"""Resampling: the one place where Python kernels run.

A run is a seed and a series; runs are dealt out as rows and each draws its
own indices from a generator spawned by its number, so results do not depend
on the number of tasks.  A series' returns reach the kernels as one array of
doubles a series, behind a check of its length; they are the aggregated bars
of one backtest, not raw data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BacktestConfig, CrisisConfig, PatternConfig

#: Longest series that is resampled in a task, in bars: 40 MB a column.
MOST_BARS = 5_000_000


def block_indices(n: int, block: int, rng: np.random.Generator) -> np.ndarray:
    """``n`` indices in blocks of consecutive ones, each block's start uniform, the last cut off."""
    block = max(1, min(block, n))
    starts = rng.integers(0, n - block + 1, size=-(-n // block))
    return (starts[:, None] + np.arange(block)).ravel()[:n]


def _series(bt: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row a series with an array of structs in order; longer series are an error."""
    rows = bt.groupBy(*keys).agg(F.count("*").alias("_n"), F.array_sort(F.collect_list(F.struct("idx", *columns))).alias("_rows"))
    checked = F.when(F.col("_n") <= MOST_BARS, F.col("_rows")).otherwise(F.raise_error(F.lit(f"a series has more than {MOST_BARS} bars")))
    return rows.select(*keys, *[F.transform(checked.getField(c), lambda x: F.coalesce(x.cast("double"), F.lit(0.0))).alias(c) for c in columns])


def _runs(series: DataFrame, runs: int, per_row: int = 50) -> DataFrame:
    """Each series with the first run of every group of ``per_row`` runs, dealt out."""
    first = F.explode(F.sequence(F.lit(0), F.lit(max(runs - 1, 0)), F.lit(per_row)))
    n = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return series.withColumn("first_run", first).repartition(n, *series.columns[:1], "first_run")


RUN_FIELDS = "mc_run int, strategy_total_return double, benchmark_total_return double, beats_benchmark int, strategy_max_drawdown double, strategy_sharpe double"


def block_bootstrap(bt: DataFrame, keys: Sequence[str], config: BacktestConfig = BacktestConfig(), seed_offset: int = 0) -> DataFrame:
    """A row a series and run: paired totals of strategy and benchmark over resampled blocks, drawdown and Sharpe."""
    series = _series(bt, keys, ("strategy_return", "bh_return"))
    ddl = ", ".join(f"`{k}` {bt.schema[k].dataType.simpleString()}" for k in keys) + ", " + RUN_FIELDS
    names = [*keys, "mc_run", "strategy_total_return", "benchmark_total_return", "beats_benchmark", "strategy_max_drawdown", "strategy_sharpe"]
    root, per_row = math.sqrt(config.annualization_factor), 50

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                s, b = np.asarray(row["strategy_return"]), np.asarray(row["bh_return"])
                for k in range(row["first_run"], min(row["first_run"] + per_row, config.mc_runs)):
                    rng = np.random.default_rng([config.random_seed + seed_offset, k])
                    idx = block_indices(len(s), config.mc_block_size, rng)
                    equity = np.cumprod(1.0 + s[idx])
                    total, bench = equity[-1] - 1.0, np.prod(1.0 + b[idx]) - 1.0
                    fall = float((equity / np.maximum.accumulate(equity) - 1.0).min())
                    std = s[idx].std(ddof=1) if len(s) > 1 else 0.0
                    sharpe = float(s[idx].mean() / std * root) if std > 0 else None
                    out.append((*[row[c] for c in keys], k, float(total), float(bench), int(total > bench), fall, sharpe))
            yield pd.DataFrame(out, columns=names)

    return _runs(series, config.mc_runs, per_row).mapInPandas(run, ddl)


def summary(runs: DataFrame, keys: Sequence[str], crisis: CrisisConfig = CrisisConfig()) -> DataFrame:
    """Quantiles and probabilities over the runs of each series."""
    t, d, s = F.col("strategy_total_return"), F.col("strategy_max_drawdown"), F.col("strategy_sharpe")
    share = lambda c: F.avg(c.cast("double"))
    return runs.groupBy(*keys).agg(
        F.count("*").alias("mc_runs"),
        F.avg("beats_benchmark").alias("mc_probability_beat_benchmark"),
        share(t < 0).alias("mc_probability_loss"),
        share(d < -0.30).alias("mc_probability_drawdown_30"),
        share(d < -0.50).alias("mc_probability_drawdown_50"),
        share(d <= crisis.ruin_drawdown).alias("mc_probability_ruin"),
        *[F.percentile(t, q / 100).alias(f"mc_total_return_p{q:02d}") for q in (5, 50, 95)],
        *[F.percentile(d, q / 100).alias(f"mc_max_drawdown_p{q:02d}") for q in (5, 50)],
        *[F.percentile(s, q / 100).alias(f"mc_sharpe_p{q:02d}") for q in (5, 50)],
    )


def worse_than_observed(runs: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The share of runs with a lower total return than the backtest itself."""
    both = runs.join(observed.select(*keys, F.col("strategy_total_return").alias("observed_total_return")), list(keys))
    worse = F.avg((F.col("strategy_total_return") < F.col("observed_total_return")).cast("double"))
    return both.groupBy(*keys).agg(F.first("observed_total_return").alias("observed_total_return"), worse.alias("mc_probability_worse_than_observed"))


def mean_difference_intervals(long_rows: DataFrame, keys: Sequence[str], config: PatternConfig = PatternConfig(), block: int = 24) -> DataFrame:
    """Block-bootstrap 95% intervals of a condition's mean forward return less the baseline's.

    ``long_rows`` is ``patterns.conditional_long``; fewer than ten values on
    either side give no interval.
    """
    by = [*keys, "forward_horizon_h"]
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("open_time_utc", "r"))), lambda s: s["r"])
    sets = long_rows.groupBy(*by, "category", "condition_name").agg(ordered.alias("values"))
    base = sets.where("condition_name IS NULL").select(*by, F.col("values").alias("base"))
    pairs = sets.where("condition_name IS NOT NULL").join(base, by)
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ddl = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in keys) + ", category string, condition_name string, forward_horizon_h int, ci_low double, ci_high double"
    names = [*keys, "category", "condition_name", "forward_horizon_h", "ci_low", "ci_high"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                cond, rest = np.asarray(row["values"]), np.asarray(row["base"])
                low = high = None
                if len(cond) >= 10 and len(rest) >= 10:
                    rng = np.random.default_rng(config.random_seed + row["forward_horizon_h"] + len(row["condition_name"]))
                    drawn = [
                        cond[block_indices(len(cond), block, rng)].mean() - rest[block_indices(len(rest), block, rng)].mean() for _ in range(config.bootstrap_runs)
                    ]
                    low, high = (float(x) for x in np.percentile(drawn, [2.5, 97.5]))
                out.append((*[row[k] for k in keys], row["category"], row["condition_name"], row["forward_horizon_h"], low, high))
            yield pd.DataFrame(out, columns=names)

    return pairs.repartition(n, *by, "condition_name").mapInPandas(run, ddl)


def exposure_returns(bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bars with mkt_ret, the open-to-open return, and weekday; the last bar of a series is left out."""
    from . import features

    rows = features.add_returns(bars, keys).withColumn("weekday", F.weekday("open_time_utc"))
    return rows.where("open_to_open_return IS NOT NULL").withColumnRenamed("open_to_open_return", "mkt_ret")


def exposure_benchmark(returns: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long Wednesdays and out on Thursdays against buy-and-hold, whole and at the same exposure, and among the weekdays."""
    from pyspark.sql import Window

    m, d = F.col("mkt_ret"), F.col("weekday")
    aggs = [F.product(1 + m).alias("_all"), F.avg((d == 2).cast("double")).alias("_p2"), F.avg((d != 3).cast("double")).alias("_p3")]
    aggs += [F.product(F.when(d == k, 1 + m).otherwise(F.lit(1.0))).alias(f"_on{k}") for k in range(7)]
    aggs += [F.product(F.when(d != k, 1 + m).otherwise(F.lit(1.0))).alias(f"_off{k}") for k in range(7)]
    shares = returns.groupBy(*keys).agg(*aggs)
    each = [
        F.struct(
            F.lit(rule).alias("rule"),
            F.lit(k).alias("weekday"),
            (F.col(f"_{side}{k}") - 1).alias("total_return"),
            F.lit(k == chosen).alias("is_rule"),
            F.col("_p2" if side == "on" else "_p3").alias("exposure"),
        )
        for rule, side, chosen in (("long_wednesday", "on", 2), ("avoid_thursday", "off", 3))
        for k in range(7)
    ]
    rows = shares.select(*keys, (F.col("_all") - 1).alias("buy_hold"), F.inline(F.array(*each)))
    w = Window.partitionBy(*keys, "rule").orderBy(F.col("total_return").desc())
    rows = rows.withColumn("day_rank", F.rank().over(w)).withColumn("best_weekday", F.first("weekday").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    scaled = returns.join(shares.select(*keys, "_p2", "_p3"), list(keys)).groupBy(*keys).agg(
        (F.product(1 + F.col("_p2") * m) - 1).alias("_f2"), (F.product(1 + F.col("_p3") * m) - 1).alias("_f3")
    )
    rows = rows.where("is_rule").join(scaled, list(keys))
    fractional = F.when(F.col("rule") == "long_wednesday", F.col("_f2")).otherwise(F.col("_f3"))
    rows = rows.withColumn("fractional_buy_hold", fractional).drop("_f2", "_f3", "is_rule")
    return rows.withColumns({"excess_vs_buy_hold": F.col("total_return") - F.col("buy_hold"), "excess_vs_fractional": F.col("total_return") - F.col("fractional_buy_hold")})


def exposure_runs(returns: DataFrame, rules: DataFrame, keys: Sequence[str], runs: int = 5000, seed: int = 42) -> DataFrame:
    """Random masks with as many bars as each rule holds: the share of masks below the rule's return, their median and p95."""
    rows = returns.withColumn("idx", F.unix_timestamp("open_time_utc"))
    series = _series(rows, keys, ("mkt_ret",)).join(rules.select(*keys, "rule", "total_return", "exposure"), list(keys))
    ddl = ", ".join(f"`{k}` {returns.schema[k].dataType.simpleString()}" for k in keys) + ", rule string, total_return double, mc_return double"
    per_row = 100

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                logs = np.log1p(np.asarray(row["mkt_ret"]))
                held = round(row["exposure"] * len(logs))
                for k in range(row["first_run"], min(row["first_run"] + per_row, runs)):
                    rng = np.random.default_rng([seed, k, len(row["rule"])])
                    total = np.expm1(logs[rng.choice(len(logs), held, replace=False)].sum())
                    out.append((*[row[c] for c in keys], row["rule"], row["total_return"], float(total)))
            yield pd.DataFrame(out, columns=[*keys, "rule", "total_return", "mc_return"])

    drawn = _runs(series, runs, per_row).mapInPandas(run, ddl)
    return drawn.groupBy(*keys, "rule").agg(
        F.avg((F.col("mc_return") < F.col("total_return")).cast("double")).alias("mc_percentile"),
        F.percentile("mc_return", 0.5).alias("mc_median"),
        F.percentile("mc_return", 0.95).alias("mc_p95"),
    )
