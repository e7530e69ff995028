"""Walk-forward windows, and the stress tests that repeat a backtest under other conditions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import TIMEZONE_SHIFTS, BacktestConfig, CrisisConfig
from ..functions.scalars import DAYS, flag
from . import backtest as bt
from . import frames, signals
from .drawdowns import episodes


def windows(counted: DataFrame, config: BacktestConfig = BacktestConfig()) -> DataFrame:
    """Window bounds for each row of ``counted`` (keys, n): ends are exclusive; none if n is too small."""
    span = config.train_bars + config.purge_bars + config.test_bars
    last = F.floor((F.col("n") - span) / config.step_bars)
    k = F.explode(F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last)))
    out = counted.withColumn("_k", k)
    start = F.col("_k") * config.step_bars
    return out.select(
        *[c for c in counted.columns if c != "n"],
        (F.col("_k") + 1).alias("window_id"),
        start.alias("train_start"),
        (start + config.train_bars).alias("train_end"),
        (start + config.train_bars + config.purge_bars).alias("test_start"),
        (start + span).alias("test_end"),
    )


def members(rows: DataFrame, config: BacktestConfig, sides: Sequence[str] = ("train", "test")) -> DataFrame:
    """Each bar (with idx) in every window it belongs to: window_id and side.

    The windows of a bar follow from its position, so there is no range join;
    a series' count cuts off windows that would end after it.
    """
    c = config
    offset = {"train": (0, c.train_bars), "test": (c.train_bars + c.purge_bars, c.train_bars + c.purge_bars + c.test_bars)}
    each = []
    for side in sides:
        a, b = offset[side]
        first = F.greatest(F.floor((F.col("idx") - b) / c.step_bars) + 1, F.lit(0))
        last = F.floor((F.col("idx") - a) / c.step_bars)
        ks = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
        each.append(_sided(ks, side))
    out = rows.select("*", F.inline(F.concat(*each)))
    span = c.train_bars + c.purge_bars + c.test_bars
    return out.where(F.col("k") * c.step_bars + span <= F.col("n")).withColumn("window_id", F.col("k") + 1).drop("k")


def _sided(ks: Column, side: str) -> Column:
    return F.transform(ks, lambda k: F.struct(k.alias("k"), F.lit(side).alias("side")))


def with_count(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    if frames.chunk_rows(rows, None):
        return rows.join(rows.groupBy(*keys).agg(F.count("*").alias("n")), list(keys))
    return rows.withColumn("n", F.count("*").over(frames.whole(keys)))


def samples_restarted(bars: DataFrame, strategies: Sequence[signals.Strategy], keys: Sequence[str], config: BacktestConfig = BacktestConfig()) -> DataFrame:
    """Metrics and trades of the full series and of its two samples, each run from its own first bar on.

    Signals see a sample's bars only, so means warm up anew; ``bt.metrics_by_sample`` cuts one run instead.
    """
    part = [*keys, "sample"]
    cut = bt.samples(frames.indexed(bars, keys), keys, config.split_ratio).drop("idx")
    return bt.evaluate(signals.with_signals(cut, strategies, part), [*part, "strategy_id"], config)


def yearly_restarted(
    bars: DataFrame, strategies: Sequence[signals.Strategy], keys: Sequence[str], config: BacktestConfig = BacktestConfig(), least: int = 100
) -> DataFrame:
    """Metrics of each calendar year of at least ``least`` bars, its signals run anew."""
    part = [*keys, "year"]
    rows = bars.withColumn("year", F.year("open_time_utc"))
    long = rows.groupBy(*part).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")
    run = bt.backtest(signals.with_signals(rows.join(long, part), strategies, part), [*part, "strategy_id"], config)
    out = bt.metrics(run, [*part, "strategy_id"], config)
    gained = F.col("strategy_total_return")
    return out.withColumns({"beats_benchmark_total_return": gained > F.col("benchmark_total_return"), "positive_strategy_return": gained > 0})


def walk_forward(rows: DataFrame, keys: Sequence[str], config: BacktestConfig = BacktestConfig()) -> DataFrame:
    """Out-of-sample and in-sample backtests of a signal computed on all data, restarted in each window."""
    placed = members(with_count(rows, keys), config).drop("n", "idx")
    return bt.backtest(placed, [*keys, "window_id", "side"], config)


def require_windows(rows: DataFrame, config: BacktestConfig) -> None:
    """An error if no series is long enough for one window."""
    span = config.train_bars + config.purge_bars + config.test_bars
    most = rows.agg(F.max("idx").alias("m")).first().m
    if most is None or most + 1 < span:
        raise ValueError(f"walk-forward needs {span} bars, there are {0 if most is None else most + 1}")


def frozen_rules(
    bars: DataFrame, strategies: Sequence[signals.Strategy], keys: Sequence[str], config: BacktestConfig = BacktestConfig(), cost_rate: Column | None = None, sides: Sequence[str] = ("train", "test"), extra: Sequence[str] = ()
) -> DataFrame:
    """The audit's walk-forward: the rule is computed anew inside each window, so it knows no bar outside."""
    rows = bars if "idx" in bars.columns else frames.indexed(bars, keys)
    placed = members(with_count(rows, keys), config, sides).drop("idx", "n")
    part = [*keys, "window_id", "side"]
    signalled = signals.with_signals(placed, strategies, part)
    return bt.metrics(bt.backtest(signalled, [*part, "strategy_id", *extra], config, cost_rate), [*part, "strategy_id", *extra], config)


def aggregated(tests: DataFrame, by: Sequence[str]) -> DataFrame:
    """Windows summed up: rates, medians, means and worsts of the test side."""
    r, e, d = (F.col(c) for c in ("strategy_total_return", "excess_total_return_vs_benchmark", "strategy_max_drawdown"))
    return tests.groupBy(*by).agg(
        F.count("*").alias("wf_window_count"),
        F.avg((r > 0).cast("double")).alias("wf_positive_window_rate"),
        F.avg((e > 0).cast("double")).alias("wf_beat_benchmark_window_rate"),
        F.percentile(r, 0.5).alias("wf_median_test_return"),
        F.avg(r).alias("wf_mean_test_return"),
        F.min(r).alias("wf_worst_test_return"),
        F.avg(e).alias("wf_mean_excess_vs_benchmark"),
        F.percentile(e, 0.5).alias("wf_median_excess_vs_benchmark"),
        F.min(d).alias("wf_worst_drawdown"),
        F.avg("strategy_sharpe").alias("wf_mean_test_sharpe"),
    )


def by_regime(tests: DataFrame, regimes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The windows by their dominant regime: per strategy and regime."""
    joined = tests.join(regimes, [*keys, "window_id"])
    r, e = F.col("strategy_total_return"), F.col("excess_total_return_vs_benchmark")
    return joined.groupBy(*keys, "strategy_id", F.col("dominant_regime").alias("regime")).agg(
        F.count("*").alias("window_count"),
        F.avg((r > 0).cast("double")).alias("positive_window_rate"),
        F.avg((e > 0).cast("double")).alias("beat_benchmark_window_rate"),
        F.percentile(r, 0.5).alias("median_test_return"),
        F.percentile(e, 0.5).alias("median_excess_vs_benchmark"),
        F.min(r).alias("worst_test_return"),
    )


def dominant_regimes(labelled: DataFrame, keys: Sequence[str], config: BacktestConfig) -> DataFrame:
    """(keys, window_id, dominant_regime): the most frequent label of the test bars, WARMUP aside; the first of ties."""
    rows = labelled if "idx" in labelled.columns else frames.indexed(labelled, keys)
    tests = members(with_count(rows, keys), config, ("test",))
    label = F.when(F.col("regime_label") != "WARMUP", F.col("regime_label"))
    return tests.groupBy(*keys, "window_id").agg(F.coalesce(F.mode(label, True), F.lit("WARMUP")).alias("dominant_regime"))


def scenarios(rows: DataFrame, costs: Sequence[tuple[str, float, float]]) -> DataFrame:
    """Every row under every cost scenario: scenario, commission and slippage."""
    each = [F.struct(F.lit(n).alias("scenario"), F.lit(c).alias("commission"), F.lit(s).alias("slippage")) for n, c, s in costs]
    return rows.select("*", F.inline(F.array(*each)))


def cost_stress(
    bars: DataFrame, strategies: Sequence[signals.Strategy], keys: Sequence[str], costs: Sequence[tuple[str, float, float]], config: BacktestConfig = BacktestConfig()
) -> DataFrame:
    """Walk-forward summaries of each strategy under each cost scenario."""
    rows = bars if "idx" in bars.columns else frames.indexed(bars, keys)
    placed = members(with_count(rows, keys), config, ("test",)).drop("idx", "n")
    part = [*keys, "window_id"]
    signalled = scenarios(signals.with_signals(placed, strategies, part), costs)
    series = [*part, "strategy_id", "scenario"]
    rate = F.col("commission") + F.col("slippage")
    tests = bt.metrics(bt.backtest(signalled, series, config, rate), series, config)
    return aggregated(tests, [*keys, "strategy_id", "scenario"])


def timezone_fragility(bars: DataFrame, rules: dict[str, tuple[bool, int]], keys: Sequence[str], config: BacktestConfig = BacktestConfig(), shifts: Sequence[int] = TIMEZONE_SHIFTS) -> DataFrame:
    """Full-sample metrics of weekday rules with the clock moved; rules: id -> (long on the day, day)."""
    rows = bars if "idx" in bars.columns else frames.indexed(bars, keys)
    rows = frames.spread(rows, 0, 1)
    w = frames.over(keys, rows)
    each = [
        F.struct(
            F.lit(name).alias("strategy_id"),
            F.lit(h).alias("timezone_shift_hours"),
            F.col(f"_{h}_{name}").alias("signal"),
        )
        for name in rules
        for h in shifts
    ]
    made = {f"_{h}_{n}": (signals.long_weekday if is_long else signals.avoid_weekday)(w, day, h) for n, (is_long, day) in rules.items() for h in shifts}
    signalled = frames.trim(rows.withColumns(made)).select(*keys, "idx", "open_time_utc", "open", F.inline(F.array(*each)))
    series = [*keys, "strategy_id", "timezone_shift_hours"]
    return bt.metrics(bt.backtest(signalled, series, config), series, config)


def selection_controls(bars: DataFrame, keys: Sequence[str], config: BacktestConfig = BacktestConfig()) -> DataFrame:
    """Metrics of being long on, and out on, each weekday, with the rank of the return in its family."""
    from pyspark.sql import Window

    rows = bars if "idx" in bars.columns else frames.indexed(bars, keys)
    rows = frames.spread(rows, 0, 1)
    rows = frames.trim(rows.withColumn("_next", signals.next_weekday(frames.over(keys, rows))))
    is_day = [flag(F.col("_next") == d) for d in range(7)]
    each = [
        F.struct(F.lit(family).alias("control_family"), F.lit(d).alias("weekday_num"), (is_day[d] if family == "weekday_long" else F.lit(1.0) - is_day[d]).alias("signal"))
        for family in ("weekday_long", "avoid_weekday")
        for d in range(7)
    ]
    signalled = rows.select(*keys, "idx", "open_time_utc", "open", F.inline(F.array(*each)))
    series = [*keys, "control_family", "weekday_num"]
    out = bt.metrics(bt.backtest(signalled, series, config), series, config)
    original = ((F.col("control_family") == "weekday_long") & (F.col("weekday_num") == 2)) | ((F.col("control_family") == "avoid_weekday") & (F.col("weekday_num") == 3))
    names = F.element_at(F.array(*[F.lit(d.lower()) for d in DAYS]), F.col("weekday_num") + 1)
    tested = F.concat(F.when(F.col("control_family") == "weekday_long", "long_").otherwise("avoid_"), names)
    # Seven rows a series and family.
    rank = F.rank().over(Window.partitionBy(*keys, "control_family").orderBy(F.col("strategy_total_return").desc()))
    return out.withColumns({"tested_condition": tested, "is_original_rule": original, "rank_return_desc": rank})


def crisis_stress(
    bars: DataFrame, strategies: Sequence[signals.Strategy], keys: Sequence[str], config: BacktestConfig = BacktestConfig(), crisis: CrisisConfig = CrisisConfig()
) -> DataFrame:
    """Strategies inside the benchmark's worst drawdown episodes, beside the benchmark."""
    from pyspark.sql import Window

    rows = bars if "idx" in bars.columns else frames.indexed(bars, keys)
    held = bt.backtest(rows.withColumn("signal", F.lit(1.0)), keys, config)
    found = episodes(held, keys, "bh_drawdown").where(F.col("depth") <= crisis.min_depth)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("depth", "start_idx"))
    worst = found.withColumn("crisis_rank", rank).where(F.col("crisis_rank") <= crisis.top_n)
    inside = rows.join(F.broadcast(worst), list(keys)).where(F.col("idx").between(F.col("start_idx"), F.col("end_idx")))
    part = [*keys, "crisis_rank"]
    signalled = signals.with_signals(inside.select(*part, "open_time_utc", *[c for c in ("open", "high", "low", "close") if c in bars.columns]), strategies, part)
    series = [*part, "strategy_id"]
    m = bt.metrics(bt.backtest(signalled, series, config), series, config)
    m = m.select(
        *series,
        F.col("benchmark_total_return").alias("benchmark_total_return_in_episode"),
        F.col("benchmark_max_drawdown").alias("benchmark_max_drawdown_in_episode"),
        F.col("strategy_total_return").alias("strategy_total_return_in_episode"),
        F.col("strategy_max_drawdown").alias("strategy_max_drawdown_in_episode"),
        F.col("excess_total_return_vs_benchmark").alias("excess_return_in_episode"),
        (F.col("strategy_total_return") >= F.col("benchmark_total_return")).alias("strategy_nonworse_than_benchmark"),
    )
    return m.join(worst.select(*part, "start_time", "trough_time", "end_time", F.col("depth").alias("benchmark_drawdown_depth")), part)


def leakage_review(table: DataFrame) -> DataFrame:
    """The rule review: calendar rules read no prices and no later bars."""
    no = F.lit(False)
    return table.select("strategy_id").withColumns(
        {
            "uses_price_features": no,
            "uses_future_returns": no,
            "uses_enriched_q2_features": no,
            "uses_calendar_only": F.lit(True),
            "lookahead_detected_by_rule_review": no,
            "data_leakage_detected_by_rule_review": no,
            "remaining_risk": F.lit("The rule was found on the same history; selection bias remains although the signal reads no later price."),
        }
    )
