"""Rule-based research verdicts: ordered CASE expressions over metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import BacktestConfig
from ..functions.scalars import any_of, divide, reasons


def overfit_flags(wide: DataFrame, min_trades: int = 30) -> DataFrame:
    """Flags and research_status from {full, in_sample, out_of_sample}_... columns; a null comparison is false."""
    c = F.col
    is_ret, is_sharpe = c("in_sample_strategy_total_return"), c("in_sample_strategy_sharpe")
    ret, sharpe = c("out_of_sample_strategy_total_return"), c("out_of_sample_strategy_sharpe")
    false = lambda x: F.coalesce(x, F.lit(False))
    few = max(5.0, min_trades * 0.25)
    rows = wide.withColumns(
        {
            "in_sample_good": false((is_ret > 0) & (is_sharpe > 0)),
            "oos_bad": false(ret < 0) | false(sharpe < 0),
            "low_trade_count": false(F.coalesce("full_strategy_trade_count", F.lit(0.0)) < min_trades) | false(c("out_of_sample_strategy_trade_count") < few),
            "underperforms_benchmark_oos": false(ret < c("out_of_sample_benchmark_total_return")),
            "severe_oos_drawdown": false(c("out_of_sample_strategy_max_drawdown") < -0.50),
        }
    )
    status = (
        F.when(c("in_sample_good") & c("oos_bad"), "REJECT_OVERFIT_RISK")
        .when(c("low_trade_count"), "INCONCLUSIVE_LOW_TRADES")
        .when(c("underperforms_benchmark_oos") & (ret < 0), "REJECT_OOS_WEAK")
        .when(c("severe_oos_drawdown"), "INCONCLUSIVE_RISK_TOO_HIGH")
        .when((ret > 0) & (sharpe > 0) & ~c("underperforms_benchmark_oos"), "CANDIDATE_NEEDS_ROBUSTNESS")
        .otherwise("INCONCLUSIVE")
    )
    return rows.withColumns({"generalization_ratio_sharpe": F.when(F.abs(is_sharpe) > 0.1, divide(sharpe, is_sharpe)), "research_status": status})


def leaderboard(wide: DataFrame, keys: Sequence[str] = (), min_trades: int = 30, top: int = 3) -> DataFrame:
    """The best ``top`` variants of each hypothesis by in-sample score; few-trade variants only if there are no others.

    Scores have ten digits, so variants with the same trades are ties and go by their names.
    """
    c = lambda n: F.coalesce(F.col(f"in_sample_strategy_{n}"), F.lit(-999.0))
    enough = F.coalesce("full_strategy_trade_count", F.lit(0.0)) >= max(5, min_trades // 2)
    rows = wide.withColumn("_enough", enough)
    some = rows.groupBy(*keys).agg(F.max("_enough").alias("_some")) if keys else rows.agg(F.max("_enough").alias("_some"))
    rows = rows.join(F.broadcast(some), list(keys)) if keys else rows.join(F.broadcast(some))
    score = F.when(F.col("_some"), c("sharpe") + c("calmar") * 0.25 + c("total_return") * 0.10).otherwise(c("sharpe"))
    score = F.format_string("%.9e", score).cast("double")
    rows = rows.where(F.col("_enough") | ~F.col("_some")).withColumn("selection_score", score)
    best = Window.partitionBy(*keys, "hypothesis_id").orderBy(F.col("selection_score").desc(), "variant_id")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).drop("_enough", "_some")


def on_leaderboard(flags: DataFrame, best: DataFrame, by: Sequence[str] = ("variant_id",)) -> DataFrame:
    """The flags of the leaderboard's variants; all of them if the leaderboard is empty is the caller's choice."""
    return flags.join(best.select(*by), list(by), "left_semi")


def parameter_sensitivity(wide: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Out-of-sample medians for every value of every parameter; needs params_json."""
    r, s, d = (F.col(f"out_of_sample_strategy_{n}") for n in ("total_return", "sharpe", "max_drawdown"))
    rows = wide.select("*", F.explode(F.from_json("params_json", "map<string,string>")).alias("param_name", "param_value"))
    return rows.groupBy(*keys, "hypothesis_id", "param_name", "param_value").agg(
        F.count("*").alias("variants"),
        F.percentile(r, 0.5).alias("median_oos_total_return"),
        F.percentile(s, 0.5).alias("median_oos_sharpe"),
        F.percentile(d, 0.5).alias("median_oos_max_drawdown"),
        F.avg(F.coalesce(r > 0, F.lit(False)).cast("double")).alias("positive_oos_rate"),
    )


def research_status(by_sample: DataFrame, years: DataFrame, mc: DataFrame, keys: Sequence[str], config: BacktestConfig = BacktestConfig()) -> DataFrame:
    """(keys, research_status, reasons): the conservative class of a strategy from its samples, years and resampling."""
    pick = lambda s, c: F.max(F.when(F.col("sample") == s, F.col(c)))
    rows = by_sample.groupBy(*keys).agg(
        pick("out_of_sample", "strategy_total_return").alias("ret"),
        pick("out_of_sample", "strategy_sharpe").alias("sharpe"),
        pick("out_of_sample", "excess_total_return_vs_benchmark").alias("excess"),
        pick("full", "strategy_trade_count").alias("trades"),
    )
    rates = years.groupBy(*keys).agg(
        F.avg(F.col("positive_strategy_return").cast("double")).alias("positive"), F.avg(F.col("beats_benchmark_total_return").cast("double")).alias("beat")
    )
    rows = rows.join(rates, list(keys), "left").join(mc.select(*keys, "mc_probability_loss"), list(keys), "left")
    ret, sharpe, trades = F.col("ret"), F.coalesce("sharpe", F.lit(-999.0)), F.col("trades")
    pairs = [
        (trades < config.min_trades, "few trades"),
        (ret <= 0, "out-of-sample return not positive"),
        (sharpe <= 0, "out-of-sample Sharpe not positive"),
        (F.col("excess") <= 0, "does not beat buy and hold out of sample"),
        (F.coalesce("mc_probability_loss", F.lit(1.0)) >= 0.50, "resampling shows a loss in half of the runs or more"),
        (F.coalesce("positive", F.lit(0.0)) < 0.50, "fewer than half of the years positive"),
    ]
    clean = ~any_of([c for c, _ in pairs])
    status = (
        F.when(clean & (F.coalesce("beat", F.lit(0.0)) >= 0.50), "CANDIDATE_FOR_FURTHER_VALIDATION")
        .when((ret > 0) & (sharpe > 0) & (trades >= config.min_trades), "INCONCLUSIVE_NEEDS_ROBUSTNESS")
        .otherwise("REJECT_OR_REDESIGN")
    )
    return rows.select(*keys, status.alias("research_status"), reasons(pairs).alias("reasons"))


def audit(
    wf: DataFrame, costs: DataFrame, years: DataFrame, mc: DataFrame, shifts: DataFrame, controls: DataFrame, keys: Sequence[str], families: dict[str, str]
) -> DataFrame:
    """The audit verdict by strategy, from walk-forward, costs, years, resampling, clock shifts and weekday controls.

    ``families``: strategy_id -> control_family whose rank counts.  Without
    years that is a reason; other missing tables give none.
    """
    by = [*keys, "strategy_id"]
    c = F.col
    rows = wf.select(*by, "wf_positive_window_rate", "wf_beat_benchmark_window_rate", "wf_median_test_return", "wf_median_excess_vs_benchmark")
    rows = rows.join(mc.select(*by, "mc_probability_loss"), by, "left")
    of = lambda s, n: F.max(F.when(c("scenario") == s, c(n)))
    rows = rows.join(
        costs.groupBy(*by).agg(
            *[of(s, n).alias(f"{s}_{a}") for s in ("medium", "high") for n, a in (("wf_median_test_return", "median"), ("wf_beat_benchmark_window_rate", "beat"))]
        ),
        by,
        "left",
    )
    gain = lambda n: F.avg((c(n) > 0).cast("double"))
    rows = rows.join(
        years.groupBy(*by).agg(gain("strategy_total_return").alias("year_positive_rate"), gain("excess_total_return_vs_benchmark").alias("year_beat_benchmark_rate")), by, "left"
    )
    moved = c("timezone_shift_hours") != 0
    r = c("strategy_total_return")
    rows = rows.join(
        shifts.groupBy(*by).agg(
            F.max(F.when(~moved, r)).alias("zero"), F.percentile(F.when(moved, r), 0.5).alias("alt"), F.avg(F.when(moved, (r > 0).cast("double"))).alias("alt_positive")
        ),
        by,
        "left",
    )
    own = controls.where("is_original_rule").select(*keys, "control_family", c("rank_return_desc").alias("rank"))
    family = F.lit(None).cast("string")
    for name, f in families.items():
        family = F.when(c("strategy_id") == name, f).otherwise(family)
    rows = rows.withColumn("control_family", family).join(own, [*keys, "control_family"], "left")
    severe = [
        (c("wf_positive_window_rate") < 0.60, "fewer than 60% of walk-forward windows positive"),
        (c("wf_median_test_return") <= 0, "median walk-forward return not positive"),
        (c("mc_probability_loss") >= 0.40, "resampling shows a loss in 40% of the runs or more"),
        (c("high_median") <= 0, "high costs: median walk-forward return not positive"),
    ]
    pairs = [
        severe[0],
        (c("wf_beat_benchmark_window_rate") < 0.60, "fewer than 60% of walk-forward windows beat the benchmark"),
        severe[1],
        (c("wf_median_excess_vs_benchmark") <= 0, "median walk-forward excess not positive"),
        severe[2],
        (c("medium_median") <= 0, "medium costs: median walk-forward return not positive"),
        (c("medium_beat") < 0.50, "medium costs: fewer than half of the windows beat the benchmark"),
        severe[3],
        (c("high_beat") < 0.50, "high costs: fewer than half of the windows beat the benchmark"),
        (c("year_positive_rate") < 0.60, "fewer than 60% of the years positive"),
        (c("year_beat_benchmark_rate") < 0.60, "fewer than 60% of the years beat the benchmark"),
        (c("year_positive_rate").isNull(), "not enough years"),
        ((c("zero") > 0) & (c("alt_positive") < 0.50), "calendar fragility: most clock shifts are not positive"),
        (c("rank") > 2, "selection bias: not among the two best of its controls"),
    ]
    status = (
        F.when(any_of([x for x, _ in severe]), "FAILS_OVERFIT_AUDIT")
        .when(any_of([x for x, _ in pairs]), "INCONCLUSIVE_FRAGILE")
        .otherwise("SURVIVES_INITIAL_AUDIT_BUT_NOT_APPROVED")
    )
    return rows.select(
        *by,
        status.alias("audit_status"),
        "wf_positive_window_rate",
        "wf_beat_benchmark_window_rate",
        "wf_median_test_return",
        "wf_median_excess_vs_benchmark",
        "year_positive_rate",
        "year_beat_benchmark_rate",
        "mc_probability_loss",
        (c("zero") - c("alt")).alias("timezone_fragility_return_gap_vs_alt_median"),
        reasons(pairs).alias("audit_reasons"),
    )


def institutional(
    strategies: DataFrame, audited: DataFrame, regimes: DataFrame, costs: DataFrame, mc: DataFrame, crises: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """The last gate: what the audit did not pass is rejected, whatever the rest says."""
    by = [*keys, "strategy_id"]
    c = F.col
    rows = strategies.join(audited.select(*by, c("audit_status").alias("s3_status"), c("audit_reasons").alias("s3_reasons")), by, "left")
    known = regimes.where("regime <> 'WARMUP'")
    weak = F.array_sort(F.collect_list(F.when(c("beat_benchmark_window_rate") < 0.50, c("regime"))))
    rows = rows.join(known.groupBy(*by).agg(weak.alias("weak"), F.count("*").alias("n_regimes")), by, "left")
    stress = costs.where("scenario = 'stress'").select(*by, c("wf_beat_benchmark_window_rate").alias("beat"), c("wf_median_test_return").alias("median"))
    rows = rows.join(stress, by, "left").join(mc.select(*by, "mc_probability_ruin"), by, "left")
    rows = rows.join(crises.groupBy(*by).agg(F.avg(c("strategy_nonworse_than_benchmark").cast("double")).alias("nonworse")), by, "left")
    pairs = [
        (c("n_regimes").isNull(), "not enough walk-forward windows by regime"),
        (F.size("weak") > 0, "does not beat the benchmark in every regime"),
        (c("beat").isNull() | (c("beat") < 0.50), "does not survive stress costs"),
        (c("median").isNull() | (c("median") <= 0), "median walk-forward return not positive under stress costs"),
        (c("mc_probability_ruin").isNull() | (c("mc_probability_ruin") > 0.05), "probability of ruin above the limit"),
        (c("nonworse").isNull(), "not enough crises"),
        (c("nonworse") < 0.60, "worse than the benchmark in most of the worst crises"),
    ]
    status = (
        F.when(c("s3_status").isNull(), "REJECTED_NO_S3_AUDIT")
        .when(c("s3_status") != "SURVIVES_INITIAL_AUDIT_BUT_NOT_APPROVED", "REJECTED_AT_S3_GATE")
        .when(any_of([x for x, _ in pairs]), "REJECTED_INSTITUTIONAL_CRITERIA")
        .otherwise("APPROVED_FOR_PAPER_TRADING_PENDING_MULTIASSET")
    )
    why = F.when(c("s3_status").isNull(), "no audit").when(status == "REJECTED_AT_S3_GATE", c("s3_reasons")).otherwise(reasons(pairs))
    return rows.select(*by, F.coalesce("s3_status", F.lit("NO_S3_AUDIT_FOUND")).alias("s3_status"), status.alias("institutional_status"), why.alias("reasons"))


def exposure_verdict(found: DataFrame, value: str = "mc_percentile") -> DataFrame:
    """By rule over the assets: a genuine edge, a partial one, or an artefact of exposure."""
    beat = F.count_if(F.col("excess_vs_fractional") > 0)
    rows = found.groupBy("rule").agg(
        F.count("*").alias("assets"), beat.alias("beat"), F.avg("excess_vs_fractional").alias("mean_excess"), F.percentile(value, 0.5).alias("median_percentile")
    )
    verdict = (
        F.when((F.col("beat") >= 3) & (F.col("median_percentile") > 0.70), "GENUINE_EDGE")
        .when((F.col("beat") >= 2) & (F.col("median_percentile") > 0.50), "PARTIAL_EDGE")
        .otherwise("EXPOSURE_ARTEFACT")
    )
    return rows.withColumn("verdict", verdict)
