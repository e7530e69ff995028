"""Conditional forward returns: every condition and horizon in one long aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import KEYS, PatternConfig
from ..functions.scalars import DAYS, DAYS_ES, divide


def conditions(config: PatternConfig = PatternConfig()) -> list[tuple[str, str, Column]]:
    """(category, name, condition) over ``pattern_features``."""
    out = [("hour_behavior", f"hour_utc_{h:02d}", F.col("hour_utc") == h) for h in range(24)]
    out += [("day_behavior", f"day_{es}", F.col("day_of_week") == day) for day, es in zip(DAYS, DAYS_ES)]
    wide, narrow, loud, quiet = (F.col(f"{c}_event") for c in ("vol_expansion", "vol_contraction", "high_volume", "low_volume"))
    out += [
        ("volatility_volume", name, c)
        for name, c in (
            ("vol_expansion_range_gt_q80_168h", wide),
            ("vol_contraction_range_lt_q20_168h", narrow),
            ("high_volume_zscore_gt_1_168h", loud),
            ("low_volume_zscore_lt_minus_1_168h", quiet),
            ("vol_expansion_and_high_volume", wide & loud),
            ("vol_contraction_and_low_volume", narrow & quiet),
        )
    ]
    for m in config.momentum_windows:
        up, down = F.col(f"momentum_up_{m}h_event"), F.col(f"momentum_down_{m}h_event")
        out += [("momentum", f"momentum_up_{m}h", up), ("momentum", f"momentum_down_{m}h", down)]
        out += [("mean_reversion", f"after_extreme_rally_{m}h", up), ("mean_reversion", f"after_extreme_drop_{m}h", down)]
    return out


def conditional_long(df: DataFrame, config: PatternConfig = PatternConfig(), keys: Sequence[str] = KEYS) -> DataFrame:
    """A row for each bar, condition it meets and horizon with a forward return; the baseline is condition null."""
    each = [
        F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(category).alias("category"), F.lit(name).alias("condition_name")))
        for category, name, c in conditions(config)
    ]
    met = F.concat(F.array(F.struct(F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("condition_name"))), F.array_compact(F.array(*each)))
    returns = [F.struct(F.lit(h).alias("forward_horizon_h"), F.col(f"fwd_log_return_{h}h").alias("r")) for h in config.forward_horizons]
    rows = df.select(*keys, "open_time_utc", met.alias("met"), F.inline(F.array(*returns))).where("r IS NOT NULL")
    return rows.select(*keys, "open_time_utc", "forward_horizon_h", "r", F.inline("met"))


def pattern_stats(df: DataFrame, config: PatternConfig = PatternConfig(), keys: Sequence[str] = KEYS) -> DataFrame:
    """Statistics of the forward returns under each condition beside the baseline; conditions that never hold have a count of 0."""
    rows = conditional_long(df, config, keys)
    r = F.col("r")
    by = [*keys, "category", "condition_name", "forward_horizon_h"]
    found = rows.where("condition_name IS NOT NULL").groupBy(*by).agg(
        F.count(r).alias("sample_count"),
        F.avg(r).alias("sample_mean_fwd_log_return"),
        F.percentile(r, 0.5).alias("sample_median_fwd_log_return"),
        F.stddev_samp(r).alias("sample_std_fwd_log_return"),
        F.avg((r > 0).cast("double")).alias("sample_positive_rate"),
    )
    base = rows.where("condition_name IS NULL").groupBy(*keys, "forward_horizon_h").agg(
        F.count(r).alias("baseline_count"), F.avg(r).alias("baseline_mean_fwd_log_return"), F.avg((r > 0).cast("double")).alias("baseline_positive_rate")
    )
    names = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(n).alias("condition_name")) for c, n, _ in conditions(config)])
    full = base.select("*", F.inline(names)).join(found, by, "left")
    full = full.withColumn("sample_count", F.coalesce("sample_count", F.lit(0)))
    return full.withColumns(
        {
            "frequency": divide(F.col("sample_count"), F.col("baseline_count")),
            "mean_diff_vs_baseline": F.col("sample_mean_fwd_log_return") - F.col("baseline_mean_fwd_log_return"),
        }
    )


def evidence(count: Column, low: Column, high: Column, least: int) -> Column:
    return (
        F.when(count < least, "INSUFFICIENT_FREQUENCY")
        .when(low > 0, "POSITIVE_STATISTICAL_EDGE")
        .when(high < 0, "NEGATIVE_STATISTICAL_EDGE")
        .otherwise("NO_STATISTICAL_EDGE")
    )


def with_evidence(stats: DataFrame, intervals: DataFrame, config: PatternConfig = PatternConfig(), keys: Sequence[str] = KEYS) -> DataFrame:
    """``stats`` with bootstrap intervals (ci_low, ci_high) and the evidence class."""
    rows = stats.join(intervals, [*keys, "category", "condition_name", "forward_horizon_h"], "left")
    return rows.withColumn("evidence_status", evidence(F.col("sample_count"), F.col("ci_low"), F.col("ci_high"), config.min_samples))


def top_evidence(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("evidence_status").isin("POSITIVE_STATISTICAL_EDGE", "NEGATIVE_STATISTICAL_EDGE")).orderBy(
        "category", "forward_horizon_h", F.col("mean_diff_vs_baseline").desc()
    )


def of_category(rows: DataFrame, *categories: str) -> DataFrame:
    return rows.where(F.col("category").isin(*categories))
