"""Descriptive statistics of bars with base features."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import KEYS
from ..functions.scalars import DAYS, DAYS_ES, divide
from . import frames

SUMMARY_METRICS = ("simple_return", "log_return", "abs_log_return", "range_pct", "volume")
QUANTILES = (0.001, 0.005, 0.01, 0.025, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.975, 0.99, 0.995, 0.999)


def long_form(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    """A row for each non-null value of the columns."""
    each = [F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns]
    return df.select(*keys, F.inline(F.array(*each))).where(F.col(value).isNotNull())


def sample_skew(x: Column) -> Column:
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(x: Column) -> Column:
    """Excess kurtosis, corrected for bias."""
    n = F.count(x).cast("double")
    return F.when(n > 3, divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def summary(df: DataFrame, keys: Sequence[str] = KEYS, annualization: float | None = 8760.0) -> DataFrame:
    """Count, location, spread, tails and shape of five columns; returns also annualised."""
    x = F.col("value")
    out = long_form(df, keys, SUMMARY_METRICS).groupBy(*keys, "metric").agg(
        F.count(x).alias("count"),
        F.avg(x).alias("mean"),
        F.percentile(x, 0.5).alias("median"),
        F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"),
        F.percentile(x, 0.01).alias("q01"),
        F.percentile(x, 0.05).alias("q05"),
        F.percentile(x, 0.95).alias("q95"),
        F.percentile(x, 0.99).alias("q99"),
        F.max(x).alias("max"),
        sample_skew(x).alias("skew"),
        sample_kurtosis(x).alias("excess_kurtosis"),
    )
    scaled = F.col("metric").isin("simple_return", "log_return") & F.lit(annualization is not None)
    a = annualization or 0.0
    return out.withColumns(
        {
            "annualized_mean_approx": F.when(scaled, F.col("mean") * a),
            "annualized_volatility_approx": F.when(scaled, F.col("std") * math.sqrt(a)),
        }
    )


def return_quantiles(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    columns = ("simple_return", "log_return", "abs_log_return", "range_pct")
    qs = F.array(*[F.lit(q) for q in QUANTILES])
    wide = df.groupBy(*keys).agg(*[F.percentile(c, qs).alias(c) for c in columns])
    rows = [F.struct(F.lit(q).alias("quantile"), *[F.col(c)[k].alias(c) for c in columns]) for k, q in enumerate(QUANTILES)]
    return wide.select(*keys, F.inline(F.array(*rows)))


def _volatility(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count("log_return").alias("observations"),
        F.avg("log_return").alias("mean_log_return"),
        F.stddev_samp("log_return").alias("volatility_std"),
        F.avg("abs_log_return").alias("mean_abs_return"),
        F.avg("range_pct").alias("mean_range_pct"),
        F.percentile("volume", 0.5).alias("median_volume"),
    )


def volatility_by_hour(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return _volatility(df, [*keys, "hour_utc"])


def volatility_by_weekday(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """All seven days, those without a bar too."""
    each = [F.struct(F.lit(a).alias("day_of_week"), F.lit(b).alias("day_of_week_es")) for a, b in zip(DAYS, DAYS_ES)]
    spine = df.select(*keys).distinct().select(*keys, F.inline(F.array(*each)))
    return spine.join(_volatility(df, [*keys, "day_of_week"]), [*keys, "day_of_week"], "left")


def behavior(df: DataFrame, by: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Ten statistics by hour_utc or day_of_week, for bars with pattern features; a null return is not positive."""
    positive = lambda c: F.avg(F.coalesce(F.col(c) > 0, F.lit(False)).cast("double"))
    return df.groupBy(*keys, by).agg(
        F.count("open_time_utc").alias("candles"),
        F.avg("log_return").alias("mean_log_return"),
        F.percentile("log_return", 0.5).alias("median_log_return"),
        F.stddev_samp("log_return").alias("volatility"),
        F.avg("abs_log_return").alias("mean_abs_log_return"),
        F.avg("range_pct").alias("mean_range_pct"),
        F.percentile("volume", 0.5).alias("median_volume"),
        positive("log_return").alias("positive_rate"),
        F.avg("fwd_log_return_1h").alias("mean_fwd_1h"),
        positive("fwd_log_return_1h").alias("positive_fwd_1h_rate"),
    )


def _directions(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    r = F.col("log_return")
    rows = df.where(r.isNotNull()).select(*keys, "open_time_utc", "log_return")
    return rows.withColumn("direction", F.when(r > 0, "up").when(r < 0, "down").otherwise("flat"))


def streaks(df: DataFrame, keys: Sequence[str] = KEYS, chunk: int | None = None) -> DataFrame:
    """Runs of rising or falling bars."""
    rows = frames.spread(frames.indexed(_directions(df, keys), keys), 1, 0, chunk)
    changed = ~F.col("direction").eqNullSafe(F.lag("direction").over(frames.over(keys, rows)))
    rows = frames.trim(rows.withColumn("_new", changed.cast("long")), chunk)
    rows = frames.running(rows, keys, {"_g": ("sum", F.col("_new"))}, chunk)
    out = rows.where("direction <> 'flat'").groupBy(*keys, "_g", "direction").agg(
        F.min("open_time_utc").alias("start_time_utc"),
        F.max("open_time_utc").alias("end_time_utc"),
        F.count("*").alias("length_bars"),
        F.sum("log_return").alias("cumulative_log_return"),
    )
    return out.drop("_g")


def streak_summary(found: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return found.groupBy(*keys, "direction").agg(
        F.count("*").alias("streak_count"),
        F.avg("length_bars").alias("mean_length"),
        F.percentile("length_bars", 0.5).alias("median_length"),
        F.max("length_bars").alias("max_length"),
        F.avg("cumulative_log_return").alias("mean_cumulative_log_return"),
        F.max(F.abs("cumulative_log_return")).alias("max_abs_cumulative_log_return"),
    )


def persistence(df: DataFrame, keys: Sequence[str] = KEYS, chunk: int | None = None) -> DataFrame:
    """How often a rise follows a rise and a fall a fall, and the same overall; flat bars are left out before."""
    rows = frames.indexed(_directions(df, keys).where("direction <> 'flat'"), keys)
    rows = frames.spread(rows, 0, 1, chunk)
    rows = frames.trim(rows.withColumn("next", F.lead("direction").over(frames.over(keys, rows))), chunk).where("next IS NOT NULL")
    same = F.avg((F.col("direction") == F.col("next")).cast("double"))
    by = rows.groupBy(*keys, F.col("direction").alias("current_direction")).agg(
        F.avg((F.col("next") == "up").cast("double")).alias("prob_next_up"), F.avg((F.col("next") == "down").cast("double")).alias("prob_next_down"), same.alias("persistence_probability")
    )
    overall = rows.groupBy(*keys).agg(same.alias("persistence_probability")).select(
        *keys, F.lit("overall").alias("current_direction"), F.lit(None).cast("double").alias("prob_next_up"), F.lit(None).cast("double").alias("prob_next_down"), "persistence_probability"
    )
    return by.unionByName(overall)


def autocorrelation(df: DataFrame, lags: int = 48, keys: Sequence[str] = KEYS, chunk: int | None = None) -> DataFrame:
    """Correlation of the log returns with themselves 1 to ``lags`` bars before; nulls are left out first."""
    rows = frames.indexed(df.where("log_return IS NOT NULL").select(*keys, "open_time_utc", "log_return"), keys)
    rows = frames.spread(rows, lags, 0, chunk)
    w = frames.over(keys, rows)
    rows = frames.trim(rows.withColumns({f"_{k}": F.lag("log_return", k).over(w) for k in range(1, lags + 1)}), chunk)
    wide = rows.groupBy(*keys).agg(*[F.corr("log_return", f"_{k}").alias(f"_{k}") for k in range(1, lags + 1)])
    return wide.select(*keys, F.posexplode(F.array(*[F.col(f"_{k}") for k in range(1, lags + 1)])).alias("lag", "autocorrelation")).withColumn("lag", F.col("lag") + 1)


PAIRS = tuple((x, y) for x in ("volume", "log1p_volume") for y in ("abs_log_return", "range_pct", "rolling_volatility"))


def correlations(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pearson and Spearman of volume and volatility, over complete pairs.

    Ranks are the mean ranks of ties: the values' counts are summed in order,
    which sorts distinct values and not rows.
    """
    rows = df.withColumn("log1p_volume", F.log1p("volume"))
    each = [F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(x).cast("double").alias("a"), F.col(y).cast("double").alias("b")) for x, y in PAIRS]
    pairs = rows.select(*keys, F.inline(F.array(*each))).where("a IS NOT NULL AND b IS NOT NULL")
    part = [*keys, "x", "y"]

    def ranked(c: str) -> DataFrame:
        counts = pairs.groupBy(*part, c).agg(F.count("*").alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy(*part).orderBy(c).rowsBetween(Window.unboundedPreceding, 0))
        return counts.select(*part, c, (upto - (F.col("_n") - 1) / 2.0).alias(f"_rank_{c}"))

    both = pairs.join(ranked("a"), [*part, "a"]).join(ranked("b"), [*part, "b"])
    return both.groupBy(*part).agg(
        F.corr("a", "b").alias("pearson_correlation"), F.corr("_rank_a", "_rank_b").alias("spearman_correlation"), F.count("*").alias("observations")
    )


def anomalies(df: DataFrame, stats: DataFrame, autocorr: DataFrame, corr: DataFrame, falls: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Findings by fixed thresholds: (type, metric, value, threshold, timestamp_utc)."""

    def found(rows: DataFrame, kind: str, metric: Column, value: Column, threshold: str, when: Column, ts: Column | None = None) -> DataFrame:
        return rows.where(when).select(
            *keys,
            F.lit(kind).alias("type"),
            metric.alias("metric"),
            value.alias("value"),
            F.lit(threshold).alias("threshold"),
            (F.lit(None).cast("timestamp") if ts is None else ts).alias("timestamp_utc"),
        )

    log_stats = stats.where("metric = 'log_return'")
    top_lag = autocorr.groupBy(*keys).agg(F.max_by(F.struct("lag", "autocorrelation"), F.struct(F.abs("autocorrelation"), -F.col("lag"))).alias("s"))
    top_corr = corr.groupBy(*keys).agg(F.max_by(F.struct("x", "y", "spearman_correlation"), F.struct(F.abs("spearman_correlation"), "x", "y")).alias("s"))
    worst = falls.groupBy(*keys).agg(F.min("max_drawdown").alias("v"))
    complete = df.dropna(subset=["open_time_utc", "log_return", "abs_log_return", "volume", "range_pct"])
    cut = complete.groupBy(*keys).agg(F.percentile("abs_log_return", 0.999).alias("_cut"))
    extreme = complete.join(cut, list(keys)).where(F.col("abs_log_return") >= F.col("_cut"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("abs_log_return").desc(), "open_time_utc"))
    extreme = extreme.withColumn("_rank", rank).where("_rank <= 20")
    parts = [
        found(log_stats, "return_distribution", F.lit("skew"), F.col("skew"), "abs(skew) > 1.0", F.abs("skew") > 1.0),
        found(log_stats, "return_distribution", F.lit("excess_kurtosis"), F.col("excess_kurtosis"), "excess_kurtosis > 3.0", F.col("excess_kurtosis") > 3.0),
        found(top_lag, "return_autocorrelation", F.concat(F.lit("lag_"), F.col("s.lag")), F.col("s.autocorrelation"), "abs(autocorrelation) > 0.05", F.abs("s.autocorrelation") > 0.05),
        found(
            top_corr,
            "volume_volatility_relationship",
            F.concat_ws(" vs ", "s.x", "s.y"),
            F.col("s.spearman_correlation"),
            "abs(spearman_correlation) > 0.30",
            F.abs("s.spearman_correlation") > 0.30,
        ),
        found(worst, "drawdown", F.lit("max_drawdown"), F.col("v"), "max_drawdown < -50%", F.col("v") < -0.5),
        found(extreme, "extreme_bar", F.lit("abs_log_return_top_0_1pct"), F.col("abs_log_return"), "abs_log_return >= quantile(99.9%)", F.lit(True), F.col("open_time_utc")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def histogram(df: DataFrame, column: str, bins: int = 150, keys: Sequence[str] = KEYS) -> DataFrame:
    """Counts in ``bins`` equal bins between the least and the greatest value, for a chart."""
    ends = df.groupBy(*keys).agg(F.min(column).alias("_a"), F.max(column).alias("_b"))
    rows = df.where(F.col(column).isNotNull()).join(ends, list(keys))
    width = (F.col("_b") - F.col("_a")) / bins
    k = F.least(F.coalesce(F.floor(divide(F.col(column) - F.col("_a"), width)), F.lit(0)), F.lit(bins - 1))
    return rows.groupBy(*keys, k.alias("bin"), (F.col("_a") + k * width).alias("left")).agg(F.count("*").alias("count"))


def fixed_sample(df: DataFrame, key: Sequence[str], n: int = 10_000, seed: int = 42) -> DataFrame:
    """At most ``n`` rows, those with the least hashes of their key: the same at every run."""
    return df.orderBy(F.xxhash64(F.lit(seed), *key)).limit(n)
