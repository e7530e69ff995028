"""Windowed features of bars.

Every function numbers and spreads the bars once, computes all its columns
over the shared window, and drops the copies: one exchange and one sort for
any number of rolling columns.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..config import KEYS, PatternConfig, RegimeConfig
from ..functions.scalars import change, day_name, divide, finite, log_change
from . import frames


def windowed(bars: DataFrame, keys: Sequence[str], back: int, ahead: int, stages: list, chunk: int | None = None) -> DataFrame:
    """``stages``: functions of the window that give columns, each using those before it.

    ``back`` and ``ahead`` are the rows that all stages together reach.
    """
    rows = bars if "idx" in bars.columns else frames.indexed(bars, keys)
    rows = frames.spread(rows, back, ahead, chunk)
    w = frames.over(keys, rows)
    for stage in stages:
        rows = rows.withColumns(stage(w))
    out = frames.trim(rows, chunk)
    return out if "idx" in bars.columns else out.drop("idx")


def add_returns(bars: DataFrame, keys: Sequence[str] = KEYS, chunk: int | None = None) -> DataFrame:
    """open_to_open_return = next open / open - 1, and log_return = ln(close / open)."""
    return windowed(
        bars, keys, 0, 1, [lambda w: {"open_to_open_return": change(F.lead("open").over(w), F.col("open")), "log_return": log_change(F.col("close"), F.col("open"))}], chunk
    )


def _enrich_columns(w: WindowSpec) -> dict[str, Column]:
    def mean(n: int) -> Column:
        return frames.full(F.avg("close"), F.col("close"), frames.rolling(w, n), n)

    return {
        "sma_20": mean(20),
        "sma_50": mean(50),
        "rolling_vol_24h": frames.full(F.stddev_samp("open_to_open_return"), F.col("open_to_open_return"), frames.rolling(w, 24), 24),
        "weekday": F.weekday("open_time_utc"),
        "next_bar_weekday": F.weekday(F.lead("open_time_utc").over(w)),
    }


def add_features(bars: DataFrame, keys: Sequence[str] = KEYS, chunk: int | None = None) -> DataFrame:
    """SMA 20 and 50, the 24-bar deviation of open-to-open returns, weekday and next bar's weekday."""
    return windowed(bars, keys, 49, 1, [_enrich_columns], chunk)


def monthly_regimes(bars: DataFrame, keys: Sequence[str] = KEYS, config: RegimeConfig = RegimeConfig()) -> DataFrame:
    """Each month's first and last close, return and regime."""
    priced = bars.where(F.col("close").isNotNull())
    months = priced.groupBy(*keys, F.trunc(F.col("open_time_utc"), "month").alias("month")).agg(
        F.min_by("close", "open_time_utc").alias("first_close"), F.max_by("close", "open_time_utc").alias("last_close")
    )
    months = months.withColumn("monthly_return", change(F.col("last_close"), F.col("first_close")))
    r = F.col("monthly_return")
    regime = F.when(r >= config.bull_threshold, "Bull").when(r <= config.bear_threshold, "Bear").otherwise("Lateral")
    return months.withColumn("market_regime", regime)


def add_regime(bars: DataFrame, keys: Sequence[str] = KEYS, config: RegimeConfig = RegimeConfig()) -> DataFrame:
    """Each bar with its month's regime."""
    months = monthly_regimes(bars, keys, config).select(*keys, F.col("month").alias("_month"), "market_regime")
    return bars.withColumn("_month", F.trunc(F.col("open_time_utc"), "month")).join(months, [*keys, "_month"], "left").drop("_month")


def transform(bars: DataFrame, keys: Sequence[str] = KEYS, chunk: int | None = None) -> DataFrame:
    """Returns, features and regime; the windowed columns share one exchange."""
    rows = windowed(
        bars,
        keys,
        49,
        # The deviation at a bar needs the return at that bar, which needs the next open.
        1,
        [
            lambda w: {"open_to_open_return": change(F.lead("open").over(w), F.col("open")), "log_return": log_change(F.col("close"), F.col("open"))},
            _enrich_columns,
        ],
        chunk,
    )
    return add_regime(rows, keys)


def base_features(bars: DataFrame, rolling_window: int = 24, keys: Sequence[str] = KEYS, chunk: int | None = None) -> DataFrame:
    """Close-to-close returns, ranges, wicks, volume change, rolling deviation and mean, hour, day and date."""
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))

    def first(w: WindowSpec) -> dict[str, Column]:
        before = F.lag("close").over(w)
        return {
            "simple_return": change(c, before),
            "log_return": log_change(c, before),
            "range_pct": divide(h - low, c),
            "body_pct": divide(F.abs(c - o), o),
            "upper_wick_pct": divide(h - F.greatest(o, c), o),
            "lower_wick_pct": divide(F.least(o, c) - low, o),
            "volume_change_pct": change(F.col("volume"), F.lag("volume").over(w)),
            "hour_utc": F.hour("open_time_utc"),
            "day_of_week": day_name(F.weekday("open_time_utc")),
            "date_utc": F.date_format("open_time_utc", "yyyy-MM-dd"),
        }

    def second(w: WindowSpec) -> dict[str, Column]:
        frame = frames.rolling(w, rolling_window)
        r = F.col("log_return")
        return {
            "abs_log_return": F.abs(r),
            "squared_log_return": r * r,
            "rolling_volatility": frames.full(F.stddev_samp(r), r, frame, rolling_window),
            "rolling_mean_return": frames.full(F.avg(r), r, frame, rolling_window),
        }

    return windowed(bars, keys, rolling_window, 0, [first, second], chunk)


def zscore(x: Column, frame: WindowSpec, least: int) -> Column:
    """(x - mean) / population deviation over the frame."""
    mean, dev = frames.full(F.avg(x), x, frame, least), frames.full(F.stddev_pop(x), x, frame, least)
    return F.when(dev > 0, (x - mean) / dev)


RETURN_WINDOWS = (3, 6, 12, 24, 48, 72, 168)
CONTEXT_WINDOWS = (24, 72, 168, 336)
SMA_WINDOWS = (20, 50, 100, 200)


def research_features(bars: DataFrame, keys: Sequence[str] = KEYS, chunk: int | None = None) -> DataFrame:
    """Momentum, volatility, volume, range and trend features, and rolling-quantile regimes."""
    c = F.col("close")

    def first(w: WindowSpec) -> dict[str, Column]:
        before = F.lag("close").over(w)
        out = {
            "simple_return_1h": change(c, before),
            "log_return_1h": log_change(c, before),
            "range_pct": divide(F.col("high") - F.col("low"), c),
            "body_pct": divide(F.abs(c - F.col("open")), c),
            "hour_utc": F.hour("open_time_utc"),
            "day_of_week_utc": F.weekday("open_time_utc"),
            "is_weekend": (F.weekday("open_time_utc") >= 5).cast("int"),
            "log_volume": F.log1p(F.col("volume")),
        }
        for n in RETURN_WINDOWS:
            past = F.lag("close", n).over(w)
            out |= {f"return_{n}h": change(c, past), f"log_return_{n}h": log_change(c, past)}
        for n in SMA_WINDOWS:
            mean = frames.full(F.avg("close"), c, frames.rolling(w, n), n)
            out |= {f"sma_{n}": mean, f"sma_distance_{n}": divide(c - mean, mean)}
        for n in CONTEXT_WINDOWS:
            least, before_frame = max(5, n // 3), frames.rolling(w, n, 1)
            out |= {
                f"rolling_high_prev_{n}h": frames.full(F.max("high"), F.col("high"), before_frame, least),
                f"rolling_low_prev_{n}h": frames.full(F.min("low"), F.col("low"), before_frame, least),
            }
        return out

    def second(w: WindowSpec) -> dict[str, Column]:
        out = {"abs_log_return_1h": F.abs("log_return_1h")}
        for n in CONTEXT_WINDOWS:
            frame, least = frames.rolling(w, n), max(5, n // 3)
            out |= {
                f"rolling_vol_{n}h": frames.full(F.stddev_pop("log_return_1h"), F.col("log_return_1h"), frame, least),
                f"volume_zscore_{n}h": zscore(F.col("log_volume"), frame, n),
                f"range_zscore_{n}h": zscore(F.col("range_pct"), frame, n),
            }
        return out

    def third(w: WindowSpec) -> dict[str, Column]:
        frame = frames.rolling(w, 168, 1)

        def regime(name: str) -> Column:
            x = F.col(name)
            low, high = (frames.full(F.percentile(x, q), x, frame, 50) for q in (0.33, 0.67))
            # A null value or threshold compares as false and so reads "high".
            return F.when(x <= low, "low").when(x <= high, "mid").otherwise("high")

        return {"volatility_regime_24h": regime("rolling_vol_24h"), "volume_regime_168h": regime("volume_zscore_168h")}

    return windowed(bars, keys, 336 + 168 + 1, 0, [first, second, third], chunk).drop("log_volume")


def pattern_features(bars: DataFrame, config: PatternConfig = PatternConfig(), keys: Sequence[str] = KEYS, chunk: int | None = None) -> DataFrame:
    """Forward returns, and events by thresholds of the past only."""
    c, n = F.col("close"), config.context_window

    def first(w: WindowSpec) -> dict[str, Column]:
        before = F.lag("close").over(w)
        out = {
            "simple_return": change(c, before),
            "log_return": log_change(c, before),
            "range_pct": divide(F.col("high") - F.col("low"), c),
            "body_pct": divide(F.abs(c - F.col("open")), F.col("open")),
            "hour_utc": F.hour("open_time_utc"),
            "day_of_week": day_name(F.weekday("open_time_utc")),
            "day_of_week_num": F.weekday("open_time_utc"),
            "is_weekend": F.weekday("open_time_utc") >= 5,
        }
        for h in config.forward_horizons:
            later = F.lead("close", h).over(w)
            out |= {f"fwd_log_return_{h}h": log_change(later, c), f"fwd_simple_return_{h}h": change(later, c)}
        for m in config.momentum_windows:
            out[f"past_log_return_{m}h"] = log_change(c, F.lag("close", m).over(w))
        return out

    def second(w: WindowSpec) -> dict[str, Column]:
        frame = frames.rolling(w, n, 1)
        r, v = F.col("range_pct"), F.col("volume")

        def past(agg: Column, x: Column, size: int = n) -> Column:
            return frames.full(agg, x, frames.rolling(w, size, 1), size)

        out = {
            "abs_log_return": F.abs("log_return"),
            "rolling_vol_24h_past": past(F.stddev_samp("log_return"), F.col("log_return"), config.short_vol_window),
            "rolling_vol_168h_past": past(F.stddev_samp("log_return"), F.col("log_return"), config.long_vol_window),
            "rolling_range_median_168h_past": past(F.percentile(r, 0.5), r),
            "range_q20_168h_past": past(F.percentile(r, config.low_quantile), r),
            "range_q80_168h_past": past(F.percentile(r, config.high_quantile), r),
            "volume_zscore_168h_past": divide(v - past(F.avg(v), v), F.nullif(past(F.stddev_samp(v), v), F.lit(0.0))),
        }
        for m in config.momentum_windows:
            x = F.col(f"past_log_return_{m}h")
            out |= {
                f"past_log_return_{m}h_q20_past": frames.full(F.percentile(x, config.low_quantile), x, frame, n),
                f"past_log_return_{m}h_q80_past": frames.full(F.percentile(x, config.high_quantile), x, frame, n),
            }
        return out

    def third(w: WindowSpec) -> dict[str, Column]:
        z = F.col("volume_zscore_168h_past")
        event = lambda x: F.coalesce(x, F.lit(False))
        out = {
            "vol_expansion_event": event(F.col("range_pct") > F.col("range_q80_168h_past")),
            "vol_contraction_event": event(F.col("range_pct") < F.col("range_q20_168h_past")),
            "high_volume_event": event(z > 1.0),
            "low_volume_event": event(z < -1.0),
        }
        for m in config.momentum_windows:
            x = F.col(f"past_log_return_{m}h")
            out |= {
                f"momentum_up_{m}h_event": event(x > F.col(f"past_log_return_{m}h_q80_past")),
                f"momentum_down_{m}h_event": event(x < F.col(f"past_log_return_{m}h_q20_past")),
            }
        return out

    return windowed(bars, keys, n + max(*config.momentum_windows, config.short_vol_window) + 1, max(config.forward_horizons), [first, second, third], chunk)


def range_contraction(bars: DataFrame, window: int = 168, quantile: float = 0.20, keys: Sequence[str] = KEYS, chunk: int | None = None) -> DataFrame:
    """low_range_contraction: a range below the quantile of the ``window`` bars before."""
    r = F.coalesce(finite(divide(F.col("high") - F.col("low"), F.col("close"))), F.lit(0.0))

    def second(w: WindowSpec) -> dict[str, Column]:
        frame = frames.rolling(w, window, 1)
        return {"range_q20": frames.full(F.percentile("range_pct", quantile), F.col("range_pct"), frame, window)}

    return windowed(
        bars,
        keys,
        window,
        0,
        [lambda w: {"range_pct": r}, second, lambda w: {"low_range_contraction": F.coalesce(F.col("range_pct") < F.col("range_q20"), F.lit(False))}],
        chunk,
    )


def trend_volatility_regimes(
    bars: DataFrame, config: RegimeConfig = RegimeConfig(), annualization: float = 8760.0, keys: Sequence[str] = KEYS, chunk: int | None = None
) -> DataFrame:
    """Trend by the price against a long mean, volatility against full-sample quantiles, and both as one label."""
    least_trend, least_vol = max(50, config.trend_window // 4), max(50, config.vol_window // 4)

    def first(w: WindowSpec) -> dict[str, Column]:
        return {
            "_log_return": log_change(F.col("close"), F.lag("close").over(w)),
            "sma_trend": frames.full(F.avg("close"), F.col("close"), frames.rolling(w, config.trend_window), least_trend),
        }

    def second(w: WindowSpec) -> dict[str, Column]:
        r = F.col("_log_return")
        return {"realized_vol": frames.full(F.stddev_samp(r), r, frames.rolling(w, config.vol_window), least_vol) * math.sqrt(annualization)}

    rows = windowed(bars, keys, max(config.trend_window, config.vol_window + 1), 0, [first, second], chunk).drop("_log_return")
    quantiles = F.percentile("realized_vol", F.array(F.lit(config.vol_low_quantile), F.lit(config.vol_high_quantile)))
    limits = rows.groupBy(*keys).agg(F.when(F.count("realized_vol") >= config.min_valid, quantiles).alias("_q"))
    limits = limits.select(*keys, F.col("_q")[0].alias("vol_low_threshold"), F.col("_q")[1].alias("vol_high_threshold"))
    rows = rows.join(limits, list(keys))
    ratio = change(F.col("close"), F.col("sma_trend"))
    vol, low, high = F.col("realized_vol"), F.col("vol_low_threshold"), F.col("vol_high_threshold")
    trend = F.when(ratio > config.trend_band, "BULL").when(ratio < -config.trend_band, "BEAR").when(ratio.isNotNull(), "RANGE").otherwise("WARMUP")
    level = F.when(vol <= low, "LOWVOL").when(vol >= high, "HIGHVOL").when(vol.isNotNull() & low.isNotNull(), "MEDVOL").otherwise("WARMUP")
    rows = rows.withColumns({"trend_regime": trend, "vol_regime": level})
    warm = (F.col("trend_regime") == "WARMUP") | (F.col("vol_regime") == "WARMUP")
    return rows.withColumn("regime_label", F.when(warm, "WARMUP").otherwise(F.concat_ws("_", "trend_regime", "vol_regime")))


def daily_volatility(bars: DataFrame, days: int = 30, keys: Sequence[str] = KEYS, chunk: int | None = None) -> DataFrame:
    """The deviation of a calendar day's returns times the root of 365, and its mean over ``days`` days.

    The calendar has every day from a series' first to its last; empty days have no deviation.
    """
    rows = windowed(bars, keys, 1, 0, [lambda w: {"_r": log_change(F.col("close"), F.lag("close").over(w))}], chunk)
    rows = rows.withColumn("day", F.to_date("open_time_utc"))
    per_day = rows.groupBy(*keys, "day").agg((F.stddev_samp("_r") * math.sqrt(365)).alias("daily_vol"))
    spine = rows.groupBy(*keys).agg(F.min("day").alias("a"), F.max("day").alias("b")).select(*keys, F.explode(F.sequence("a", "b")).alias("day"))
    full = spine.join(per_day, [*keys, "day"], "left").withColumn("open_time_utc", F.col("day").cast("timestamp"))
    mean = lambda w: {"rolling_vol": frames.full(F.avg("daily_vol"), F.col("daily_vol"), frames.rolling(w, days), days)}
    return windowed(full, keys, days, 0, [mean], chunk).drop("open_time_utc")


def silver(bars: DataFrame) -> DataFrame:
    """Casts and row-wise columns: bar_return, log_return, range_pct, weekday and year_month."""
    from ..sources.cleaning import numbers

    rows = numbers(bars)
    return rows.withColumns(
        {
            "bar_return": change(F.col("close"), F.col("open")),
            "log_return": log_change(F.col("close"), F.col("open")),
            "range_pct": divide(F.col("high") - F.col("low"), F.col("open")),
            "weekday": F.weekday("open_time_utc"),
            "year_month": F.date_format("open_time_utc", "yyyy-MM"),
        }
    )


def _periods(bars: DataFrame, keys: Sequence[str], period: Column) -> DataFrame:
    return bars.groupBy(*keys, period).agg(
        F.min_by("open", "open_time_utc").alias("open_price"),
        F.max("high").alias("high_price"),
        F.min("low").alias("low_price"),
        F.max_by("close", "open_time_utc").alias("close_price"),
        F.sum("volume").alias("volume"),
        F.count("*").alias("bars"),
    )


def daily_ohlcv(bars: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """A row a day, with daily_return and the integer date_id."""
    days = _periods(bars, keys, F.to_date("open_time_utc").alias("trade_date"))
    return days.withColumns(
        {"daily_return": change(F.col("close_price"), F.col("open_price")), "date_id": F.date_format("trade_date", "yyyyMMdd").cast("int")}
    )


def monthly_returns(bars: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    months = _periods(bars, keys, F.date_format("open_time_utc", "yyyy-MM").alias("year_month"))
    return months.withColumn("monthly_return", change(F.col("close_price"), F.col("open_price")))
