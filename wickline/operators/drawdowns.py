"""Drawdown events and episodes, as islands over a running count of peaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import KEYS
from . import frames


def drawdown_series(bars: DataFrame, keys: Sequence[str] = KEYS, chunk: int | None = None) -> DataFrame:
    """running_max_close and drawdown of the closes, with idx; null closes are left out."""
    rows = frames.indexed(bars.where("close IS NOT NULL").drop("idx"), keys)
    rows = frames.running(rows, keys, {"running_max_close": ("max", F.col("close"))}, chunk)
    return rows.withColumn("drawdown", F.col("close") / F.col("running_max_close") - 1)


def events(series: DataFrame, keys: Sequence[str] = KEYS, chunk: int | None = None) -> DataFrame:
    """Falls from a peak to its recovery: the peak is the bar before the first loss, the trough the first lowest.

    A fall that is open at the end has recovered = false and lasts to the last bar.
    """
    rows = frames.running(series, keys, {"_g": ("sum", (F.col("drawdown") == 0).cast("long"))}, chunk)
    lost = F.col("drawdown") < 0
    rows = rows.withColumn("_end", F.max("open_time_utc").over(frames.whole(keys)))
    each = rows.groupBy(*keys, "_g").agg(
        F.max("_end").alias("_end"),
        F.min(F.struct("idx", F.col("open_time_utc").alias("t"), F.col("close").alias("c"))).alias("peak"),
        F.min(F.when(lost, F.struct(F.col("drawdown").alias("d"), F.col("idx"), F.col("open_time_utc").alias("t"), F.col("close").alias("c")))).alias("trough"),
    )
    # The next island begins where this one recovers.
    following = Window.partitionBy(*keys).orderBy("_g")
    each = each.withColumn("recovery_time_utc", F.lead("peak.t").over(following)).where("trough IS NOT NULL")
    hours = lambda a, b: (F.unix_timestamp(a) - F.unix_timestamp(b)) / 3600
    return each.select(
        *keys,
        F.col("peak.t").alias("peak_time_utc"),
        F.col("trough.t").alias("trough_time_utc"),
        "recovery_time_utc",
        F.col("peak.c").alias("peak_close"),
        F.col("trough.c").alias("trough_close"),
        F.col("trough.d").alias("max_drawdown"),
        hours(F.coalesce("recovery_time_utc", "_end"), F.col("peak.t")).alias("duration_hours_peak_to_recovery"),
        hours(F.col("recovery_time_utc"), F.col("trough.t")).alias("duration_hours_trough_to_recovery"),
        F.col("recovery_time_utc").isNotNull().alias("recovered"),
    )


def episodes(rows: DataFrame, keys: Sequence[str], drawdown: str = "drawdown", chunk: int | None = None) -> DataFrame:
    """From the first bar under water to the bar of recovery, or the last: start, trough and end, and depth."""
    base = frames.indexed(rows.select(*keys, "open_time_utc", F.col(drawdown).alias("d")), keys)
    base = frames.running(base, keys, {"_g": ("sum", (F.col("d") >= 0).cast("long"))}, chunk)
    under = F.col("d") < 0
    point = F.struct("idx", F.col("open_time_utc").alias("t"))
    each = base.groupBy(*keys, "_g").agg(
        F.min(F.when(under, point)).alias("first"),
        F.max(F.when(under, point)).alias("last"),
        F.min(F.when(under, F.struct("d", "idx", F.col("open_time_utc").alias("t")))).alias("trough"),
        F.min(point).alias("top"),
    )
    following = Window.partitionBy(*keys).orderBy("_g")
    each = each.withColumn("end", F.coalesce(F.lead("top").over(following), F.col("last"))).where("first IS NOT NULL")
    return each.select(
        *keys,
        F.col("first.idx").alias("start_idx"),
        F.col("trough.idx").alias("trough_idx"),
        F.col("end.idx").alias("end_idx"),
        F.col("trough.d").alias("depth"),
        F.col("first.t").alias("start_time"),
        F.col("trough.t").alias("trough_time"),
        F.col("end.t").alias("end_time"),
    )
