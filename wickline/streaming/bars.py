"""Bars from a stream of events, and their idempotent load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import KEYS
from ..operators import features
from ..schemas import schema
from ..sources import sinks

EVENTS = schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")


def read_events(spark: SparkSession, path: str, pattern: str = "*.parquet", files_per_trigger: int = 100) -> DataFrame:
    reader = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", pattern)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_bars(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", interval: str = "1h", offset: float = 0.0) -> DataFrame:
    """OHLCV bars of tumbling windows; repeated events within the watermark count once.

    A window is emitted when the watermark passes its end, so the last bars of
    a stream that stops are held back.
    """
    unique = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    bars = unique.groupBy(F.window("ts", width), F.col("event_type").alias("symbol")).agg(
        (F.min_by("value", "ts") + offset).alias("open"),
        (F.max("value") + offset).alias("high"),
        (F.min("value") + offset).alias("low"),
        (F.max_by("value", "ts") + offset).alias("close"),
        F.sum("value").alias("volume"),
        F.count("*").alias("trades"),
    )
    return bars.select("symbol", F.lit(interval).alias("interval"), F.col("window.start").alias("open_time_utc"), "open", "high", "low", "close", "volume", "trades")


def sliding_volume(events: DataFrame, width: str = "24 hours", step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Volume and count over sliding windows."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width, step), F.col("event_type").alias("symbol"))
    return rows.agg(F.sum("value").alias("volume"), F.count("*").alias("trades")).select("symbol", F.col("window.end").alias("until"), "volume", "trades")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Events of a user without a pause longer than ``gap``."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return rows.agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(
        "user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events", "value"
    )


def load(bars: DataFrame, path: str, checkpoint: str):
    """Upsert each batch of bars; a repeated batch leaves the table as it was."""

    def batch(df: DataFrame, _: int) -> None:
        if not df.isEmpty():
            sinks.upsert(df, path)

    return bars.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load_enriched(bars: DataFrame, path: str, checkpoint: str):
    """As ``load``, then the touched series enriched anew into ``path``_enriched."""

    def batch(df: DataFrame, _: int) -> None:
        if df.isEmpty():
            return
        sinks.upsert(df, path)
        touched = df.sparkSession.read.parquet(path).join(df.select(*KEYS).distinct(), list(KEYS), "left_semi")
        sinks.replace_partitions(features.transform(touched), f"{path}_enriched")

    return bars.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
