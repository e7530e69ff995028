"""Bars made from the driver's tables, for queries and tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Added to the hourly and daily values, so that returns stay moderate.
HOURLY_OFFSET, DAILY_OFFSET = 1000.0, 1_000_000.0


def _bars(df: DataFrame, symbol: str, bucket: Column, value: str, order: str, offset: float, interval: str) -> DataFrame:
    out = df.groupBy(F.col(symbol).alias("symbol"), bucket.alias("open_time_utc")).agg(
        (F.min_by(value, order) + offset).alias("open"),
        (F.max(value) + offset).alias("high"),
        (F.min(value) + offset).alias("low"),
        (F.max_by(value, order) + offset).alias("close"),
        F.round(F.sum(value), 6).alias("volume"),
        F.count("*").alias("trades"),
    )
    return out.select("symbol", F.lit(interval).alias("interval"), "open_time_utc", "open", "high", "low", "close", "volume", "trades")


def hourly(spark: SparkSession, sf_dir: str, offset: float = HOURLY_OFFSET) -> DataFrame:
    """events: a series for each event type, a bar for each hour with events."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "ts", "value")
    return _bars(events, "event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")), "value", "ts", offset, "1h")


def daily(spark: SparkSession, sf_dir: str, offset: float = DAILY_OFFSET) -> DataFrame:
    """orders: a series for each priority, a bar for each day with orders."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey")
    return _bars(orders, "o_orderpriority", F.date_trunc("day", F.col("o_orderdate").cast("timestamp")), "o_totalprice", "o_orderkey", offset, "1d")
