"""Canonical tables and their constraints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType,
    "timestamp": T.TimestampType,
    "timestamp_ntz": T.TimestampNTZType,
    "double": T.DoubleType,
    "int": T.IntegerType,
    "long": T.LongType,
    "date": T.DateType,
}


def schema(ddl: str) -> T.StructType:
    """A flat schema from "name type, ..." without a session, which the parser of Spark needs."""
    return T.StructType([T.StructField(n, _TYPES[t]()) for n, t in (part.split() for part in ddl.split(","))])


PRICES = ("open", "high", "low", "close")

RAW_BAR = schema(
    "symbol string, interval string, open_time_utc timestamp, close_time_utc timestamp, open double, high double, low double, "
    "close double, volume double, quote_asset_volume double, number_of_trades int, taker_buy_base_asset_volume double, "
    "taker_buy_quote_asset_volume double"
)
ENRICHED = (
    "open_to_open_return",
    "log_return",
    "rolling_vol_24h",
    "sma_20",
    "sma_50",
    "weekday",
    "next_bar_weekday",
    "market_regime",
)
REQUIRED = ("open_time_utc", *PRICES, "volume")

KLINES_KEY = ("symbol", "interval", "open_time_utc")
#: Decimals of the klines sink; computation stays in double.
KLINES_DECIMALS = {c: "decimal(20,8)" for c in PRICES} | {
    "volume": "decimal(30,8)",
    "quote_asset_volume": "decimal(30,2)",
    "open_to_open_return": "decimal(12,8)",
    "log_return": "decimal(12,8)",
    "rolling_vol_24h": "decimal(12,8)",
    "sma_20": "decimal(20,8)",
    "sma_50": "decimal(20,8)",
}

QUALITY = schema(
    "symbol string, interval string, check_name string, severity string, total_rows long, passed_rows long, failed_rows long, "
    "pass_rate double, detail string, run_at timestamp"
)
BACKTEST_RESULTS = schema(
    "symbol string, strategy_name string, run_date date, total_return double, bh_return double, excess_return double, "
    "sharpe_ratio double, max_drawdown double, cagr double, win_rate double, profit_factor double, total_trades int, "
    "pos_pct double, beat_pct double, mc_percentile double"
)


def valid_bar() -> Column:
    """The constraints of the klines table; rows that break them are quarantined, not raised on."""
    ok = F.col("open_time_utc").isNotNull()
    for c in PRICES:
        ok = ok & (F.col(c) > 0)
    ok = ok & (F.col("high") >= F.greatest("open", "close")) & (F.col("low") <= F.least("open", "close")) & (F.col("volume") >= 0)
    return F.coalesce(ok, F.lit(False))
