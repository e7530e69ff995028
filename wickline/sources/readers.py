"""Scans of bars: Parquet and CSV files, one symbol or many, and JDBC tables."""

from __future__ import annotations

import logging
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RAW_BAR, REQUIRED
from .cleaning import ingest_order

log = logging.getLogger(__name__)


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A Parquet or CSV table, by the path's suffix; other suffixes are an error."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix == ".parquet":
        return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    if suffix == ".csv":
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader).csv(path)
    raise ValueError(f"not a Parquet or CSV path: {path}")


def _status(spark: SparkSession, pattern: str) -> list:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return list(found) if found is not None else []


def find_newest(spark: SparkSession, root: str, symbol: str, interval: str = "1h") -> str | None:
    """The last Parquet file, by name, under root/symbol/interval; any file system."""
    names = [s.getPath().toString() for s in _status(spark, f"{root}/{symbol}/{interval}/*.parquet")]
    return max(names, default=None)


def missing_columns(df: DataFrame, required: tuple[str, ...] = REQUIRED) -> list[str]:
    have = {c.lower() for c in df.columns}
    return [c for c in required if c not in have]


def load_symbol(spark: SparkSession, root: str, symbol: str, interval: str = "1h", ordered: bool = False) -> DataFrame:
    """The newest file of a symbol, times as UTC; an empty table if there is none or columns lack.

    ``ordered``: with the rows' place in the file.
    """
    path = find_newest(spark, root, symbol, interval)
    empty = spark.createDataFrame([], RAW_BAR)
    if path is None:
        log.warning("no file for %s %s", symbol, interval)
        return empty
    df = spark.read.parquet(path)
    if lacking := missing_columns(df):
        log.error("%s lacks %s", path, lacking)
        return empty
    if ordered:
        df = ingest_order(df)
    df = df.withColumns({c: F.col(c).cast("timestamp") for c in ("open_time_utc", "close_time_utc") if c in df.columns})
    return df.withColumns({"symbol": F.lit(symbol), "interval": F.lit(interval)})


def load_symbols(spark: SparkSession, root: str, symbols: list[str], interval: str = "1h", ordered: bool = False) -> DataFrame:
    """All symbols in one table; those without a usable file are left out with a warning."""
    out = None
    for symbol in symbols:
        if find_newest(spark, root, symbol, interval):
            one = load_symbol(spark, root, symbol, interval, ordered)
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        else:
            log.warning("skipping %s", symbol)
    return spark.createDataFrame([], RAW_BAR) if out is None else out


def klines_between(klines: DataFrame, symbol: str, interval: str = "1h", start=None, end=None) -> DataFrame:
    """Bars of a symbol in [start, end], both included, by time; the predicates reach the scan."""
    out = klines.where((F.col("symbol") == symbol) & (F.col("interval") == interval))
    if start is not None:
        out = out.where(F.col("open_time_utc") >= F.lit(start).cast("timestamp"))
    if end is not None:
        out = out.where(F.col("open_time_utc") <= F.lit(end).cast("timestamp"))
    return out.orderBy("open_time_utc")


def jdbc_options(env: dict[str, str] | None = None) -> dict[str, str]:
    """JDBC options of the PostgreSQL sink, from DB_HOST, DB_PORT, DB_NAME, DB_USER and DB_PASSWORD."""
    env = dict(os.environ) if env is None else env
    host, port, name = env.get("DB_HOST", "localhost"), env.get("DB_PORT", "5432"), env.get("DB_NAME", "bars")
    return {
        "url": f"jdbc:postgresql://{host}:{port}/{name}",
        "user": env.get("DB_USER", "postgres"),
        "password": env.get("DB_PASSWORD", ""),
        "driver": "org.postgresql.Driver",
        "batchsize": "1000",
    }


def read_jdbc(spark: SparkSession, table: str, env: dict[str, str] | None = None, **partitioning: str) -> DataFrame:
    """A JDBC table; give partitionColumn, lowerBound, upperBound and numPartitions to read in parallel."""
    return spark.read.format("jdbc").options(**jdbc_options(env), dbtable=table, **partitioning).load()


def date_and_value_columns(columns: list[str]) -> tuple[str | None, str | None]:
    """The first column that names a time and the first that names an equity, by parts of their names."""
    low = [(c, c.lower()) for c in columns]
    time = next((c for c, n in low if any(k in n for k in ("date", "time", "period"))), None)
    value = next((c for c, n in low if any(k in n for k in ("equity", "cumul", "value", "nav"))), None)
    return time, value
