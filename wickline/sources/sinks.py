"""Sinks: Parquet, CSV, JSON and Markdown, and the idempotent table writes.

Plain Parquet has no MERGE: an upsert writes the merged partitions to a
staging path and then overwrites just those partitions, so a path is never
read and overwritten in one job, and a failed job leaves the table as it was.
"""

from __future__ import annotations

import json
import logging
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import KLINES_DECIMALS, KLINES_KEY
from .cleaning import deduplicated

log = logging.getLogger(__name__)


def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, fs = _hadoop(spark, path)
    return fs.exists(target)


def delete(spark: SparkSession, path: str) -> None:
    target, fs = _hadoop(spark, path)
    fs.delete(target, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file on any file system."""
    target, fs = _hadoop(spark, path)
    out = fs.create(target, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def as_klines(df: DataFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
    """The sink's decimals, overflow and NaN as null; only ``columns`` if given."""
    df = df.select(*[c for c in columns if c in df.columns]) if columns else df
    return df.withColumns({c: F.col(c).try_cast(d) for c, d in KLINES_DECIMALS.items() if c in df.columns})


def merged(old: DataFrame | None, new: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """New rows replace old rows of their key; within one side the row with the greatest values stays."""
    if old is not None:
        both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    else:
        both = new.withColumn("_side", F.lit(1))
    rest = [c for c in both.columns if c not in key and c != "_side"]
    return deduplicated(both, list(key), ["_side", *rest]).drop("_side")


def upsert(df: DataFrame, path: str, key: tuple[str, ...] = KLINES_KEY, partition_by: tuple[str, ...] = ("symbol", "interval")) -> int:
    """Insert or replace rows by key; touches only the partitions of ``df``.  Returns how many it wrote.

    ``df`` is computed once, into a staging folder of its own.
    """
    spark = df.sparkSession
    staging = f"{path.rstrip('/')}_staging_{uuid.uuid4().hex}"
    df = df.withColumn("_new", F.lit(True))
    old = None
    if exists(spark, path):
        touched = df.select(*partition_by).distinct()
        old = spark.read.parquet(path).join(touched, list(partition_by), "left_semi")
    merged(old, df, key).write.mode("overwrite").partitionBy(*partition_by).parquet(staging)
    staged = spark.read.parquet(staging)
    rows = staged.where("_new").count()
    staged.drop("_new").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)
    delete(spark, staging)
    return rows


def replace_partitions(df: DataFrame, path: str, partition_by: tuple[str, ...] = ("symbol", "interval")) -> None:
    """Delete and insert: the partitions of ``df`` hold just its rows afterwards."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def append_results(df: DataFrame, path: str) -> None:
    """Append backtest results; a missing run_date is today."""
    date = F.coalesce(F.col("run_date"), F.current_date()) if "run_date" in df.columns else F.current_date()
    df.withColumn("run_date", date).write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str, float_format: str | None = None) -> None:
    """One CSV file with a header; for report tables, which are small.  ``float_format`` like "%.6f"."""
    if float_format:
        df = df.withColumns({f.name: F.format_string(float_format, f.name) for f in df.schema if isinstance(f.dataType, T.DoubleType)})
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_json(spark: SparkSession, path: str, payload: dict) -> None:
    write_text(spark, path, json.dumps(payload, indent=2, ensure_ascii=False, default=str))


def markdown(df: DataFrame, rows: int = 20) -> str:
    """The first ``rows`` rows as a Markdown table; a report shows that many."""
    if not df.columns:
        return ""

    def cell(value) -> str:
        if value is None or value != value:
            return ""
        return f"{value:.6f}" if isinstance(value, float) else str(value).replace("|", "\\|")

    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(cell(v) for v in r) + " |" for r in df.limit(rows).collect()]
    return "\n".join(lines)


def report(spark: SparkSession, path: str, title: str, sections: list[tuple[str, DataFrame | str]]) -> None:
    """A Markdown report of texts and tables."""
    parts = [f"# {title}"]
    for name, content in sections:
        parts += [f"## {name}", content if isinstance(content, str) else markdown(content)]
    write_text(spark, path, "\n\n".join(parts) + "\n")


def write_jdbc(df: DataFrame, table: str, options: dict[str, str], mode: str = "append") -> None:
    """Append over JDBC; an upsert there goes to a staging table and one INSERT ... ON CONFLICT."""
    df.write.format("jdbc").options(**options, dbtable=table).mode(mode).save()
