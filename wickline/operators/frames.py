"""Ordered operations over series, plain or in chunks.

Bars are a series for each key.  By default all windows share one partition
and order, so Catalyst plans one exchange and one sort for any number of
ordered columns, and a series streams through its task.  Series too long for
one task (second bars of one instrument over decades) are cut by setting
``wickline.chunk.rows`` in the session, or a ``chunk`` argument: rows are then
numbered in two levels, windows of bounded reach run in chunks with copies of
the rows their frames reach, and running aggregates run inside chunks and
over the chunks' totals.  Both give the same results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SETTING = "wickline.chunk.rows"
BUCKET_SECONDS = 31 * 86_400


def chunk_rows(df: DataFrame, chunk: int | None = None) -> int | None:
    found = chunk or df.sparkSession.conf.get(SETTING, None)
    return int(found) if found else None


def indexed(df: DataFrame, keys: Sequence[str], order: str = "open_time_utc", name: str = "idx", chunk: int | None = None) -> DataFrame:
    """``df`` with the 0-based position of each row in its series, by ``order``; keys are not null."""
    if not chunk_rows(df, chunk):
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).cast("long"))
    bucket = F.floor(F.unix_timestamp(F.col(order).cast("timestamp")) / BUCKET_SECONDS)
    rows = df.withColumn("_bucket", F.coalesce(bucket, F.lit(-(1 << 40))))
    part = [*keys, "_bucket"]
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*part).agg(F.count("*").alias("_n"))
    offsets = counts.select(*part, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(*part).orderBy(order))
    return rows.withColumn("_rank", inside).join(offsets, part).withColumn(name, F.col("_offset") + F.col("_rank") - 1).drop("_bucket", "_rank", "_offset")


def spread(df: DataFrame, back: int, ahead: int = 0, chunk: int | None = None) -> DataFrame:
    """Rows dealt to chunks of their idx, with copies in the chunks whose frames reach them; unchanged without chunks."""
    size = chunk_rows(df, chunk)
    if not size:
        return df
    first = F.greatest(F.floor((F.col("idx") - ahead) / size), F.lit(0))
    last = F.floor((F.col("idx") + back) / size)
    return df.withColumn("_chunk", F.explode(F.sequence(first, last)))


def over(keys: Sequence[str], rows: DataFrame) -> WindowSpec:
    """The window of rows that were spread."""
    part = [*keys, "_chunk"] if "_chunk" in rows.columns else list(keys)
    return Window.partitionBy(*part).orderBy("idx")


def trim(df: DataFrame, chunk: int | None = None) -> DataFrame:
    """The rows themselves, without the copies."""
    if "_chunk" not in df.columns:
        return df
    return df.where(F.col("_chunk") == F.floor(F.col("idx") / chunk_rows(df, chunk))).drop("_chunk")


def running(df: DataFrame, keys: Sequence[str], exprs: dict[str, tuple[str, Column]], chunk: int | None = None) -> DataFrame:
    """Running aggregates by idx: name -> ("product" | "sum" | "max", column); nulls are passed over."""
    size = chunk_rows(df, chunk)
    aggs = {"product": F.product, "sum": F.sum, "max": F.max}
    if not size:
        w = Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({n: aggs[k](c).over(w) for n, (k, c) in exprs.items()})
    join = {
        "product": lambda a, b: F.coalesce(a, F.lit(1.0)) * b,
        "sum": lambda a, b: F.coalesce(a, F.lit(0)) + b,
        "max": lambda a, b: F.greatest(a, b),
    }
    rows = df.withColumns({"_chunk": F.floor(F.col("idx") / size), **{f"_in_{n}": c for n, (_, c) in exprs.items()}})
    part = [*keys, "_chunk"]
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*part).agg(*[aggs[k](f"_in_{n}").alias(f"_of_{n}") for n, (k, _) in exprs.items()])
    before = totals.select(*part, *[aggs[k](f"_of_{n}").over(earlier).alias(f"_before_{n}") for n, (k, _) in exprs.items()])
    inside = Window.partitionBy(*part).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_in_{n}": aggs[k](f"_in_{n}").over(inside) for n, (k, _) in exprs.items()}).join(before, part)
    rows = rows.withColumns({n: join[k](F.col(f"_before_{n}"), F.col(f"_in_{n}")) for n, (k, _) in exprs.items()})
    return rows.drop("_chunk", *[f"_in_{n}" for n in exprs], *[f"_before_{n}" for n in exprs])


def whole(keys: Sequence[str]) -> WindowSpec:
    """All rows of a series, in the partition of its ordered windows."""
    return Window.partitionBy(*keys)


def rolling(w: WindowSpec, size: int, shift: int = 0) -> WindowSpec:
    """The frame of ``size`` rows that ends ``shift`` rows before the current one."""
    return w.rowsBetween(-(size - 1) - shift, -shift)


def full(agg: Column, counted: Column, frame: WindowSpec, least: int) -> Column:
    """``agg`` over the frame where ``counted`` has at least ``least`` non-null values there, else null."""
    return F.when(F.count(counted).over(frame) >= least, agg.over(frame))
