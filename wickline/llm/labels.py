"""Bounded samples of labelled rows, the only data that reaches the driver to fit a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample(
    rows: DataFrame, labels: DataFrame, label_col: str, n: int, where: Column | None = None, text_col: str | None = None, most_bytes: int | None = None
) -> DataFrame:
    """``rows`` joined to their 0/1 label (column label), at most ``n`` of them and ``most_bytes`` of ``text_col``.

    The labelled doc_ids with the least hashes are taken, the same at every
    run; they are at most ``n`` rows and so may be broadcast.  Null labels and
    ids are left out, the larger of repeated labels counts, and of rows that
    share a doc_id the least one.
    """
    known = labels.select("doc_id", F.col(label_col).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    known = known if where is None else known.where(where)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    joined = rows.join(F.broadcast(chosen), "doc_id")
    others = [c for c in joined.columns if c not in ("doc_id", "label")]
    one = joined.groupBy("doc_id", "label").agg(F.min(F.struct(*others)).alias("least")).select("doc_id", "label", "least.*")
    if most_bytes is None:
        return one
    so_far = F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    return one.withColumn("so_far", so_far).where(F.col("so_far") <= most_bytes).drop("so_far")
