"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialize

#: Edges up to which one task joins the forests of all partitions.
ONE_TASK = 1_000_000


def _stars(pairs: DataFrame) -> DataFrame:
    """Each (u, v) with m, the least of u and its v's."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return pairs.join(least, "u")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _stars(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small(edges: DataFrame) -> DataFrame:
    starred = _stars(edges)
    return starred.select("u", F.col("m").alias("v")).union(
        starred.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    )


def connected(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of the edges (a, b); the component is its least node.

    Each round joins the edges with one row a node, so a node with very many
    edges is a skewed join that Spark splits, never a group in one task.  Each
    round's edges are written, and rounds end when they no longer change, which
    takes about the logarithm of the longest path.  Null nodes and self loops
    are left out.
    """
    state = materialize(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), name
    )
    mark = _mark(state)
    while mark[0]:
        state = materialize(_small(_large(state).distinct()).distinct(), name)
        now = _mark(state)
        if now == mark:
            break
        mark = now
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        state.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).distinct()


def _mark(state: DataFrame) -> tuple:
    """A count and an order-free digest that tell whether a round changed anything."""
    return tuple(state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, sorted, and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while len(a):
        least = np.minimum(parent[a], parent[b])
        for side in (a, b):
            np.minimum.at(parent, parent[side], least)
        while (parent[parent] != parent).any():
            parent = parent[parent]
        apart = parent[a] != parent[b]
        a, b = a[apart], b[apart]
    return nodes, nodes[parent]


def joined(edges: DataFrame, name: str = "components") -> DataFrame:
    """Like ``connected``, with few jobs: each task leaves stars of its edges, and one joins them if they are few."""

    def local(names: list[str], loops: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sides = ([np.empty(0, np.int64)], [np.empty(0, np.int64)])
            for batch in batches:
                for side, column in zip(sides, batch.columns):
                    side.append(column.to_numpy())
            nodes, least = stars(*map(np.concatenate, sides))
            kept = slice(None) if loops else nodes != least
            yield pa.RecordBatch.from_arrays([pa.array(nodes[kept]), pa.array(least[kept])], names=names)
            give_back()

        return run

    known = edges.select("a", "b").where("a <> b")
    forest = materialize(known.mapInArrow(local(["a", "b"], False), "a long, b long"), f"{name}-forest")
    if forest.count() > ONE_TASK:
        return connected(forest, name)
    return materialize(forest.coalesce(1).mapInArrow(local(["node", "component"], True), "node long, component long"), name)
