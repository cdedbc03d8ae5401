"""Connected components of an edge table, distributed: alternating large-star and small-star steps.

A node's least neighbour comes from a partial aggregation; the joins meet a hub's many edges with its one row, which the
adaptive skew join splits. Before each round a task replaces its partition's edges by stars over the same nodes, so that as many
rounds are needed as groups cross partitions: none if the edges are few. Each round's table replaces the one before, whose files
are deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the least of the node and its neighbours."""
    near = _both_ways(edges)
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node's smaller neighbours and the node are linked to the least of them."""
    near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m"))
    moved = near.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _unsettled(edges: DataFrame) -> bool:
    """Whether a node has two smaller neighbours, or a smaller and a larger one: if none has, the groups are stars."""
    sides = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return not sides.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0").isEmpty()


def local_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges to the least node of each group of the edges a, b, of every other node in it."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(names)))
    for i, j in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        while parent[j] != j:
            parent[j] = j = parent[parent[j]]
        parent[max(i, j)] = min(i, j)
    for i, j in enumerate(parent):  # a parent is smaller, so it has its root by now
        parent[i] = parent[j]
    root = np.array(parent, np.int64)
    moved = np.flatnonzero(root != np.arange(len(root)))
    return names[moved], names[root[moved]]


def _contracted(edges: DataFrame) -> DataFrame:
    """Each partition's edges replaced by stars that join the same nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[np.array(x.column(i)) for i in (0, 1)] for x in batches if x.num_rows]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in local_stars(*map(np.concatenate, zip(*held, strict=True)))], names=["a", "b"])

    return edges.mapInArrow(run, edges.schema)


def stars(edges: DataFrame) -> DataFrame:
    """a, b: an edge of every node (a) that isn't the least one reachable to the one that is (b). edges: a, b of type long."""
    edges = written(_contracted(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), "edges")
    while _unsettled(edges):
        last, edges = edges, written(_contracted(_small_star(_large_star(edges))), "edges")
        remove(last)
    return edges


def rooted(edges: DataFrame) -> DataFrame:
    """node, root of all nodes of stars."""
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node reachable) of every node with an edge. edges: a, b of type long."""
    return rooted(stars(edges))
