"""Connected components: alternating large-star and small-star steps in DataFrames, with the edges of a partition contracted in between."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shards import durable, swept

#: Edges (16 bytes each) that a partition is given to contract.
EDGES = 1 << 16


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as stars: each node with the smallest one that it reaches inside the partition."""
    parts = [(np.array(b.column(0), np.int64), np.array(b.column(1), np.int64)) for b in batches if b.num_rows]
    if not parts:
        return
    a, b = (np.concatenate([p[k] for p in parts]) for k in range(2))
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root, x, y = np.arange(len(node)), at[: len(a)], at[len(a) :]
    # the smaller root takes the larger one until no edge joins two roots
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        open_ = low < high
        if not open_.any():
            break
        x, y = x[open_], y[open_]
        np.minimum.at(root, high[open_], low[open_])
        while (root != root[root]).any():
            root = root[root]
    leaf = root != np.arange(len(root))
    yield pa.RecordBatch.from_arrays([pa.array(node[root[leaf]]), pa.array(node[leaf])], ["a", "b"])


def _contracted(edges: DataFrame) -> DataFrame:
    own = durable(edges.distinct())
    return durable(own.coalesce(max(1, -(-own.count() // EDGES))).mapInArrow(_union, "a long, b long"))


def _done(now: DataFrame) -> bool:
    """Whether all edges are stars: no node has two labels, and no label has one."""
    ends = now.select(F.col("b").alias("n"), F.lit(1).alias("leaf"), F.lit(0).alias("label")).unionByName(now.select(F.col("a").alias("n"), F.lit(0).alias("leaf"), F.lit(1).alias("label")))
    with swept(now.sparkSession):
        return ends.groupBy("n").agg(F.sum("leaf").alias("leaf"), F.max("label").alias("label")).where("leaf + label > 1 AND leaf > 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b): label is the component's smallest node.

    Null ends and loops are dropped, so a node with nothing but loops has no row.  Each round first contracts
    the edges inside each partition of about EDGES, which leaves at most an edge for each of its nodes; the
    steps between them run over the cluster until all edges are stars.  Minima are summed up before they are
    joined back, and each round is written to the shared folder.
    """
    now = _contracted(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    while not _done(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # every larger neighbour is tied to the smallest node around
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("n"), "m").distinct()
        low = large.groupBy("n").agg(F.min("m").alias("low"))
        # every smaller neighbour, and the node itself, to the smallest of them
        small = large.join(low, "n").where("m <> low").select(F.col("low").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("low").alias("a"), F.col("n").alias("b")))
        now = _contracted(small.select("a", "b"))
    return now.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("label"))).distinct()
