"""Connected components of an edge list, by alternating large-star and small-star steps.

Each step rewires edges towards the smallest neighbour, so a graph of any shape becomes stars in about
log(n) rounds; every round is two joins on nodes and is written to the checkpoint folder.  Nothing is
collected but whether all are stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, stored


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs: (u, v), u > v. Large-star links the larger neighbours of a node to its smallest; small-star the rest."""
    if large:
        near = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = pairs
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = near.join(least, "u")
    if large:
        out = moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def _settled(pairs: DataFrame) -> bool:
    """Whether every node leads to one other only, which leads nowhere: stars, whose middle is the smallest node."""
    twice = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("u")
    further = pairs.select(F.col("v").alias("u")).join(pairs.select("u"), "u", "left_semi")
    return twice.unionByName(further).isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 100) -> DataFrame:
    """node, root: every node with an edge to another and the smallest node of its component.

    Loops, repeated edges and either direction are fine; null ends are ignored; no edges give no rows.
    """
    pairs = saved(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct())
    for _ in range(rounds):
        if _settled(pairs):
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        pairs = saved(_star(_star(pairs, True), False))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]) for b in batches if len(b)]
    nodes, ends = np.unique(np.concatenate(parts, axis=1) if parts else np.zeros((2, 0), np.int64), return_inverse=True)
    a, b = ends.reshape(2, -1)
    root = np.arange(len(nodes))
    while not np.array_equal(root[a], root[b]):
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while not np.array_equal(root, root[root]):
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(nodes[root], pa.int64())], names=["node", "root"])


def few_components(edges: DataFrame) -> DataFrame:
    """node, root, as connected_components gives them, found in one task: for edges (a, b: bigint, no nulls) that it can hold."""
    return stored(edges.select("a", "b").coalesce(1).mapInArrow(_settle, "node bigint, root bigint"), "roots")
