"""Distributed connected components: local union-find per partition, then star contraction.

Each partition first reduces its edges to a spanning forest with union-find (memory: the nodes of
one shuffle partition). Alternating large-star and small-star rounds (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014) then link the forests; a round is two aggregations and
two joins on the node, whose hot keys adaptive execution can split, since one side has one row per
node. Every round is staged in the shared folder. No component meets in one task or the driver.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import Scratch

EDGE = "u long, v long"


class UnionFind:
    """Union-find over hashable nodes; a root is the least node of its set."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root and up != x:
            parent[x] = root
            x = up
        return root

    def union(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.parent[b] = a
        return True


def _forest(batches):
    sets = UnionFind()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sets.union(a, b)
    nodes = list(sets.parent)
    roots = [sets.find(x) for x in nodes]
    keep = [(x, r) for x, r in zip(nodes, roots) if x != r]
    yield pa.RecordBatch.from_arrays(
        [pa.array([x for x, _ in keep], pa.int64()), pa.array([r for _, r in keep], pa.int64())], names=["u", "v"])


def _is_star_forest(edges: DataFrame) -> bool:
    """True if every node points to one other node at most, and nodes pointed at point nowhere:
    the fixpoint of the star rounds, where each node's target is its component."""
    ends = (edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into"))
            .unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into"))))
    return ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or out = 1 and into = 1").isEmpty()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, component)`` for every node of the two-column bigint ``edges``.

    ``component`` is the least node reachable. Self-loops and nulls are ignored; an empty table
    gives an empty result; repeated and reversed edges make no difference.
    """
    a, b = edges.columns[:2]
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    now = scratch.stage(pairs.mapInArrow(_forest, EDGE))
    while not _is_star_forest(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u")
                 .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                         F.col("m").alias("v"))
                 .where("u <> v").distinct())
        after = scratch.stage(small)
        scratch.drop(now)
        now = after
    roots = now.select("v").distinct()
    return (now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("component"))))
