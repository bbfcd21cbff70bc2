"""Embedding near-duplicates: random-hyperplane sign hashing, exact cosine, connected components.

Each distinct vector gets one key per table, the signs of its products with random hyperplanes.
Vectors at an angle t agree on a sign with probability 1 - t / pi, so with ``bits`` signs per key a
pair at the threshold meets in some of the tables with at least the probability ``RECALL``, which
sets their number; bits grow with the logarithm of the number of vectors, so that a bucket holds
about ``BUCKET_ROWS`` whatever the size of the table.

Within a bucket cosines are exact, in double precision, one matrix product per block. A pair counts
only in the first table in which it meets, so link counts need no list of pairs: a bucket returns a
row per linked vector with its number of links and its root in the bucket's spanning forest. A
bucket of more than ``BLOCK_ROWS`` is cut into blocks, and each pair of blocks is a group of its own.
Copies are one class throughout, with their number.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.llm.common import Scratch, shuffle_partitions, slices
from keelson.llm.components import UnionFind, connected_components

THRESHOLD, RECALL = 0.9, 0.98
#: Vectors of a bucket on average, and of a block of a larger one.
BUCKET_ROWS, BLOCK_ROWS, SEED = 256, 2_048, 17


def tables_for(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits per key and number of tables for ``n`` distinct vectors."""
    bits = max(4, min(32, math.ceil(math.log2(max(1, n) / BUCKET_ROWS)))) if n > BUCKET_ROWS else 4
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def _unit(vectors: list) -> np.ndarray:
    m = np.stack([np.asarray(v, float) for v in vectors])
    m = m / np.abs(m).max(axis=1, keepdims=True)  # no overflow or underflow of the squares
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _keys(bits: int, tables: int):
    def run(batches):
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, 1024):
                vectors = part.column("vector").to_pylist()
                keys = np.zeros((len(vectors), tables), np.int64)
                dims = np.array([len(v) for v in vectors])
                for d in np.unique(dims).tolist():
                    if d not in planes:
                        planes[d] = np.random.default_rng((SEED, d)).normal(size=(d, tables * bits))
                    at = np.flatnonzero(dims == d)
                    signs = (_unit([vectors[i] for i in at]) @ planes[d] >= 0).reshape(len(at), tables, bits)
                    keys[at] = (signs * weights).sum(axis=2) | d << 32
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("node", "members", "vector")), pa.array(list(keys), pa.list_(pa.int64()))],
                    names=["node", "members", "vector", "keys"])

    return run


def _linked(rows: list[tuple], table: int, threshold: float, same_block: bool) -> list[tuple]:
    """Links of a group as ``(node, links, root)``; rows are ``(node, members, side, keys, vector)``."""
    nodes, members = [r[0] for r in rows], np.array([r[1] for r in rows])
    keys, unit = np.array([r[3] for r in rows]), _unit([r[4] for r in rows])
    side = np.array([r[2] for r in rows])
    left = np.arange(len(rows)) if same_block else np.flatnonzero(side == 0)
    right = left if same_block else np.flatnonzero(side == 1)
    links, sets = np.zeros(len(rows), np.int64), UnionFind()
    for at in range(0, len(left), 512):
        a = left[at:at + 512]
        i, j = np.nonzero(unit[a] @ unit[right].T >= threshold)
        i, j = a[i], right[j]
        fresh = (i < j if same_block else np.ones(len(i), bool)) & ~(keys[i][:, :table] == keys[j][:, :table]).any(axis=1)
        i, j = i[fresh], j[fresh]
        np.add.at(links, i, members[j])
        np.add.at(links, j, members[i])
        for x, y in zip(i.tolist(), j.tolist()):
            sets.union(x, y)
    return [(nodes[x], int(links[x]), nodes[sets.find(x)]) for x in np.flatnonzero(links).tolist()]


def _groups(threshold: float):
    def emit(rows, group):
        found = _linked(rows, group[0], threshold, group[2] == group[3])
        columns = list(zip(*found)) if found else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["node", "links", "root"])

    def run(batches):
        last, rows = None, []
        for batch in batches:
            for part in slices(batch, 1024):
                names = ("table", "key", "i", "j", "node", "members", "side")
                columns = [part.column(c).to_pylist() for c in names]
                vectors = (part.column(c).to_numpy(zero_copy_only=False) for c in ("keys", "vector"))
                for *group, node, members, side, keys, vector in zip(*columns, *vectors):
                    if group != last:
                        if len(rows) > 1:
                            yield emit(rows, last)
                        last, rows = group, []
                    rows.append((node, members, side, keys, vector))
        if len(rows) > 1:
            yield emit(rows, last)

    return run


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD,
                    recall: float = RECALL, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``vectors``.

    ``n_links`` counts the other rows linked directly, copies included; ``component_id`` is the
    least id reachable. No pair below ``threshold`` is linked; each pair from it on is found with
    probability ``recall`` or more, and copies always. Vectors that are null, empty, zero or hold
    null or non-finite components, and vectors of different lengths, link with nothing; such a row
    is its own component. Repeated ids are rows of their own; a null id names no component.
    Distinct vectors are told apart by a 64-bit hash once grouped. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch, n_parts = Scratch(spark, "embeddings"), shuffle_partitions(spark)
    v = F.col(vector)
    good = (v.isNotNull() & (F.size(v) > 0) & F.exists(v, lambda x: x != 0)
            & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.when(good, v).alias("vector"))
    kind = rows.schema["vector"].dataType
    rows = rows.withColumn("node", F.when(F.col("vector").isNotNull(), F.xxhash64("vector")))
    classes = rows.where("node is not null").groupBy("vector").agg(F.first("node").alias("node"), F.count("*").alias("members"))
    classes = scratch.stage(classes.select("node", "members", "vector"))
    bits, tables = tables_for(classes.count(), threshold, recall)
    hashed = scratch.stage(classes.mapInArrow(_keys(bits, tables), T.StructType(
        [*classes.schema.fields, T.StructField("keys", T.ArrayType(T.LongType()))])))

    sizes = (hashed.select(F.posexplode("keys").alias("table", "key")).groupBy("table", "key").agg(F.count("*").alias("rows"))
             .where("rows > 1").select("table", "key", F.expr(f"int((rows - 1) div {int(block_rows)}) + 1").alias("blocks")))
    dealt = (hashed.select("node", "members", "vector", "keys", F.posexplode("keys").alias("table", "key"))
             .join(scratch.stage(sizes), ["table", "key"])
             .withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("table", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                     (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "members", "keys", "vector"))
    found = (dealt.repartition(n_parts, "table", "key", "i", "j").sortWithinPartitions("table", "key", "i", "j")
             .mapInArrow(_groups(threshold), "node long, links long, root long"))
    found = scratch.stage(found)

    parts = connected_components(found.select("node", "root"), scratch)
    degrees = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = (classes.select("node", "members").join(degrees, "node", "left").join(parts, "node", "left")
             .select("node", (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                     F.coalesce("component", "node").alias("component")))
    named = scratch.stage(named)
    firsts = (rows.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("first_id")).join(named, "node")
              .groupBy("component").agg(F.min("first_id").alias("least")))
    per_node = scratch.stage(named.join(firsts, "component").select("node", "n_links", "least"))
    own = F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")
    out = (rows.select("vec_id", "node").join(per_node, "node", "left")
           .select("vec_id", own, F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("least")).alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
