"""L2 on forests: parameter sets that differ only in ``maxDepth`` share one fit.

MLlib grows a forest level by level from the root. With the same rows, seed and other parameters the
forest of a smaller depth is therefore the upper part of the deeper one, as long as the nodes of every
level it has are split in one pass (``maxMemoryInMB`` holds them). The deepest forest is fitted, and the
others are cut from its saved node table. Where a level may need several passes, nodes draw their features
in another order, so every set is fitted by itself.

Sums over labels and weights are the same to the bit where labels are whole numbers; otherwise the means of
the lowest nodes may differ in the last place.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.ml.feature import VectorIndexer
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.session import side_path

#: Numbers kept per bin, at least as many as MLlib's variance sums.
_SUMS = 4


def depth_key(stage, params: dict):
    """What parameter sets with one forest have in common; None for stages that cannot share one."""
    if type(stage) is not RandomForestRegressor:
        return None
    return stage.uid, tuple(sorted((p.parent, p.name, repr(v)) for p, v in params.items() if p != stage.maxDepth))


def bin_bounds(frame: DataFrame, stage: RandomForestRegressor) -> list[int]:
    """For every feature the most bins it can have: its number of distinct values, at most ``maxBins``."""
    name, most = stage.getFeaturesCol(), stage.getMaxBins()
    model = VectorIndexer(inputCol=name, outputCol=f"_kl_{name}", maxCategories=most).fit(frame)
    bins = [most] * model.numFeatures
    for feature, values in model.categoryMaps.items():
        bins[feature] = max(1, len(values))
    attributes = frame.schema[name].metadata.get("ml_attr", {}).get("attrs", {})
    for attribute in [*attributes.get("nominal", []), *attributes.get("binary", [])]:  # bins by arity, not by values seen
        bins[attribute["idx"]] = most
    return bins


def _features_per_node(stage: RandomForestRegressor, features: int) -> int:
    name = stage.getFeatureSubsetStrategy().lower()
    chosen = {"onethird": features / 3, "sqrt": math.sqrt(features), "log2": math.log2(max(2, features))}.get(name, features)
    return min(features, math.ceil(chosen) + 1)


def levels_in_one_pass(stage: RandomForestRegressor, depth: int, bins: Sequence[int]) -> bool:
    """Whether every level that a forest of ``depth`` splits surely fits the memory of one pass."""
    node = 8 * _SUMS * sum(sorted(bins, reverse=True)[:_features_per_node(stage, len(bins))])
    return stage.getNumTrees() * 2 ** max(0, depth - 1) * node <= stage.getMaxMemoryInMB() * 2 ** 20


def _cut(tree: list[tuple[int, float, int, int]], depth: int) -> list[tuple[int, int, int, int]]:
    """The upper part of one tree as ``(id, new id, new left, new right)``, children -1 in leaves. Nodes
    come in preorder. Like MLlib, sibling leaves of one prediction become their parent."""
    level, leaf, prediction = {0: 0}, {}, {}
    for node, value, left, right in tree:
        prediction[node] = value
        if left >= 0:
            level[left] = level[right] = level[node] + 1
    kept = [(node, left, right) for node, _, left, right in tree if level[node] <= depth]
    dropped = set()
    for node, left, right in reversed(kept):
        leaf[node] = left < 0 or level[node] == depth
        if not leaf[node] and leaf[left] and leaf[right] and prediction[left] == prediction[right]:
            leaf[node] = True
            dropped |= {left, right}
    kept = [(node, left, right) for node, left, right in kept if node not in dropped]
    new = {node: i for i, (node, _, _) in enumerate(kept)}
    return [(node, new[node], *((-1, -1) if leaf[node] else (new[left], new[right]))) for node, left, right in kept]


def cut_models(model: RandomForestRegressionModel, frame: DataFrame, depths: Sequence[int]) -> list[RandomForestRegressionModel]:
    """The models of smaller depths than ``model`` has. They are as large as a model, so the shape of the
    trees passes the driver as the models do."""
    spark = frame.sparkSession
    path = side_path(spark, "forest")
    model.save(f"{path}/full")
    meta = json.loads(spark.read.text(f"{path}/full/metadata").first()[0])
    trees_meta = spark.read.parquet(f"{path}/full/treesMetadata")
    trees_rows = trees_meta.collect()
    nodes = spark.read.parquet(f"{path}/full/data")
    node = nodes.schema["nodeData"].dataType
    shape = nodes.select("treeID", "nodeData.id", "nodeData.prediction", "nodeData.leftChild", "nodeData.rightChild").toArrow().to_pylist()
    trees: dict[int, list] = {}
    for row in sorted(shape, key=lambda r: (r["treeID"], r["id"])):
        trees.setdefault(row["treeID"], []).append((row["id"], row["prediction"], row["leftChild"], row["rightChild"]))
    out = []
    for depth in depths:
        own = f"{path}/{depth}"
        upper = [(t, *n) for t, tree in trees.items() for n in _cut(tree, depth)]
        names = ["treeID", "id", "new", "left", "right"]
        upper = spark.createDataFrame(pa.table({c: pa.array(v, pa.int32()) for c, v in zip(names, zip(*upper))}))
        inner, old = F.col("left") >= 0, F.col("nodeData")
        no_split = F.struct(F.lit(-1).alias("featureIndex"), F.array().cast("array<double>").alias("leftCategoriesOrThreshold"),
                            F.lit(-1).alias("numCategories"))
        values = {"id": F.col("new"), "leftChild": F.col("left"), "rightChild": F.col("right"),
                  "gain": F.when(inner, old["gain"]).otherwise(F.lit(-1.0)), "split": F.when(inner, old["split"]).otherwise(no_split)}
        cut = nodes.withColumn("id", old["id"]).join(upper, ["treeID", "id"])
        cut = cut.select("treeID", F.struct(*[values.get(f.name, old[f.name]).cast(f.dataType).alias(f.name) for f in node.fields]).alias("nodeData"))
        cut.coalesce(1).write.parquet(f"{own}/data")
        spark.createDataFrame([(json.dumps(_with_depth(meta, depth)),)], "value string").coalesce(1).write.text(f"{own}/metadata")
        rows = [(i, json.dumps(_with_depth(json.loads(text), depth)), weight) for i, text, weight in trees_rows]
        spark.createDataFrame(rows, trees_meta.schema).coalesce(1).write.parquet(f"{own}/treesMetadata")
        out.append(RandomForestRegressionModel.load(own))
    return out


def _with_depth(meta: dict, depth: int) -> dict:
    return {**meta, "paramMap": {**meta["paramMap"], "maxDepth": depth}}
