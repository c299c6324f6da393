"""Forests of smaller depth out of one deep fit."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lagline.session import shared_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package


def can_cut(classifier: RandomForestClassifier, model: RandomForestClassificationModel, depth: int) -> bool:
    """Whether a fit of ``depth`` would give the trees of the deeper ``model`` without what lies below.

    A fit draws the features of node after node from one random stream. As long as all nodes of a level are split at once, that is whole
    levels from the root down, both fits draw the same. A level is split at once when its counts fit into ``maxMemoryInMB``.
    """
    counts = 8 * (model.numClasses + 1) * classifier.getMaxBins() * model.numFeatures
    return classifier.getNumTrees() * 2 ** max(depth - 1, 0) * counts <= classifier.getMaxMemoryInMB() << 20


def _cut_tree(depth: int):
    def run(nodes: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("id")  # numbered from 0, a node before its left part and that before its right part
        left, right, said, gain = (nodes[c].to_numpy() for c in ("leftChild", "rightChild", "prediction", "gain"))
        levels = [np.zeros(1, dtype=np.int64)]
        while len(levels) <= depth and levels[-1].size:
            inner = levels[-1][left[levels[-1]] >= 0]
            levels.append(np.concatenate([left[inner], right[inner]]))
        keep, leaf = np.zeros(len(left), dtype=bool), left < 0
        keep[np.concatenate(levels)] = True
        if len(levels) > depth:
            leaf[levels[depth]] = True
        # As a fit does: two leaves that say the same become one with their parent.
        for level in reversed(levels[:-1]):
            inner = level[~leaf[level]]
            alike = inner[leaf[left[inner]] & leaf[right[inner]] & (said[left[inner]] == said[right[inner]])]
            leaf[alike] = True
            keep[left[alike]] = keep[right[alike]] = False
        number = np.cumsum(keep, dtype=np.int32) - 1
        new = {"id": number, "gain": np.where(leaf, -1.0, gain), **{c: np.where(leaf, -1, number[at]) for c, at in (("leftChild", left), ("rightChild", right))}}
        for name, values in new.items():
            at = nodes.schema.get_field_index(name)
            nodes = nodes.set_column(at, nodes.schema.field(at), pa.array(values, type=nodes.schema.field(at).type))
        return nodes.filter(pa.array(keep))

    return run


def cut_forest(spark: SparkSession, model: RandomForestClassificationModel, depths: Sequence[int]) -> list[RandomForestClassificationModel]:
    """``model`` cut at each of ``depths``, none deeper than its own: where ``can_cut`` holds, the forests that fits of these depths give.

    The nodes are those of the stored model; a task cuts one tree.
    """
    whole = shared_path(spark, "forest")
    model.write().save(whole)
    nodes = spark.read.parquet(f"{whole}/data").select("treeID", "nodeData.*")
    no_split = F.struct(F.lit(-1).alias("featureIndex"), F.array().cast("array<double>").alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"))
    result = []
    for depth in depths:
        path = shared_path(spark, f"forest-{depth}")
        cut = nodes.groupBy("treeID").applyInArrow(_cut_tree(depth), nodes.schema)
        cut = cut.withColumn("split", F.when(F.col("leftChild") < 0, no_split).otherwise(F.col("split")))
        cut.select("treeID", F.struct(*nodes.columns[1:]).alias("nodeData")).write.parquet(f"{path}/data")
        spark.read.text(f"{whole}/metadata").coalesce(1).write.text(f"{path}/metadata")
        spark.read.parquet(f"{whole}/treesMetadata").write.parquet(f"{path}/treesMetadata")
        result.append(RandomForestClassificationModel.load(path)._set(maxDepth=depth))
    return result
