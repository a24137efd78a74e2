"""Spark ML forest models whose trees ``forests`` has grown: what large tables are trained by.

Spark ML sends every row through every tree from the root at each level, with a draw per row and tree in memory. Here rows are blocks
of bytes and trees grow within tasks, of the same kind: as many trees, as deep, 32 bins at quantiles, Poisson samples, the same number of
features a node, siblings that predict the same merged. Half the Gini impurity of two classes is the variance of 0 and 1, so
one kind of tree serves both. The result is a model of Spark ML, to be applied, saved and read like any other.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinlift.functions.spread import shared_dir
from joinlift.operators.forests import fit_forests

NODE = ("id int, prediction double, impurity double, impurityStats array<double>, rawCount bigint, gain double, leftChild int, rightChild int, "
        "featureIndex int, cut double")


def features_of_a_node(width: int, classes: bool) -> int:
    """Spark ML's choice for many trees: the root of all features for classes, a third of them for numbers."""
    return math.ceil(math.sqrt(width)) if classes else math.ceil(width / 3.0)


def pruned(node: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The features of a tree's nodes with -1 where two leaves that predict ``value`` alike are merged, as Spark ML does from the leaves up."""
    feature, place = feature.copy(), {n: i for i, n in enumerate(node.tolist())}
    for i in np.argsort(-node, kind="stable").tolist():
        if feature[i] >= 0:
            left, right = place[2 * node[i] + 1], place[2 * node[i] + 2]
            if feature[left] < 0 and feature[right] < 0 and value[left] == value[right]:
                feature[i] = -1
    return feature


def nodes_of(tree: dict, classes: int | None) -> list[tuple]:
    """One row per node (``NODE``), numbered so that children follow their parents; ``classes``: how many there are, none for numbers."""
    node, feature = np.array(tree["node"]), np.array(tree["feature"])
    mean, weight = np.array(tree["value"]), np.array(tree["weight"])
    says = mean if classes is None else (mean > 0.5).astype(float)
    feature = pruned(node, feature, says)
    order = np.argsort(node, kind="stable")
    place = {int(node[i]): int(i) for i in order}
    reached, queue = [], [0]
    while queue:                                         # level by level, so a parent comes before its children
        after = []
        for n in queue:
            reached.append(n)
            if feature[place[n]] >= 0:
                after += [2 * n + 1, 2 * n + 2]
        queue = after
    number = {n: k for k, n in enumerate(reached)}
    out = []
    for k, n in enumerate(reached):
        i = place[n]
        f, w, m = int(feature[i]), float(weight[i]), float(mean[i])
        if classes is None:
            impurity, stats = math.nan, [w, w * m, math.nan]      # sums of squares are not kept, and nothing reads them
        else:
            ones = float(round(w * m))
            impurity, stats = 2 * m * (1 - m), [w - ones, ones][:classes]
        gain = -1.0 if f < 0 else float(tree["gain"][i]) / w * (1 if classes is None else 2)
        out.append((k, float(says[i]), impurity, stats, int(w), gain, number[2 * n + 1] if f >= 0 else -1, number[2 * n + 2] if f >= 0 else -1,
                    f, float(tree["cut"][i])))
    return out


def fit_forest(rows: DataFrame, key: list[str], width: int, estimator):
    """The model of a forest ``estimator`` of Spark ML; ``rows``: stored (key, xs, label), ``xs`` the array of its ``width`` features."""
    spark, trees = rows.sparkSession, estimator.getNumTrees()
    is_class = isinstance(estimator, RandomForestClassifier)
    ends = rows.agg(F.min("label").alias("a"), F.max("label").alias("b")).first()
    # a model of a few rows brings the parameters and the labels; its nodes are replaced
    few = spark.createDataFrame([([float(i)] * width, v) for i, v in enumerate((ends["a"], ends["b"]))], "xs array<double>, label double")
    path = f"{shared_dir(spark)}/forest-{uuid.uuid4().hex}"
    model = estimator.fit(few.select(array_to_vector("xs").alias("features"), "label"))
    model.write().save(path)
    classes = model.numClasses if is_class else None
    n = width if trees == 1 else features_of_a_node(width, is_class)
    grown = fit_forests(rows.select(F.lit(0).alias("part"), *key, "xs", F.col("label").alias("y")), ["part"], [*key, "xs", "y"], trees=trees,
                        depth=estimator.getMaxDepth(), seeds=(estimator.getSeed(),), share=(n - 0.5) / width)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree in batch.to_pylist():
                columns = list(zip(*nodes_of(tree, classes)))
                types = (pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.int64(), pa.float64(), *[pa.int32()] * 3, pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array([tree["tree"]] * len(columns[0]), pa.int32()),
                                                  *(pa.array(c, t) for c, t in zip(columns, types))],
                                                 ["treeID", *(p.split()[0] for p in NODE.split(", "))])
    nodes = grown.select("tree", "node", "feature", "cut", "value", "weight", "gain").mapInArrow(numbered, f"treeID int, {NODE}")
    split = F.struct("featureIndex", F.when(F.col("featureIndex") >= 0, F.array("cut")).otherwise(F.array().cast("array<double>"))
                     .alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"))
    data = F.struct("id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", split.alias("split"))
    nodes.select("treeID", data.alias("nodeData")).coalesce(1).write.mode("overwrite").parquet(f"{path}/data")
    return (RandomForestClassificationModel if is_class else RandomForestRegressionModel).load(path)


def is_forest(estimator) -> bool:
    return isinstance(estimator, RandomForestClassifier | RandomForestRegressor)
