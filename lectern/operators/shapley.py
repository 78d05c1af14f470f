"""Exact attribution for trees: path-dependent Shapley values in polynomial time (ML-25, ML-26).

A tree's value for a set of known features follows its splits on them and averages both branches, by their share of the
training rows, at its splits on others. The tree is the sum of its leaves, and for one leaf that game is a product: each
feature on its path either lets the row through (known) or passes a fixed share (unknown). The Shapley value of a
product game comes from the coefficients of a polynomial of the path's length, so no subsets are listed. Trees are a
model's own, of bounded size; rows are worked on in batches where they lie and give one row per feature.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from lectern.session import run_dir

ROWS = 1024


@dataclass
class Split:
    """A test of one feature: at most ``threshold``, or one of some categories."""

    feature: int
    threshold: float
    categories: tuple[float, ...] | None

    def left(self, x: np.ndarray) -> np.ndarray:
        value = x[:, self.feature]
        return value <= self.threshold if self.categories is None else np.isin(value, self.categories)


@dataclass
class Leaf:
    """What a leaf adds, and per feature on its path: its tests with the side taken, and the share that passes them."""

    value: float
    features: list[int]
    tests: list[list[tuple[int, bool]]]
    shares: np.ndarray


@dataclass
class Tree:
    splits: list[Split]
    leaves: list[Leaf]


def _tree(nodes: dict, weight: float, value: Callable, size: Callable) -> Tree:
    """Leaves of one tree from its node rows; sizes are the training rows that reached a node."""
    splits: list[Split] = []
    leaves: list[Leaf] = []
    path: list[tuple[int, bool, float]] = []

    def walk(at: int) -> None:
        node = nodes[at]
        if node["leftChild"] < 0:
            names = list(dict.fromkeys(splits[s].feature for s, _, _ in path))
            tests = [[(s, side) for s, side, _ in path if splits[s].feature == f] for f in names]
            shares = [math.prod(p for s, _, p in path if splits[s].feature == f) for f in names]
            leaves.append(Leaf(weight * value(node), names, tests, np.array(shares)))
            return
        test, own = node["split"], size(node)
        listed = tuple(test["leftCategoriesOrThreshold"])
        known = test["numCategories"] < 0
        splits.append(Split(test["featureIndex"], listed[0] if known else math.nan, None if known else listed))
        number = len(splits) - 1
        for child, side in ((node["leftChild"], True), (node["rightChild"], False)):
            path.append((number, side, size(nodes[child]) / own))
            walk(child)
            path.pop()

    walk(0)
    return Tree(splits, leaves)


def trees_of(model: Model, spark, class_index: int = 1) -> list[Tree]:
    """The trees behind a fitted model; their sum is its prediction, its probability of a class or, for boosted
    classifiers, its margin. Raises ``TypeError`` for a model without trees."""
    kind = type(model).__name__
    single = kind.startswith("DecisionTree")
    if not single and not kind.startswith(("RandomForest", "GBT")):
        raise TypeError(f"{kind} has no trees")
    path = run_dir(spark, "trees")
    model.save(path)
    data = spark.read.parquet(f"{path}/data")
    data = data.select(F.lit(0).alias("tree"), F.struct(*data.columns).alias("node")) if single else data.select(
        F.col("treeID").alias("tree"), F.col("nodeData").alias("node")
    )
    by_tree: dict[int, dict] = {}
    for row in data.collect():
        by_tree.setdefault(row["tree"], {})[row["node"]["id"]] = row["node"]
    votes = kind.endswith("ClassificationModel") and not kind.startswith("GBT")
    weights = model.treeWeights if kind.startswith("GBT") else [1 / len(by_tree)] * len(by_tree)

    def size(node) -> float:
        stats = node["impurityStats"]
        return float(sum(stats)) if votes else float(stats[0])

    def value(node) -> float:
        if not votes:
            return node["prediction"]
        stats = node["impurityStats"]
        return stats[class_index] / size(node) if class_index < len(stats) else 0.0

    return [_tree(by_tree[i], weights[i], value, size) for i in sorted(by_tree)]


def baseline(trees: list[Tree]) -> float:
    """The value with no feature known."""
    return float(sum(leaf.value * leaf.shares.prod() for tree in trees for leaf in tree.leaves))


def _product_values(passes: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Shapley values of the game that multiplies, over the features, ``passes`` (known) or ``shares`` (unknown)."""
    rows, size = passes.shape
    weights = np.array([math.factorial(k) * math.factorial(size - 1 - k) / math.factorial(size) for k in range(size)])
    out = np.empty((rows, size))
    for i in range(size):
        # By the number of known features among the others.
        known = np.zeros((rows, size))
        known[:, 0] = 1.0
        for j in range(size):
            if j != i:
                known[:, 1:] = known[:, 1:] * shares[j] + known[:, :-1] * passes[:, j, None]
                known[:, 0] *= shares[j]
        out[:, i] = (passes[:, i] - shares[i]) * (known @ weights)
    return out


def contributions(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    """Contribution of every feature (columns) to every row."""
    out = np.zeros(x.shape)
    for tree in trees:
        left = [split.left(x) for split in tree.splits]
        for leaf in tree.leaves:
            if not leaf.features:
                continue
            passes = np.ones((len(x), len(leaf.features)), bool)
            for j, tests in enumerate(leaf.tests):
                for number, side in tests:
                    passes[:, j] &= left[number] == side
            kinds, kind = np.unique(passes, axis=0, return_inverse=True)
            values = leaf.value * _product_values(kinds.astype(float), leaf.shares)
            out[:, leaf.features] += values[kind.ravel()]
    return out


def tree_shapley(
    model: Model, rows: DataFrame, key: str, names: list[str], class_index: int = 1, vec: str = "features"
) -> DataFrame:
    """Exact signed contribution of every feature to every row: ``key, feature, contribution``.

    Contributions of a row and ``baseline`` add up to the model's output for it. Repeated rows are explained each.
    """
    spark = rows.sparkSession
    trees = trees_of(model, spark, class_index)
    schema = t.StructType([rows.schema[key], t.StructField("shares", t.ArrayType(t.DoubleType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                x = np.asarray(part.column(1).flatten()).reshape(part.num_rows, -1)
                shares = contributions(trees, x)
                offsets = pa.array(np.arange(0, shares.size + 1, x.shape[1], dtype=np.int32))
                listed = pa.ListArray.from_arrays(offsets, pa.array(shares.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), listed], [key, "shares"])

    explained = rows.select(key, vector_to_array(vec).alias("x")).mapInArrow(run, schema)
    pairs = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("feature"), F.col("shares").alias("contribution"))
    return explained.select(key, F.explode(pairs).alias("p")).select(key, "p.feature", "p.contribution")
