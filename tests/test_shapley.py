"""Path-dependent Shapley values against all subsets of features."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lectern.operators import models as M
from lectern.operators import shapley as S


def value(nodes, known, x, leaf_value, size, at=0):
    node = nodes[at]
    if node["leftChild"] < 0:
        return leaf_value(node)
    split, sides = node["split"], (node["leftChild"], node["rightChild"])
    if split["featureIndex"] in known:
        listed = split["leftCategoriesOrThreshold"]
        v = x[split["featureIndex"]]
        left = v in listed if split["numCategories"] >= 0 else v <= listed[0]
        return value(nodes, known, x, leaf_value, size, sides[0 if left else 1])
    return sum(size(nodes[c]) / size(node) * value(nodes, known, x, leaf_value, size, c) for c in sides)


def all_subsets(forest, x, n):
    """forest: (weight, nodes, leaf_value, size) of each tree."""

    def game(known):
        return sum(w * value(nodes, known, x, leaf, size) for w, nodes, leaf, size in forest)

    out = np.zeros(n)
    for i in range(n):
        others = [j for j in range(n) if j != i]
        for k in range(n):
            for some in itertools.combinations(others, k):
                weight = math.factorial(k) * math.factorial(n - 1 - k) / math.factorial(n)
                out[i] += weight * (game({*some, i}) - game(set(some)))
    return out, game(set())


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(400, 6)), 2)
    c = rng.integers(0, 3, 400)
    y = 3 * x[:, 0] * (x[:, 1] > 0) + x[:, 2] + 2 * (c == 1) * x[:, 3] + rng.normal(size=400) * 0.1
    rows = [(i, *map(float, v), "abc"[k], float(t), "hi" if t > 0.3 else "lo") for i, (v, k, t) in enumerate(zip(x, c, y))]
    names = ", ".join(f"x{j} double" for j in range(6))
    return spark.createDataFrame(rows, f"id long, {names}, c string, y double, side string").repartition(3)


def nodes_of(model, spark, tmp_path):
    path = str(tmp_path / "model")
    model.save(path)
    data = spark.read.parquet(path + "/data")
    out = {}
    for r in data.collect():
        tree, node = (r["treeID"], r["nodeData"]) if "treeID" in data.columns else (0, r)
        out.setdefault(tree, {})[node["id"]] = node
    return [out[t] for t in sorted(out)]


NAMES = [
    "Decision Tree Regressor", "Random Forest Regressor", "Gradient Boosting Regressor", "Decision Tree Classifier",
    "Random Forest Classifier", "Gradient Boosting Classifier",
]


@pytest.mark.parametrize("name", NAMES)
def test_against_all_subsets(spark, table, name, tmp_path, monkeypatch):
    real = M.estimator

    def fewer(*args):
        found = real(*args)
        if found.hasParam("numTrees"):
            found.setNumTrees(4)
        if found.hasParam("maxIter") and "GBT" in type(found).__name__:
            found.setMaxIter(5)
        return found

    monkeypatch.setattr(M, "estimator", fewer)
    features = ["x0", "x1", "x2", "x3", "c"]  # seven columns once encoded
    run = M.train_model(table, features, "y" if "Regressor" in name else "side", name, "id")
    shares = M.attribution(run, run.test, "id")
    assert shares.columns == ["id", "feature", "contribution"]
    names = run.preparation.names
    rows = run.test.select("id", vector_to_array("features").alias("x")).collect()
    got = {(r["id"], r["feature"]): r["contribution"] for r in shares.collect()}
    assert len(got) == len(rows) * len(names)
    votes = name in ("Decision Tree Classifier", "Random Forest Classifier")
    trees = nodes_of(run.model, spark, tmp_path)
    weights = run.model.treeWeights if name.startswith("Gradient") else [1 / len(trees)] * len(trees)
    size = (lambda n: sum(n["impurityStats"])) if votes else (lambda n: n["impurityStats"][0])
    leaf = (lambda n: n["impurityStats"][1] / sum(n["impurityStats"])) if votes else (lambda n: n["prediction"])
    forest = [(w, t, leaf, size) for w, t in zip(weights, trees)]
    for r in rows[:6]:
        want, base = all_subsets(forest, r["x"], len(names))
        np.testing.assert_allclose([got[r["id"], n] for n in names], want, atol=1e-9)
    assert S.baseline(S.trees_of(run.model, spark)) == pytest.approx(base)


def test_sums_to_the_prediction_in_a_full_forest(spark, table):
    run = M.train_model(table, [f"x{j}" for j in range(6)], "y", "Random Forest Regressor", "id")
    base = S.baseline(S.trees_of(run.model, spark))
    sums = M.attribution(run, run.test, "id").groupBy("id").agg(F.sum("contribution").alias("s"))
    off = run.test.join(sums, "id").filter(F.abs(F.col("predicted") - F.col("s") - base) > 1e-6)
    assert off.count() == 0


def test_stump_without_splits_and_other_models(spark):
    df = VectorAssembler(inputCols=["a"], outputCol="features").transform(spark.range(20).selectExpr("id", "double(id) a", "1.0 label"))
    from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression

    model = DecisionTreeRegressor().fit(df)
    assert {r["contribution"] for r in S.tree_shapley(model, df, "id", ["a"]).collect()} == {0.0}
    with pytest.raises(TypeError):
        S.trees_of(LinearRegression(regParam=0.1).fit(df), spark)
