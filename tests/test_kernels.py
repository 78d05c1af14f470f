"""The kernel map and its linear machine."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from lectern.operators import kernels as K
from lectern.operators import models as M


def points(spark, x, label, partitions=4):
    rows = [(i, v.tolist(), float(c)) for i, (v, c) in enumerate(zip(x, label))]
    df = spark.createDataFrame(rows, "id long, x array<double>, label double").repartition(partitions)
    return df.withColumn("features", array_to_vector("x"))


def test_mapped_products_are_the_kernel_at_landmarks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    df = points(spark, x, np.zeros(300))
    found = K.fit_map(df, "id", gamma=0.4, count=30)
    assert len(found.landmarks) == 30
    drawn = df.orderBy(__import__("lectern.operators.features", fromlist=["draw"]).draw("id", K.SEED)).limit(30).collect()
    assert {tuple(r["x"]) for r in drawn} == {tuple(v) for v in found.landmarks}
    rows = found.transform(df).select("id", vector_to_array(K.MAPPED).alias("m")).orderBy("id").collect()
    got = np.array([r["m"] for r in rows]) @ found.apply(found.landmarks).T
    want = np.exp(-0.4 * ((x[:, None] - found.landmarks[None]) ** 2).sum(2))
    np.testing.assert_allclose(got, want, atol=1e-6)


def test_default_width(spark):
    x = np.random.default_rng(2).normal(size=(200, 5)) * 3 + 1
    assert K.default_gamma(points(spark, x, np.zeros(200))) == pytest.approx(1 / (5 * x.var()))
    assert K.default_gamma(points(spark, np.ones((5, 2)), np.zeros(5))) == 1.0


def test_the_fit_minimises_its_loss(spark, monkeypatch):
    """Against plain gradient descent on the same rounded hinge, with several machines and many partial sums."""
    monkeypatch.setattr(K, "FANIN", 2)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 2))
    label = (x[:, 0] > 0).astype(int) + (x[:, 1] > 0.5)
    df = points(spark, x, label, 6)
    mapping = K.fit_map(df, "id", gamma=0.5, count=10)
    rows = df.select("x", "label")
    got = K._newton(rows, mapping, 3, 0.01, 150)
    phi = np.concatenate((mapping.apply(x), np.ones((150, 1))), axis=1)
    width = K.ROUND[-1]

    def value(w, y):
        return K._loss(y * (phi @ w), width).mean() + 0.005 * (w[:-1] ** 2).sum()

    for c in range(3):
        y = np.where(label == c, 1.0, -1.0)
        best = got[c].copy()
        for _ in range(3000):
            margin = y * (phi @ best)
            slope = y * np.clip((margin - 1 - width) / (2 * width), -1, 0)
            best -= 0.05 * (slope @ phi / 150 + 0.01 * np.append(best[:-1], 0))
        assert value(got[c], y) <= value(best, y) + 1e-3


def test_rings_are_told_apart(spark):
    rng = np.random.default_rng(4)
    angle, ring = rng.random(600) * 6.3, rng.integers(0, 3, 600)
    radius = 1 + 2 * ring + rng.random(600) * 0.4
    rows = [
        (i, float(r * np.cos(a)), float(r * np.sin(a)), "abc"[c], "ab"[min(c, 1)])
        for i, (a, r, c) in enumerate(zip(angle, radius, ring))
    ]
    df = spark.createDataFrame(rows, "id long, x double, y double, three string, two string").repartition(4)
    for target in ("two", "three"):
        run = M.train_model(df, ["x", "y"], target, "Support Vector Classifier (SVC)", "id")
        scores = M.run_scores(run).first()
        assert scores["train_score"] > 0.97 and scores["test_score"] > 0.95
        assert M.importances(spark, run.model, run.preparation.names).count() == 0
    shares = M.attribution(run, run.test.limit(3), "id", 2)
    assert shares.count() == 6


def test_empty_batches(spark):
    df = points(spark, np.random.default_rng(5).normal(size=(20, 2)), np.arange(20) % 2, 12)
    model = K.fit_classifier(df, "id", 2)
    assert model.transform(df.filter("id < 0")).count() == 0
    assert model.transform(df.filter(F.col("id") < 3)).count() == 3
    with pytest.raises(ValueError):
        K.fit_map(df.filter("id < 0"), "id")
