"""The forest for many rows against the library's, and its sums against plain ones."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from lectern.operators import forest as T
from lectern.operators import models as M


@pytest.fixture(scope="module")
def train(spark):
    """Rows with few and many values per feature, some rows twice, and a label that rests on three features."""
    rows = spark.range(1500).withColumn("i", F.when(F.col("id") % 50 == 0, 7).otherwise(F.col("id")))
    x = [F.pmod(F.xxhash64("i", F.lit(f)), F.lit(n)) / F.lit(d) for f, (n, d) in enumerate([(2, 1), (5, 2), (900, 7), (40, 3), (1000, 9)])]
    made = rows.select(F.array(*[c.cast("double") for c in x]).alias("x"), F.pmod(F.xxhash64("i"), F.lit(100)).alias("noise"))
    label = F.col("x")[0] * 30 + F.col("x")[2] * F.col("x")[1] + F.col("noise") / 10 - F.col("x")[3] * F.col("x")[3]
    return made.repartition(4).select(array_to_vector("x").alias("features"), label.alias("label")).cache()


def test_without_draws_of_rows_the_forest_is_the_librarys(train):
    library = RandomForestRegressor(numTrees=7, maxDepth=5, seed=42, bootstrap=False)
    want, got = library.fit(train), T.fit_forest(library, train, train.count())
    assert np.allclose(got.featureImportances.toArray(), want.featureImportances.toArray(), rtol=1e-9)
    assert [t.numNodes for t in got.trees] == [t.numNodes for t in want.trees]
    a, b = ([r["prediction"] for r in m.transform(train).select("prediction").collect()] for m in (got, want))
    assert np.allclose(a, b, rtol=1e-9)


def test_a_drawn_forest_is_like_the_librarys(train):
    library = RandomForestRegressor(numTrees=100, maxDepth=6, seed=42)
    want, got = library.fit(train), T.fit_forest(library, train, train.count())
    assert np.abs(got.featureImportances.toArray() - want.featureImportances.toArray()).max() < 0.03
    errors = [m.transform(train).agg(F.avg(F.pow(F.col("prediction") - F.col("label"), 2))).first()[0] for m in (got, want)]
    assert errors[0] < 1.1 * errors[1] and got.getNumTrees == 100 and got.numFeatures == 5


@pytest.mark.parametrize("reach", [400, 1 << 40])
def test_sums_of_combinations_are_those_of_their_rows(monkeypatch, reach):
    monkeypatch.setattr(T, "CHUNK_ROWS", 64)
    monkeypatch.setattr(T, "PIECE_CODES", 50)
    rng = np.random.default_rng(1)
    ids, codes, y = rng.integers(0, 1 << 40, 3000), rng.integers(0, 300, 3000), rng.normal(size=3000)
    times = T.weights(ids, 6, 42)
    seen = []
    for present, sums in T._weighed(ids, codes, y, reach, 6, 42, True):
        assert len(present) <= 50
        for i, code in enumerate(present):
            own = codes == code
            assert np.allclose(sums[:, :, i], [(times[:, own] * y[own] ** p).sum(axis=1) for p in range(3)])
            seen.append(code)
    assert sorted(seen) == sorted(set(codes))


def test_rows_are_drawn_as_poisson_numbers():
    times = T.weights(np.arange(200_000), 9, 42)
    assert times.shape == (9, 200_000) and np.abs(times.mean(axis=1) - 1).max() < 0.01
    assert np.abs(times.var(axis=1) - 1).max() < 0.02
    assert np.abs(np.corrcoef(times) - np.eye(9)).max() < 0.01
    assert (T.weights(np.arange(100, 200), 9, 42) == times[:, 100:200]).all()


def test_the_library_does_not_visit_the_rows_of_a_large_table(spark, monkeypatch):
    monkeypatch.setattr(M, "FOREST_ROWS", 500, raising=False)
    monkeypatch.setattr(T, "SPLIT_ROWS", 300)
    visited, fit = [], RandomForestRegressor._fit

    def spy(self, dataset):
        visited.append(dataset.count())
        return fit(self, dataset)

    monkeypatch.setattr(RandomForestRegressor, "_fit", spy)
    rows = spark.range(1000).selectExpr("id", "cast(id % 17 AS double) AS a", "cast(id % 4 AS string) AS b", "id % 17 * 3.0 + id % 4 AS y")
    run = M.train_model(rows, ["a", "b"], "y", "Random Forest Regressor", "id")
    assert visited == [300]
    found = M.importances(spark, run.model, run.preparation.names).collect()
    assert found[0]["feature"] == "a" and abs(sum(r["importance"] for r in found) - 1) < 0.001
    assert M.regression_metrics(run.test).first()["r2"] > 0.8
