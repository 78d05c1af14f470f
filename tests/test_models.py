import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lectern.operators import features as X
from lectern.operators import models as M


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(600):
        n1, n2, c = int(rng.integers(0, 50)), float(rng.normal()), "abc"[int(rng.integers(0, 3))]
        y = 3.0 * n1 - 20.0 * n2 + {"a": 0, "b": 15, "c": -15}[c] + float(rng.normal())
        rows.append((i, n1, n2 if i % 10 else None, c if i % 13 else None, y, "hi" if y > 75 else "lo"))
    return spark.createDataFrame(rows, "id long, n1 long, n2 double, c string, num double, cat string").repartition(4)


def matrix(df, prep):
    rows = prep.transform(df).select("id", vector_to_array("features").alias("v")).orderBy("id").collect()
    return np.array([r["v"] for r in rows])


def test_preparation_against_numpy(spark, table):
    prep = X.fit_preparation(table, ["n1", "n2", "c"])
    pdf = table.orderBy("id").toPandas()
    n2 = pdf["n2"].fillna(pdf["n2"].median())
    assert prep.medians["n2"] == pytest.approx(pdf["n2"].median())
    counts = pdf["c"].value_counts()
    mode = sorted(counts[counts == counts.max()].index)[0]
    assert prep.modes["c"] == mode
    got = matrix(table, prep)
    assert prep.names == ["n1", "n2", "c_a", "c_b", "c_c"]
    np.testing.assert_allclose(got[:, 0], (pdf["n1"] - pdf["n1"].mean()) / pdf["n1"].std(ddof=0))
    np.testing.assert_allclose(got[:, 1], (n2 - n2.mean()) / n2.std(ddof=0))
    filled = pdf["c"].fillna(mode)
    for j, v in enumerate("abc"):
        np.testing.assert_array_equal(got[:, 2 + j], (filled == v).astype(float))
    new = spark.createDataFrame([(1, 1, 1.0, "zzz")], "id long, n1 long, n2 double, c string")
    assert list(matrix(new, prep)[0][2:]) == [0.0, 0.0, 0.0]


def test_typing_and_task(spark, table):
    assert X.feature_types(table, ["n1", "c"]) == (["n1"], ["c"])
    with pytest.raises(TypeError):
        X.feature_types(table.withColumn("d", F.current_date()), ["d"])
    assert X.infer_task(table, "num") == "regression" and X.infer_task(table, "cat") == "classification"
    assert X.infer_task(table.withColumn("t", F.col("id") % 10), "t") == "classification"
    assert X.infer_task(table.withColumn("t", F.col("id") % 11), "t") == "regression"


def test_split_is_stable(table):
    def members(df):
        return {r["id"] for r in df.filter(X.is_test("id", 0.2)).select("id").collect()}

    a = members(table)
    assert a == members(table.repartition(13)) and 80 <= len(a) <= 160


def test_penalised_fits_match_closed_form(spark, table):
    prep = X.fit_preparation(table, ["n1", "n2"])
    data = prep.transform(table).withColumn("label", F.col("num"))
    x = matrix(table, prep)
    y = np.array([r["num"] for r in table.orderBy("id").collect()])
    xc, yc, n = x - x.mean(axis=0), y - y.mean(), len(y)
    ridge = np.linalg.solve(xc.T @ xc + np.eye(2), xc.T @ yc)
    ols = np.linalg.lstsq(xc, yc, rcond=None)[0]
    lasso = np.zeros(2)
    for _ in range(500):
        for j in range(2):
            rest = yc - xc @ lasso + xc[:, j] * lasso[j]
            rho = xc[:, j] @ rest / n
            lasso[j] = np.sign(rho) * max(abs(rho) - 1.0, 0) / (xc[:, j] @ xc[:, j] / n)
    for name, want in (("Linear Regression", ols), ("Ridge Regression", ridge), ("Lasso Regression", lasso)):
        model = M.estimator(name, data, 2, 0).fit(data)
        np.testing.assert_allclose(model.coefficients.toArray(), want, rtol=1e-4)


def test_least_squares_with_one_hot_is_the_shortest_fit(table):
    prep = X.fit_preparation(table, ["n1", "n2", "c"])
    data = prep.transform(table).withColumn("label", F.col("num"))
    x = matrix(table, prep)
    y = np.array([r["num"] for r in table.orderBy("id").collect()])
    want = np.linalg.lstsq(x - x.mean(axis=0), y - y.mean(), rcond=1e-10)[0]
    model = M.estimator("Linear Regression", data, 5, 0).fit(data)
    np.testing.assert_allclose(model.coefficients.toArray(), want, rtol=1e-4, atol=1e-3)


def test_logistic_matches_newton(spark, table):
    prep = X.fit_preparation(table, ["n1", "n2"])
    data = prep.transform(table).withColumn("label", (F.col("cat") == "lo").cast("double"))
    x = np.hstack([matrix(table, prep), np.ones((600, 1))])
    y = np.array([float(r["cat"] == "lo") for r in table.orderBy("id").collect()])
    w, ridge = np.zeros(3), np.diag([1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
    model = M.estimator("Logistic Regression", data, 2, 2).fit(data)
    np.testing.assert_allclose([*model.coefficients.toArray(), model.intercept], w, rtol=1e-3)


@pytest.mark.parametrize("name", ["Linear Regression", "Decision Tree Regressor", "something else"])
def test_regressors(table, name):
    run = M.train_model(table, ["n1", "n2", "c"], "num", name, "id")
    assert run.task == "regression" and run.name == M.resolve_model("regression", name)
    row = M.run_scores(run).first()
    assert row["train_score"] > 0.8 and row["test_score"] > 0.8 and row["extra_name"] == "rmse"
    assert run.train.count() + run.test.count() == 600
    top = M.importances(table.sparkSession, run.model, run.preparation.names).orderBy("place").collect()
    assert top[0]["feature"] == "n1" and sum(r["importance"] for r in top) == pytest.approx(1.0, abs=1e-3)


@pytest.mark.parametrize(
    "name", ["Logistic Regression", "K-Nearest Neighbors (KNN)", "Support Vector Classifier (SVC)",
             "Decision Tree Classifier", "Naive Bayes"],
)
def test_classifiers(table, name):
    run = M.train_model(table, ["n1", "n2", "c"], "cat", name, "id")
    row = M.run_scores(run).first()
    assert run.name == name and row["test_score"] > 0.75 and 0.7 < row["extra"] <= 1.0
    assert {r["predicted"] for r in run.test.select("predicted").distinct().collect()} == {"hi", "lo"}
    values = M.raw_importances(run.model)
    # Neighbours, naive Bayes and a kernel machine have no weight per feature.
    assert (values is None) == (name.startswith(("K-Nearest", "Naive", "Support")))


def test_one_vs_rest_for_more_classes(table):
    data = table.withColumn("band", F.when(F.col("num") < 40, "a").when(F.col("num") < 90, "b").otherwise("c"))
    run = M.train_model(data, ["n1", "n2", "c"], "band", "Support Vector Classifier (SVC)", "id")
    assert run.classes == ["a", "b", "c"] and M.run_scores(run).first()["test_score"] > 0.5


def test_metrics(spark):
    frame = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (4.0, 3.0)], "actual double, predicted double")
    row = M.regression_metrics(frame).first()
    y, p = np.array([1.0, 2, 4]), np.array([1.5, 2, 3])
    assert row["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert row["rmse"] == pytest.approx(np.sqrt(((y - p) ** 2).mean()))
    labels = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "actual string, predicted string")
    got = M.classification_metrics(labels).first()
    assert got["accuracy"] == 0.5 and got["f1"] == pytest.approx((2 * (2 / 3) + 0.5) / 4)


def test_bands_and_narrative(spark):
    rows = [(0.95, 0.70), (0.90, 0.80), (0.90, 0.89)]
    frame = spark.createDataFrame(rows, "a double, b double")
    top = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(v).alias("importance")) for n, v in (("x", 0.7), ("y", 0.2), ("z", 0.1))])
    got = frame.select(
        M.health_band(F.col("a"), F.col("b")).alias("band"),
        M.narrative(F.lit("M"), F.lit("regression"), F.col("a"), F.col("b"), top, F.lit("R²")).alias("text"),
        M.narrative(F.lit("M"), F.lit("regression"), F.col("a"), F.col("b"), F.slice(top, 1, 0), F.lit("R²")).alias("bare"),
    ).collect()
    assert [r["band"] for r in got] == ["Overfitting Risk", "Mild Generalization Gap", "Healthy"]
    assert "train R² (95.0%) and test R² (70.0%)" in got[0]["text"] and "🔴 Overfitting Risk" in got[0]["text"]
    assert "1. **x** — contributes `70.0%`" in got[0]["text"] and "a ↑ strongly positive influence" in got[0]["text"]
    assert "**z** — contributes `10.0%` of the model's decision weight. This feature has a → moderate" in got[0]["text"]
    assert "no feature importances" in got[2]["bare"]


def test_shapley_is_exact_for_linear_models(spark, table):
    run = M.train_model(table, ["n1", "n2", "c"], "num", "Linear Regression", "id")
    names = run.preparation.names
    shares = M.sampled_shapley(run.model, run.test, run.train, "id", names, samples=6).cache()
    weights = run.model.coefficients.toArray()
    drawn = run.train.select(vector_to_array("features").alias("z"), X.draw("id", 42).alias("h")).orderBy("h").limit(6)
    base = np.mean([r["z"] for r in drawn.collect()], axis=0)
    rows = {r["id"]: np.array(r["x"]) for r in run.test.select("id", vector_to_array("features").alias("x")).collect()}
    got = {(r["id"], r["feature"]): r["contribution"] for r in shares.collect()}
    assert len(got) == len(rows) * len(names)
    for (i, f), v in got.items():
        j = names.index(f)
        assert v == pytest.approx(weights[j] * (rows[i][j] - base[j]), abs=1e-6)
    top = M.global_attribution(shares).collect()
    assert len(top) == 5 and top[0]["feature"] in ("n1", "n2")
    one = M.row_attribution(shares.filter(F.col("id").isin(list(rows)[:3])), run.test, "id").collect()
    for r in one:
        assert (r["contribution"] > 0) == (r["direction"] == "⬆ increases prediction") or r["contribution"] == 0
    last = M.row_at(run.test, "id", 10_000).first()
    assert last["id"] == max(rows)


def test_nan_targets_are_no_targets(spark):
    rows = [(i, float(i % 17), float("nan") if i % 9 == 0 else 2.0 * (i % 17)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, y double")
    run = M.train_model(df, ["a"], "y", "Linear Regression", "id")
    assert run.train.count() + run.test.count() == sum(i % 9 != 0 for i in range(200))
    assert M.run_scores(run).first()["test_score"] > 0.999
    ten = spark.createDataFrame([(i, float(i % 10) if i % 11 else float("nan")) for i in range(100)], "id long, y double")
    assert X.infer_task(ten, "y") == "classification"


@pytest.mark.parametrize("hot_share", [1, 10, 1_000])
def test_sparse_one_hot_of_hot_rare_and_unknown_categories(spark, hot_share):
    from lectern.operators import features as X

    rows = [(i, "hot" if i % 3 == 0 else f"c{i % 50}", None if i % 4 == 0 else f"d{i % 2}") for i in range(300)]
    df = spark.createDataFrame(rows, "k int, a string, b string").repartition(5)
    train = df.filter("k % 7 <> 0 and a <> 'c13'")
    ids = X.category_ids(train, ["a", "b"])
    known = [(c, v) for c, at in (("a", 1), ("b", 2)) for v in sorted({r[at] for r in rows if r[0] % 7 and r[1] != "c13" and r[at]})]
    assert sorted((r["column"], r["category"], r["id"]) for r in ids.collect()) == sorted((c, v, i) for i, (c, v) in enumerate(known))
    place = {p: i for i, p in enumerate(known)}
    made = X.one_hot_vectors(X.sparse_one_hot(df, ["a", "b"], ids, hot_share=hot_share), len(known))
    got = {r["k"]: r for r in made.collect()}
    assert len(got) == 300 and made.columns == ["k", "a", "b", "indices", "features"]
    for k, a, b in rows:
        want = sorted(place[p] for p in (("a", a), ("b", b)) if p in place)
        assert got[k]["indices"] == want
        assert got[k]["features"].size == len(known) and list(got[k]["features"].indices) == want
    none = X.category_ids(train.limit(0), ["a", "b"])
    assert none.count() == 0 and all(r["indices"] == [] for r in X.sparse_one_hot(df, ["a", "b"], none).collect())


def test_scores_of_one_split_are_one_pass(spark, table):
    split = M.prepare_split(table, ["n1", "n2", "c"], "num", "id")
    runs = [M.fit_model(split, name) for name in ("Ridge Regression", "Lasso Regression", "Decision Tree Regressor")]
    sc = spark.sparkContext
    sc.setJobGroup("scores-of-one-split", "")
    try:
        got = M.run_scores(*runs).collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    # One shuffle: at most a job for its map side and one for its result, however many runs.
    assert 1 <= len(sc.statusTracker().getJobIdsForGroup("scores-of-one-split")) <= 3
    assert [r["model_name"] for r in got] == [r.name for r in runs]
    for row, run in zip(got, runs, strict=True):
        a, b = M.regression_metrics(run.train).first(), M.regression_metrics(run.test).first()
        want = (a["r2"], b["r2"], b["rmse"])
        assert (row["train_score"], row["test_score"], row["extra"]) == pytest.approx(want, rel=1e-9)


def test_scores_of_a_side_without_rows(table):
    run = M.fit_model(M.prepare_split(table, ["n1", "n2"], "num", "id", test_size=0.0), "Ridge Regression")
    row = M.run_scores(run).first()
    assert row["train_score"] > 0.8 and row["test_score"] is None and row["extra"] is None


def test_categories_are_counted_in_one_pass(spark, table):
    seen = spark.sparkContext.accumulator(0)

    def watched(value):
        seen.add(1)
        return value

    train = table.withColumn("c", F.udf(watched, "string").asNondeterministic()("c"))
    prep = X.fit_preparation(train, ["c"])
    assert seen.value == 600 and prep.names == ["c_a", "c_b", "c_c"] and prep.modes["c"] in "abc"


def test_encoder_knows_every_category_in_the_order_of_the_indexer(spark):
    from pyspark.ml.feature import StringIndexer

    values = ["b", " ", "\U0001f600", "～", "A", None, "b", "b"]
    df = spark.createDataFrame([(i, v, None if i % 2 else "x") for i, v in enumerate(values)], "id int, a string, d string")
    prep = X.fit_preparation(df, ["a", "d"])
    rows = StringIndexer(inputCol="a", outputCol="i", handleInvalid="keep", stringOrderType="alphabetAsc").fit(df)
    assert prep.names == [f"a_{v}" for v in rows.labels] + ["d_x"]
    # The null becomes the mode.
    v = prep.transform(df).filter("id = 5").select(vector_to_array("features").alias("v")).first()["v"]
    assert v[rows.labels.index("b")] == 1.0 and sum(v) == 2.0


@pytest.mark.parametrize("key", ["id", ["id"], ["id", "name"]])
def test_draw_is_the_md5_of_the_known_keys(spark, key):
    import hashlib

    df = spark.createDataFrame([(1, "a"), (None, "b"), (-7, None)], "id long, name string")
    keys = [key] if isinstance(key, str) else key
    for row in df.select("*", X.draw(key, 42).alias("h")).collect():
        text = "|".join([str(row[k]) for k in keys if row[k] is not None] + ["42"])
        assert row["h"] == int(hashlib.md5(text.encode()).hexdigest()[:8], 16)
