"""Model training, metrics, importances, health, narrative and attribution (ML-9…26)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import Model
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern import fixed_values as V
from lectern.functions.rounding import half_even, percent
from lectern.operators import features as X
from lectern.operators.forest import MAX_FEATURES, fit_forest
from lectern.operators.kernels import KernelModel, fit_classifier
from lectern.operators.nearest import nearest
from lectern.operators.ranking import positions
from lectern.operators.relational import class_metrics
from lectern.operators.shapley import tree_shapley
from lectern.session import cut

SEED = 42
NEIGHBOURS = 5
TOP_IMPORTANCES = 10
TOP_GLOBAL = 8
TOP_DRIVERS = 6
MAX_NORMAL_FEATURES = 4096
TINY = 1e-10
# Training rows up to which the library grows a regression forest itself, with its own Poisson weights.
FOREST_ROWS = 1_000_000

# Model names by task and the default for an unknown name.
REGRESSORS = [
    "Linear Regression", "Ridge Regression", "Lasso Regression", "Decision Tree Regressor",
    "Random Forest Regressor", "Gradient Boosting Regressor",
]
CLASSIFIERS = [
    "Logistic Regression", "K-Nearest Neighbors (KNN)", "Support Vector Classifier (SVC)",
    "Decision Tree Classifier", "Random Forest Classifier", "Gradient Boosting Classifier", "Naive Bayes",
]
DEFAULT_MODEL = {"regression": "Random Forest Regressor", "classification": "Random Forest Classifier"}


def resolve_model(task: str, name: str) -> str:
    """The named model when it fits the task, else the task's forest (ML-13)."""
    known = REGRESSORS if task == "regression" else CLASSIFIERS
    return name if name in known else DEFAULT_MODEL[task]


def _ridge(train: DataFrame, n_features: int, alpha: float = 1.0, per_row: float = 0.0) -> LinearRegression:
    """Penalty (alpha + n·per_row)·‖w‖² on the summed squared error (ML-10).

    The library minimises the mean error on a label scaled by its deviation, hence the factor.
    """
    row = train.agg(
        F.count(F.lit(1)).alias("n"), F.stddev_pop("label").alias("pop"), F.stddev_samp("label").alias("samp")
    ).first()
    normal = n_features <= MAX_NORMAL_FEATURES
    return LinearRegression(
        elasticNetParam=0.0, solver="normal" if normal else "l-bfgs", standardization=False,
        regParam=(alpha / row["n"] + per_row) * (row["pop"] if normal else row["samp"]),
    )


def estimator(name: str, train: DataFrame, n_features: int, n_classes: int):
    """Unfitted estimator for a model name."""
    if name == "Linear Regression":
        # One-hot columns add up to the intercept. A vanishing penalty picks the shortest of the equal fits,
        # where a plain solve of the singular system returns huge coefficients that cancel.
        return _ridge(train, n_features, alpha=0.0, per_row=TINY)
    if name == "Ridge Regression":
        return _ridge(train, n_features)
    if name == "Lasso Regression":
        return LinearRegression(elasticNetParam=1.0, regParam=1.0, standardization=False)
    if name == "Decision Tree Regressor":
        return DecisionTreeRegressor(maxDepth=5, seed=SEED)
    if name == "Random Forest Regressor":
        return RandomForestRegressor(numTrees=100, maxDepth=6, seed=SEED)
    if name == "Gradient Boosting Regressor":
        return GBTRegressor(maxIter=100, maxDepth=3, stepSize=0.1, seed=SEED)
    if name == "Logistic Regression":
        return LogisticRegression(regParam=1.0 / train.count(), standardization=False, maxIter=1000)
    if name == "Decision Tree Classifier":
        return DecisionTreeClassifier(maxDepth=5, seed=SEED)
    if name == "Random Forest Classifier":
        return RandomForestClassifier(numTrees=100, maxDepth=6, seed=SEED)
    if name == "Gradient Boosting Classifier":
        gbt = GBTClassifier(maxIter=100, maxDepth=3, stepSize=0.1, seed=SEED)
        return gbt if n_classes <= 2 else OneVsRest(classifier=gbt)
    if name == "Naive Bayes":
        return NaiveBayes(modelType="gaussian")
    raise ValueError(f"no estimator for {name}")


@dataclass
class ModelRun:
    """A trained model with its predictions on both sides of the split."""

    task: str
    name: str
    preparation: X.Preparation
    model: Model | KernelModel | None
    train: DataFrame
    test: DataFrame
    classes: list[str]
    split: Split | None = None


@dataclass
class Split:
    """Prepared training and test rows that several models can share; ``both`` has them with ``_held_out``."""

    task: str
    key: str
    preparation: X.Preparation
    train: DataFrame
    test: DataFrame
    both: DataFrame


def prepare_split(
    df: DataFrame, features: list[str], target: str, key: str, test_size: float = 0.2, seed: int = SEED
) -> Split:
    """Typing, task, split and preparation (ML-1…8). Rows without a target (null or NaN) are left out."""
    task = X.infer_task(df, target)
    slim = df.select(key, *[c for c in features if c != key], X.known(df, target).alias("_target")).filter(
        F.col("_target").isNotNull()
    )
    test_side = X.is_test(key, test_size, seed)
    train_raw = slim.filter(~test_side)
    prep = X.fit_preparation(train_raw, features)
    # Every fit and every score reads the prepared rows again: both sides are prepared once, in one pass.
    prepared = prep.transform(slim.withColumn("_held_out", test_side))
    both = cut(prepared.select(key, "_target", "_held_out", "features"))
    train, test = (both.filter(side).drop("_held_out") for side in (~F.col("_held_out"), F.col("_held_out")))
    return Split(task, key, prep, train, test, both)


def fit_model(split: Split, name: str) -> ModelRun:
    """One model on a prepared split (ML-9…18). Predictions carry ``key, actual, predicted``."""
    name, key, prep = resolve_model(split.task, name), split.key, split.preparation
    if split.task == "regression":
        train = split.train.withColumn("label", F.col("_target").cast("double"))
        unfitted, model = estimator(name, train, len(prep.names), 0), None
        if name == "Random Forest Regressor" and len(prep.names) <= MAX_FEATURES and (rows := train.count()) > FOREST_ROWS:
            model = fit_forest(unfitted, train, rows)
        model = model or unfitted.fit(train)

        def predict(side: DataFrame) -> DataFrame:
            return model.transform(side).select(
                key, "features", F.col("_target").cast("double").alias("actual"), F.col("prediction").alias("predicted")
            )

        return ModelRun(split.task, name, prep, model, predict(split.train), predict(split.test), [], split)

    train, test = (side.withColumn("_class", F.col("_target").cast("string")) for side in (split.train, split.test))
    indexer = StringIndexer(inputCol="_class", outputCol="label", stringOrderType="alphabetAsc").fit(train)
    classes = list(indexer.labels)
    if name == "K-Nearest Neighbors (KNN)":
        both = (knn_predict(train, side, key, "_class") for side in (train, test))
        return ModelRun(split.task, name, prep, None, *both, classes, split)
    labelled = indexer.transform(train)
    if name == "Support Vector Classifier (SVC)":
        model = fit_classifier(labelled, key, len(classes))
    else:
        model = estimator(name, labelled, len(prep.names), len(classes)).fit(labelled)
    back = IndexToString(inputCol="prediction", outputCol="predicted", labels=classes)

    def classify(side: DataFrame) -> DataFrame:
        said = back.transform(model.transform(side))
        return said.select(key, "features", F.col("_class").alias("actual"), "predicted")

    return ModelRun(split.task, name, prep, model, classify(train), classify(test), classes, split)


def train_model(
    df: DataFrame, features: list[str], target: str, name: str, key: str, test_size: float = 0.2, seed: int = SEED
) -> ModelRun:
    """Preparation, split and fit of one model (ML-1…18)."""
    return fit_model(prepare_split(df, features, target, key, test_size, seed), name)


def neighbours(
    train: DataFrame, test: DataFrame, key: str, vec: str, keep: list[str], k: int = NEIGHBOURS,
    skip_self: bool = False, digits: int = 9,
) -> DataFrame:
    """The k nearest training rows per test row by Euclidean distance, ties by key (ML-16)."""
    asked = test.select(F.col(key).alias("_test"), F.col(vec).alias("_asked"))
    columns = [key, *[c for c in keep if c != key]]
    pairs = nearest(
        train, vec, asked, "_test", "_asked", columns, "euclidean", k, None, digits, others=skip_self
    )
    w = Window.partitionBy("_test").orderBy(F.desc("score"), key)
    ranked = pairs.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
    return ranked.withColumn("distance", -F.col("score")).drop("score")


def vote(found: DataFrame, label: str) -> DataFrame:
    """Majority label per test row, ties to the smallest label. Counts are per (row, label)."""
    counted = found.groupBy("_test", label).agg(F.count(F.lit(1)).alias("_votes"))
    return counted.groupBy("_test").agg(
        F.min_by(label, F.struct((-F.col("_votes")).alias("_o"), label)).alias("predicted"),
        F.max("_votes").alias("votes"),
    )


def knn_predict(train: DataFrame, test: DataFrame, key: str, label: str, k: int = NEIGHBOURS) -> DataFrame:
    """Majority vote of the k nearest training rows (ML-16)."""
    arrays = [side.withColumn("_array", vector_to_array("features")) for side in (train, test)]
    found = neighbours(arrays[0], arrays[1], key, "_array", [label], k)
    votes = vote(found, label).withColumnRenamed("_test", key)
    return test.join(votes, key).select(key, "features", F.col(label).alias("actual"), "predicted")


# ------------------------------------------------------------------------------------ metrics


def regression_metrics(predictions: DataFrame) -> DataFrame:
    """One row ``r2, rmse, n`` (ML-19), in one aggregation."""
    one = predictions.agg(_squares("predicted").alias("_sse"), *_spread())
    return one.select(*_fit("_sse"), "n")


def _squares(predicted: str) -> Column:
    error = F.col("actual") - F.col(predicted)
    return F.sum(error * error)


def _spread() -> list[Column]:
    return [(F.var_pop("actual") * F.count(F.lit(1))).alias("_sst"), F.count(F.lit(1)).alias("n")]


def _fit(sse: str) -> list[Column]:
    return [
        (F.lit(1.0) - F.try_divide(sse, "_sst")).alias("r2"), F.sqrt(F.try_divide(sse, "n")).alias("rmse"),
    ]


def _side_metrics(runs: list[ModelRun]) -> list[tuple[dict, dict]]:
    """``regression_metrics`` of the training and the test side for every run on one split, in one pass over it."""
    scored = runs[0].split.both.select("_held_out", "features", F.col("_target").cast("double").alias("actual"))
    for i, run in enumerate(runs):
        scored = run.model.transform(scored).withColumnRenamed("prediction", f"_p{i}")
    sums = scored.groupBy("_held_out").agg(*[_squares(f"_p{i}").alias(f"_sse{i}") for i in range(len(runs))], *_spread())
    rows = sums.select("_held_out", *[F.struct(*_fit(f"_sse{i}")).alias(f"_m{i}") for i in range(len(runs))]).collect()
    sides = {r["_held_out"]: r for r in rows}
    # A side without rows has no scores.
    none = {"r2": None, "rmse": None}
    return [
        tuple(sides[held][f"_m{i}"].asDict() if held in sides else none for held in (False, True))
        for i in range(len(runs))
    ]


def classification_metrics(predictions: DataFrame) -> DataFrame:
    """One row ``accuracy, f1, n`` with support-weighted F1 (ML-20), from the confusion table."""
    per = class_metrics(predictions, "actual", "predicted")
    return per.agg(
        F.try_divide(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("accuracy"),
        F.coalesce(F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")), F.lit(0.0)).alias("f1"),
        F.sum("support").alias("n"),
    )


def run_scores(*runs: ModelRun) -> DataFrame:
    """One row per run: scores on both sides and the extra metric, as computed; ``explain`` rounds them.

    Regressors fitted on one split are scored together: its rows are read once for all of them.
    """
    spark, rows = runs[0].train.sparkSession, []
    shared = runs[0].split is not None and all(r.task == "regression" and r.split is runs[0].split for r in runs)
    together = _side_metrics(list(runs)) if shared else None
    for i, run in enumerate(runs):
        if run.task == "regression":
            a, b = together[i] if shared else (regression_metrics(side).first() for side in (run.train, run.test))
            rows.append((run.name, run.task, "R²", a["r2"], b["r2"], "rmse", b["rmse"]))
        else:
            a, b = (classification_metrics(side).first() for side in (run.train, run.test))
            rows.append((run.name, run.task, "Accuracy", a["accuracy"], b["accuracy"], "f1", b["f1"]))
    return spark.createDataFrame(
        rows,
        "model_name string, task string, metric string, train_score double, test_score double, "
        "extra_name string, extra double",
    )


# ------------------------------------------------------------------------------- importances


def raw_importances(model: Model | None) -> np.ndarray | None:
    """Tree importances, else absolute coefficients averaged over classes; None when a model has neither."""
    if model is None:
        return None
    if hasattr(model, "featureImportances"):
        return model.featureImportances.toArray()
    if hasattr(model, "models"):  # one-vs-rest
        parts = [raw_importances(m) for m in model.models]
        return None if any(p is None for p in parts) else np.mean(parts, axis=0)
    if hasattr(model, "coefficientMatrix") and model.coefficientMatrix.numRows > 1:
        return np.abs(model.coefficientMatrix.toArray()).mean(axis=0)
    if hasattr(model, "coefficients"):
        return np.abs(model.coefficients.toArray())
    return None


def importances(spark: SparkSession, model: Model | None, names: list[str], top: int = TOP_IMPORTANCES) -> DataFrame:
    """``feature, importance, place``: share of the total of all features, the top ten, four decimals (ML-21)."""
    values = raw_importances(model)
    rows = []
    if values is not None:
        total = float(values.sum()) or 1.0
        order = sorted(range(len(names)), key=lambda i: -values[i])[:top]
        rows = [(names[i], round(float(values[i]) / total, 4), p + 1) for p, i in enumerate(order)]
    return spark.createDataFrame(rows, "feature string, importance double, place int")


# ------------------------------------------------------------------------ health and narrative


def health_band(train_score: Column, test_score: Column) -> Column:
    """Label of the gap between train and test score (ML-23)."""
    gap = train_score - test_score
    out = None
    for above, _mark, label in V.HEALTH_BANDS:
        if above is not None:
            out = F.when(gap > above, F.lit(label)) if out is None else out.when(gap > above, F.lit(label))
    return out.otherwise(F.lit(V.HEALTH_BANDS[-1][2]))


def narrative(
    name: Column, task: Column, train_score: Column, test_score: Column, top: Column, metric: Column
) -> Column:
    """Plain-text report of a run (ML-24). ``top`` is an array of ``feature, importance`` in order.

    A model without importances says so, where the original call failed.
    """
    band = health_band(train_score, test_score)
    train_text, test_text = percent(train_score), percent(test_score)
    mark = message = None
    for _above, m, label in V.HEALTH_BANDS:
        text = F.replace(
            F.replace(F.replace(F.lit(V.HEALTH_TEXTS[label]), F.lit("{m}"), metric), F.lit("{tr}"), train_text),
            F.lit("{te}"), test_text,
        )
        mark = F.when(band == label, F.lit(m)) if mark is None else mark.when(band == label, F.lit(m))
        message = F.when(band == label, text) if message is None else message.when(band == label, text)
    names = F.transform(top, lambda f: f["feature"])
    bold = F.array_join(F.transform(F.slice(names, 1, 3), lambda n: F.concat(F.lit("**"), n, F.lit("**"))), ", ")
    has = F.size(top) > 0
    first = F.try_element_at(names, F.lit(1))

    def line(f: Column, i: Column) -> Column:
        strength = (
            F.when(i == 0, F.lit("↑ strongly positive")).when(f["importance"] > 0.1, F.lit("↑ positive"))
            .otherwise(F.lit("→ moderate"))
        )
        return F.concat(
            (i + 1).cast("string"), F.lit(". **"), f["feature"], F.lit("** — contributes `"), percent(f["importance"]),
            F.lit("` of the model's decision weight. This feature has a "), strength, F.lit(" influence.\n"),
        )

    signals = F.when(
        has,
        F.concat(
            F.lit("The most influential input signals driving predictions were "), bold,
            F.lit(". This means the model found strong patterns in these features that predict the target variable."),
        ),
    ).otherwise(F.lit("This model type reports no feature importances."))
    insights = F.when(
        has,
        F.concat(
            F.lit("- Focus on **"), first, F.lit("** as the primary driver of the outcome — small changes here will have the largest impact on predictions.\n- Consider running correlation analysis between **"),
            first, F.lit("** and the target to confirm causality.\n- If you want to improve "), metric,
            F.lit(", consider engineering new features derived from "), F.array_join(F.slice(names, 1, 2), ", "), F.lit(".\n"),
        ),
    ).otherwise(F.lit(""))
    return F.concat(
        F.lit("## 🤖 AI Model Explainer Report — "), name, F.lit("\n\n### 🧠 What Did the Model Learn?\n\nYour **"), name,
        F.lit("** was trained on a **"), task, F.lit("** task. "), signals,
        F.lit("\n\n### 📊 Performance Summary\n\n- **Train "), metric, F.lit("**: `"), train_text,
        F.lit("`\n- **Test "), metric, F.lit("**: `"), test_text, F.lit("`\n- **Model Health**: "), mark, F.lit(" "), band,
        F.lit("\n\n"), message, F.lit("\n\n### 🔍 Feature Impact Explanation\n\n"),
        F.array_join(F.transform(F.slice(top, 1, 5), line), ""),
        F.lit("\n### 💡 Actionable Insights\n\n"), insights,
    )


def explain(run: ModelRun) -> DataFrame:
    """One row from run to report: scores to four decimals, the strongest features, health band and text (ML-19…24)."""
    spark = run.train.sparkSession
    scores = run_scores(run).first()
    train, test, extra = (round(float(scores[c]), 4) for c in ("train_score", "test_score", "extra"))
    top = [(r["feature"], r["importance"]) for r in importances(spark, run.model, run.preparation.names).collect()]
    row = (run.name, run.task, scores["metric"], train, test, scores["extra_name"], extra, top)
    one = spark.createDataFrame(
        [row],
        "model_name string, task string, metric string, train_score double, test_score double, extra_name string, "
        "extra double, top array<struct<feature:string,importance:double>>",
    )
    told = narrative(*[F.col(c) for c in ("model_name", "task", "train_score", "test_score", "top", "metric")])
    return one.withColumn("band", health_band(F.col("train_score"), F.col("test_score"))).withColumn("report", told)


# -------------------------------------------------------------------------------- attribution


def sampled_shapley(
    model: Model, rows: DataFrame, background: DataFrame, key: str, names: list[str], samples: int = 8,
    output: str = "prediction", seed: int = SEED,
) -> DataFrame:
    """Signed contribution of every feature to every row: ``key, feature, contribution`` (ML-25, ML-26).

    Sampled Shapley values (Štrumbelj & Kononenko 2014). Each row meets ``samples`` background rows; per pair
    the features switch from the background's to the row's value in an order drawn by hash, and the change in
    the model's output is credited to the feature that switched. The background is a fixed number of rows, so
    it travels in the plan; every step after it stays within its row until the averages.
    """
    drawn = (
        background.select(vector_to_array("features").alias("z"), X.draw(key, seed).alias("_h"), key)
        .orderBy("_h", key).limit(samples).collect()
    )
    n = len(names)
    baselines = F.array(
        *[F.struct(F.lit(s).alias("s"), F.array(*[F.lit(float(v)) for v in r["z"]]).alias("z")) for s, r in enumerate(drawn)]
    )
    paired = rows.select(key, vector_to_array("features").alias("_x"), F.explode(baselines).alias("_b"))
    # Place of each feature in the pair's switching order.
    drawn_order = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda f: F.struct(F.xxhash64(F.col(key), F.col("_b.s"), f, F.lit(seed)).alias("h"), f.alias("f")),
    )
    ordered = paired.withColumn("_order", F.transform(F.sort_array(drawn_order), lambda o: o["f"]))
    placed = ordered.withColumn(
        "_place",
        F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda f: F.array_position("_order", f).cast("int")),
    )
    steps = placed.select(
        key, F.col("_b.s").alias("_s"), "_order", "_x", F.col("_b.z").alias("_z"), "_place",
        F.explode(F.sequence(F.lit(0), F.lit(n))).alias("_step"),
    )
    mixed = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda f: F.when(F.get("_place", f) <= F.col("_step"), F.get("_x", f)).otherwise(F.get("_z", f)),
    )
    points = steps.select(key, "_s", "_step", "_order", array_to_vector(mixed).alias("features"))
    scored = model.transform(points)
    value = F.col(output) if output == "prediction" else vector_to_array(output)[1]
    # A step's value is added to the feature that switched in and taken from the one that switches next.
    credit = F.array(
        F.struct(F.get("_order", F.col("_step") - 1).alias("f"), value.alias("v")),
        F.struct(F.get("_order", F.col("_step")).alias("f"), (-value).alias("v")),
    )
    shares = scored.select(key, F.explode(credit).alias("_c")).filter(F.col("_c.f").isNotNull())
    named = F.get(F.array(*[F.lit(x) for x in names]), F.col("_c.f"))
    return shares.groupBy(key, named.alias("feature")).agg(
        (F.sum("_c.v") / F.lit(float(len(drawn)))).alias("contribution")
    )


def attribution(run: ModelRun, rows: DataFrame, key: str, samples: int = 8) -> DataFrame:
    """Contributions of every feature to ``rows`` (ML-25, ML-26): exact for trees, forests and boosted trees, sampled
    for the other models. Classifiers are explained for their second class."""
    names = run.preparation.names
    if type(run.model).__name__.startswith(("DecisionTree", "RandomForest", "GBT")):
        return tree_shapley(run.model, rows, key, names)
    output = "prediction" if run.task == "regression" or not hasattr(run.model, "hasParam") else "rawPrediction"
    return sampled_shapley(run.model, rows, run.train, key, names, samples, output)


def global_attribution(contributions: DataFrame, top: int = TOP_GLOBAL) -> DataFrame:
    """Mean absolute contribution per feature, the top eight, five decimals (ML-25)."""
    means = contributions.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("_m"))
    return means.select("feature", half_even(F.col("_m"), 5).alias("mean_abs")).orderBy(
        F.desc("mean_abs"), "feature"
    ).limit(top)


def row_attribution(
    contributions: DataFrame, predictions: DataFrame, key: str, top: int = TOP_DRIVERS, digits: int = 5
) -> DataFrame:
    """Largest contributions of each row with direction, prediction and actual value (ML-26)."""
    w = Window.partitionBy(key).orderBy(F.desc(F.abs("contribution")), "feature")
    ranked = contributions.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)
    return ranked.join(predictions.select(key, "predicted", "actual"), key).select(
        key, "place", "feature", half_even(F.col("contribution"), digits).alias("contribution"),
        F.when(F.col("contribution") > 0, F.lit("⬆ increases prediction")).otherwise(F.lit("⬇ decreases prediction")).alias("direction"),
        F.col("predicted").cast("string").alias("prediction"), F.col("actual").cast("string").alias("actual"),
    )


def row_at(predictions: DataFrame, key: str, index: int) -> DataFrame:
    """The row at a position of the test set in the order of a numeric key; an index past the end means the last row.

    Positions are numbered bucket by bucket, so no task holds the rows before it.
    """
    placed = positions(predictions, [], key, "_at")
    last = placed.agg(F.max("_at")).first()[0]
    return placed.filter(F.col("_at") == min(index, last if last is not None else 0)).drop("_at")
