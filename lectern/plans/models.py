"""Queries for feature preparation, model training and explanation (ML-*)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from lectern import fixed_values as V
from lectern.operators import features as X
from lectern.operators import kernels as K
from lectern.operators import models as M
from lectern.operators.shapley import baseline, trees_of
from lectern.plans import sql as S
from lectern.plans.registry import query, spread, table
from lectern.session import cut

GAPS = {
    "c_custkey": "c_custkey",
    "balance": "CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 8 <> 0 THEN c_acctbal END",
    "nation": "CASE WHEN c_custkey % 9 <> 0 THEN c_nationkey END",
    "segment": "CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END",
}
GAPS_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in GAPS.items()) + " FROM customer"


@query(
    "ML-1 ML-2 ML-4 ML-5 ML-6 ML-7 ML-22",
    f"""WITH g AS ({GAPS_SQL}),
    f AS (SELECT c_custkey, coalesce(balance, (SELECT quantile_cont(balance, 0.5) FROM g)) AS balance,
                 coalesce(CAST(nation AS DOUBLE), (SELECT quantile_cont(nation, 0.5) FROM g)) AS nation,
                 coalesce(segment, (SELECT segment FROM g WHERE segment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS segment
          FROM g),
    s AS (SELECT avg(balance) AS mb, stddev_pop(balance) AS sb, avg(nation) AS mn, stddev_pop(nation) AS sn FROM f),
    cats AS (SELECT DISTINCT segment AS cat FROM f)
    SELECT c_custkey, 'balance' AS feature, round((balance - mb) / sb, 6) AS value FROM f, s
    UNION ALL SELECT c_custkey, 'nation', round((nation - mn) / sn, 6) FROM f, s
    UNION ALL SELECT c_custkey, 'segment_' || cat, CASE WHEN segment = cat THEN 1.0 ELSE 0.0 END FROM f, cats""",
)
def impute_scale_encode(spark, sf_dir):
    """Customers with gaps, some of them NaN: imputed, scaled and one-hot encoded, one row per feature."""
    gaps = table(spark, sf_dir, "customer").select(*[F.expr(e).alias(n) for n, e in GAPS.items()])
    gaps = gaps.withColumn("balance", F.when(F.col("c_custkey") % 8 == 0, F.lit(float("nan"))).otherwise(F.col("balance")))
    prep = X.fit_preparation(gaps, ["balance", "nation", "segment"])
    return prep.long(gaps, ["c_custkey"]).withColumn("value", F.round("value", 6))


@query(
    "ML-7",
    """WITH k AS (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS customer, o_orderpriority AS priority FROM orders),
    train AS (SELECT * FROM k WHERE o_orderkey % 3 <> 0),
    cats AS (SELECT DISTINCT 0 AS c, customer AS category FROM train UNION SELECT DISTINCT 1, priority FROM train),
    ids AS (SELECT c, category, row_number() OVER (ORDER BY c, category) - 1 AS id FROM cats WHERE category IS NOT NULL)
    SELECT o_orderkey, a.id AS customer_id, b.id AS priority_id
    FROM k LEFT JOIN ids a ON a.c = 0 AND a.category = customer LEFT JOIN ids b ON b.c = 1 AND b.category = priority""",
)
def sparse_categories(spark, sf_dir):
    """Orders with a wide column, one-hot from a dictionary of two thirds of them; customers not among these have none."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("customer"), F.col("o_orderpriority").alias("priority")
    )
    ids = X.category_ids(orders.filter("o_orderkey % 3 <> 0"), ["customer", "priority"])
    customers = F.lit(ids.filter("column = 'customer'").count())
    found = X.sparse_one_hot(orders, ["customer", "priority"], ids)
    first, last = F.get("indices", F.lit(0)), F.element_at("indices", -1)
    some = F.size("indices") > 0
    return found.select(
        "o_orderkey", F.when(some & (first < customers), first).alias("customer_id"),
        F.when(some, F.when(last >= customers, last)).alias("priority_id"),
    )


TARGETS = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linenumber", "l_extendedprice"]


@query(
    "ML-3",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS target, CASE WHEN typeof(any_value({c})) <> 'VARCHAR' AND count(DISTINCT {c}) > 10
            THEN 'regression' ELSE 'classification' END AS task FROM lineitem"""
        for c in TARGETS
    ),
)
def task_inference(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    return spark.createDataFrame([(c, X.infer_task(items, c)) for c in TARGETS], "target string, task string")


PENALISED = ["Linear Regression", "Ridge Regression", "Lasso Regression"]


@query(
    "ML-9 ML-10 ML-11",
    """WITH s AS (SELECT count(*) AS n, avg(l_extendedprice) AS my, avg(l_quantity) AS mx, stddev_pop(l_quantity) AS sx,
                         covar_pop(l_quantity, l_extendedprice) AS c FROM lineitem),
    r AS (SELECT *, c / sx AS rho FROM s)
    SELECT 'Linear Regression' AS model_name, round(rho, 3) AS slope, round(my, 3) AS intercept FROM r
    UNION ALL SELECT 'Ridge Regression', round(rho * n / (n + 1), 3), round(my, 3) FROM r
    UNION ALL SELECT 'Lasso Regression', round(sign(rho) * greatest(abs(rho) - 1, 0), 3), round(my, 3) FROM r""",
)
def linear_fits(spark, sf_dir):
    """Least squares, ridge and lasso of price on quantity over all line items; the SQL uses the closed forms."""
    items = table(spark, sf_dir, "lineitem").select("l_quantity", F.col("l_extendedprice").alias("label"))
    prep = X.fit_preparation(items, ["l_quantity"])
    data = prep.transform(items).select("features", "label").cache()
    fits = [(n, M.estimator(n, data, 1, 0).fit(data)) for n in PENALISED]
    data.unpersist()
    rows = [(n, float(f.coefficients[0]), float(f.intercept)) for n, f in fits]
    out = spark.createDataFrame(rows, "model_name string, slope double, intercept double")
    return out.select("model_name", F.round("slope", 3).alias("slope"), F.round("intercept", 3).alias("intercept"))


@query(
    "ML-19",
    """WITH p AS (SELECT l_extendedprice AS y, l_quantity * 2000.0 AS p FROM lineitem)
       SELECT round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS r2, round(sqrt(sum((y - p) ** 2) / count(*)), 3) AS rmse,
              count(*) AS n FROM p""",
)
def regression_metrics(spark, sf_dir):
    """R² and RMSE of a fixed price rule."""
    said = table(spark, sf_dir, "lineitem").select(
        F.col("l_extendedprice").alias("actual"), (F.col("l_quantity") * 2000.0).alias("predicted")
    )
    out = M.regression_metrics(said)
    return out.select(F.round("r2", 6).alias("r2"), F.round("rmse", 3).alias("rmse"), "n")


@query(
    "ML-20",
    """WITH p AS (SELECT event_type AS a, CASE WHEN value > 40 THEN 'purchase' WHEN value > 15 THEN 'click' ELSE 'view' END AS p FROM events),
    k AS (SELECT DISTINCT a AS c FROM p),
    m AS (SELECT c, count(*) FILTER (a = c) AS sup, count(*) FILTER (p = c) AS said, count(*) FILTER (a = c AND p = c) AS hit FROM k, p GROUP BY c),
    f AS (SELECT *, CASE WHEN sup + said = 0 THEN 0.0 ELSE 2.0 * hit / (sup + said) END AS f1 FROM m)
    SELECT round(sum(hit) / CAST(sum(sup) AS DOUBLE), 6) AS accuracy, round(sum(f1 * sup) / sum(sup), 6) AS f1,
           CAST(sum(sup) AS BIGINT) AS n FROM f""",
)
def classification_metrics(spark, sf_dir):
    """Accuracy and weighted F1 of a value rule for the event type."""
    value = F.col("value")
    said = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("actual"),
        F.when(value > 40, "purchase").when(value > 15, "click").otherwise("view").alias("predicted"),
    )
    out = M.classification_metrics(said)
    return out.select(F.round("accuracy", 6).alias("accuracy"), F.round("f1", 6).alias("f1"), "n")


@query(
    "ML-16",
    """WITH p AS (SELECT a.vec_id AS vec_id, b.label AS label, row_number() OVER (PARTITION BY a.vec_id
                  ORDER BY round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6), b.vec_id) AS r
                  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
    v AS (SELECT vec_id, label, count(*) AS n FROM p WHERE r <= 5 GROUP BY ALL),
    w AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, label) AS r FROM v)
    SELECT vec_id, label AS predicted, n AS votes FROM w WHERE r = 1""",
)
def knn_vote(spark, sf_dir):
    """Label of every vector by the vote of its five nearest others."""
    vectors = spread(table(spark, sf_dir, "embeddings"))
    found = M.neighbours(vectors, vectors, "vec_id", "embedding", ["label"], skip_self=True, digits=6)
    return M.vote(found, "label").withColumnRenamed("_test", "vec_id")


RUNS = {
    "train": "CAST(event_id % 101 AS DOUBLE) / 101",
    "test": "CAST(event_id % 101 AS DOUBLE) / 101 - CAST(event_id % 23 AS DOUBLE) / 97",
    "a": "CAST(user_id % 89 AS DOUBLE) / 89",
    "b": "CAST(user_id % 53 AS DOUBLE) / 131",
}


def _p(x: str) -> str:
    return f"format('{{:.1f}}%', {x} * 100)"


def _health(label: str) -> str:
    text = S.text(V.HEALTH_TEXTS[label])
    return f"replace(replace(replace({text}, '{{m}}', 'Accuracy'), '{{tr}}', {_p('train')}), '{{te}}', {_p('test')})"


_BANDS = "CASE WHEN train - test > 0.15 THEN {} WHEN train - test > 0.08 THEN {} ELSE {} END"
_LABELS = [b[2] for b in V.HEALTH_BANDS]
_BAND = _BANDS.format(*[S.text(x) for x in _LABELS])
_MARK = _BANDS.format(*[S.text(b[1]) for b in V.HEALTH_BANDS])
_TEXT = _BANDS.format(*[_health(x) for x in _LABELS])
_NL = "chr(10)"
_ENTRY = "'{i}. **{n}** — contributes `' || {v} || '` of the model''s decision weight. This feature has a ' || {d} || ' influence.' || chr(10)"


@query(
    "ML-23 ML-24",
    f"""WITH runs AS (SELECT event_id, event_type, {', '.join(f'{e} AS {n}' for n, e in RUNS.items())} FROM events),
    bands AS (SELECT *, {_BAND} AS band, event_id % 4 <> 0 AS has FROM runs)
    SELECT event_id, band,
      '## 🤖 AI Model Explainer Report — ' || event_type || {_NL} || {_NL} || '### 🧠 What Did the Model Learn?' || {_NL} || {_NL}
      || 'Your **' || event_type || '** was trained on a **classification** task. '
      || CASE WHEN has THEN 'The most influential input signals driving predictions were **alpha**, **beta**. This means the model found strong patterns in these features that predict the target variable.'
              ELSE 'This model type reports no feature importances.' END
      || {_NL} || {_NL} || '### 📊 Performance Summary' || {_NL} || {_NL} || '- **Train Accuracy**: `' || {_p('train')}
      || '`' || {_NL} || '- **Test Accuracy**: `' || {_p('test')} || '`' || {_NL} || '- **Model Health**: ' || {_MARK} || ' ' || band
      || {_NL} || {_NL} || {_TEXT} || {_NL} || {_NL} || '### 🔍 Feature Impact Explanation' || {_NL} || {_NL}
      || CASE WHEN has THEN {_ENTRY.format(i=1, n='alpha', v=_p('a'), d="'↑ strongly positive'")}
           || {_ENTRY.format(i=2, n='beta', v=_p('b'), d="CASE WHEN b > 0.1 THEN '↑ positive' ELSE '→ moderate' END")} ELSE '' END
      || {_NL} || '### 💡 Actionable Insights' || {_NL} || {_NL}
      || CASE WHEN has THEN '- Focus on **alpha** as the primary driver of the outcome — small changes here will have the largest impact on predictions.'
           || {_NL} || '- Consider running correlation analysis between **alpha** and the target to confirm causality.' || {_NL}
           || '- If you want to improve Accuracy, consider engineering new features derived from alpha, beta.' || {_NL} ELSE '' END AS report
    FROM bands""",
)
def run_reports(spark, sf_dir):
    """Health band and report of a model run per event; a quarter of the runs has no importances."""
    runs = table(spark, sf_dir, "events").select(
        "event_id", "event_type", *[F.expr(e).alias(n) for n, e in RUNS.items()]
    )
    pair = F.array(
        F.struct(F.lit("alpha").alias("feature"), F.col("a").alias("importance")),
        F.struct(F.lit("beta").alias("feature"), F.col("b").alias("importance")),
    )
    top = F.when(F.col("event_id") % 4 != 0, pair).otherwise(F.slice(pair, 1, 0))
    staged = runs.withColumn("top", top)
    report = M.narrative(
        F.col("event_type"), F.lit("classification"), F.col("train"), F.col("test"), F.col("top"), F.lit("Accuracy")
    )
    return staged.select("event_id", M.health_band(F.col("train"), F.col("test")).alias("band"), report.alias("report"))


# ----------------------------------------------------------- trained on a split, checked by closed forms


def _in_test(key: str) -> str:
    return f"CAST('0x' || substr(md5({key} || '|42'), 1, 8) AS BIGINT) % 10000 < 2000"


@query(
    "ML-1 ML-8 ML-9 ML-19",
    f"""WITH d AS (SELECT o_orderkey AS k, o_totalprice AS y, CAST(o_custkey AS DOUBLE) AS x, {_in_test('o_orderkey')} AS t FROM orders),
    f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM d WHERE NOT t),
    p AS (SELECT t, y, a + b * x AS p FROM d, f),
    m AS (SELECT t, 1 - sum((y - p) ** 2) / (var_pop(y) * count(*)) AS r2, sqrt(sum((y - p) ** 2) / count(*)) AS rmse FROM p GROUP BY t)
    SELECT 'Linear Regression' AS model_name, 'regression' AS task, round((SELECT r2 FROM m WHERE NOT t), 6) AS train_score,
           round((SELECT r2 FROM m WHERE t), 6) AS test_score, round((SELECT rmse FROM m WHERE t), 3) AS extra""",
)
def linear_holdout(spark, sf_dir):
    """Least squares of order totals on the customer key, fitted on four fifths and scored on both sides."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    run = M.train_model(orders, ["o_custkey"], "o_totalprice", "Linear Regression", "o_orderkey")
    scores = M.run_scores(run)
    return scores.select(
        "model_name", "task", F.round("train_score", 6).alias("train_score"),
        F.round("test_score", 6).alias("test_score"), F.round("extra", 3).alias("extra"),
    )


def _f1_sql(said: str) -> str:
    """Accuracy and weighted F1 by side from rows ``t, y, p``."""
    return f"""
    k AS (SELECT DISTINCT t, y AS c FROM {said}),
    cm AS (SELECT k.t, c, count(*) FILTER (y = c) AS sup, count(*) FILTER (p = c) AS saidn, count(*) FILTER (y = c AND p = c) AS hit
           FROM k JOIN {said} s ON s.t = k.t GROUP BY k.t, c),
    m AS (SELECT t, sum(hit) / CAST(sum(sup) AS DOUBLE) AS acc,
                 sum(sup * CASE WHEN sup + saidn = 0 THEN 0.0 ELSE 2.0 * hit / (sup + saidn) END) / sum(sup) AS f1 FROM cm GROUP BY t)"""


@query(
    "ML-1 ML-8 ML-18 ML-20",
    f"""WITH d AS (SELECT event_id, event_type AS y, value, {_in_test('event_id')} AS t FROM events),
    z AS (SELECT avg(value) AS mu, stddev_pop(value) AS sd FROM d WHERE NOT t),
    x AS (SELECT event_id, y, t, (value - mu) / sd AS x FROM d, z),
    c AS (SELECT y AS c, count(*) AS n, avg(x) AS mu, var_pop(x) AS v FROM x WHERE NOT t GROUP BY y),
    l AS (SELECT event_id, t, y, c, ln(n) - 0.5 * ln(2 * pi() * v) - (x - mu) ** 2 / (2 * v) AS score FROM x, c),
    said AS (SELECT event_id, t, any_value(y) AS y, arg_max(c, score) AS p FROM l GROUP BY event_id, t),
    {_f1_sql('said')}
    SELECT 'Naive Bayes' AS model_name, 'classification' AS task, round((SELECT acc FROM m WHERE NOT t), 6) AS train_score,
           round((SELECT acc FROM m WHERE t), 6) AS test_score, round((SELECT f1 FROM m WHERE t), 6) AS extra""",
)
def bayes_holdout(spark, sf_dir):
    """Gaussian naive Bayes of the event type on its value."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    run = M.train_model(events, ["value"], "event_type", "Naive Bayes", "event_id")
    scores = M.run_scores(run)
    return scores.select("model_name", "task", *[F.round(c, 6).alias(c) for c in ("train_score", "test_score", "extra")])


@query(
    "ML-8 ML-16 ML-20",
    f"""WITH d AS (SELECT s_suppkey AS k, s_acctbal, s_nationkey, CAST(s_suppkey % 3 AS VARCHAR) AS y, {_in_test('s_suppkey')} AS t FROM supplier),
    z AS (SELECT avg(s_acctbal) AS m1, stddev_pop(s_acctbal) AS s1, avg(s_nationkey) AS m2, stddev_pop(s_nationkey) AS s2 FROM d WHERE NOT t),
    x AS (SELECT k, y, t, (s_acctbal - m1) / s1 AS a, (s_nationkey - m2) / s2 AS b FROM d, z),
    r AS (SELECT q.k, q.t, q.y, n.y AS label, row_number() OVER (PARTITION BY q.k ORDER BY
            round(sqrt((q.a - n.a) ** 2 + (q.b - n.b) ** 2), 9), n.k) AS place FROM x q, x n WHERE NOT n.t),
    v AS (SELECT k, t, any_value(y) AS y, label, count(*) AS n FROM r WHERE place <= 5 GROUP BY k, t, label),
    w AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, label) AS place FROM v),
    said AS (SELECT t, y, label AS p FROM w WHERE place = 1),
    {_f1_sql('said')}
    SELECT 'K-Nearest Neighbors (KNN)' AS model_name, 'classification' AS task, round((SELECT acc FROM m WHERE NOT t), 6) AS train_score,
           round((SELECT acc FROM m WHERE t), 6) AS test_score, round((SELECT f1 FROM m WHERE t), 6) AS extra""",
)
def neighbour_holdout(spark, sf_dir):
    """Five nearest neighbours on balance and nation of the suppliers, scored on both sides."""
    suppliers = table(spark, sf_dir, "supplier").select(
        "s_suppkey", "s_acctbal", "s_nationkey", (F.col("s_suppkey") % 3).cast("string").alias("group")
    )
    run = M.train_model(suppliers, ["s_acctbal", "s_nationkey"], "group", "K-Nearest Neighbors (KNN)", "s_suppkey")
    scores = M.run_scores(run)
    return scores.select("model_name", "task", *[F.round(c, 6).alias(c) for c in ("train_score", "test_score", "extra")])


_ATTRIBUTION = f"""
d AS (SELECT o_orderkey AS k, o_totalprice AS y, CAST(o_custkey AS DOUBLE) AS x1, CAST(year(o_orderdate) AS DOUBLE) AS x2,
             {_in_test('o_orderkey')} AS t, md5(o_orderkey || '|42') AS h FROM orders),
s AS (SELECT avg(x1) AS m1, stddev_pop(x1) AS s1, avg(x2) AS m2, stddev_pop(x2) AS s2 FROM d WHERE NOT t),
z AS (SELECT k, y, t, h, (x1 - m1) / s1 AS a, (x2 - m2) / s2 AS b FROM d, s),
c AS (SELECT covar_pop(a, b) AS r, covar_pop(a, y) AS u, covar_pop(b, y) AS v FROM z WHERE NOT t),
w AS (SELECT (u - r * v) / (1 - r * r) AS wa, (v - r * u) / (1 - r * r) AS wb FROM c),
bg AS (SELECT avg(a) AS za, avg(b) AS zb FROM (SELECT * FROM z WHERE NOT t ORDER BY substr(h, 1, 8), k LIMIT 8)),
shares AS (SELECT k, y, 'o_custkey' AS feature, wa * (a - za) AS c FROM z, w, bg WHERE t
           UNION ALL SELECT k, y, 'year', wb * (b - zb) FROM z, w, bg WHERE t)"""


def _order_run(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"), "o_totalprice"
    )
    return M.train_model(orders, ["o_custkey", "year"], "o_totalprice", "Linear Regression", "o_orderkey")


@query(
    "ML-25",
    f"WITH {_ATTRIBUTION} SELECT feature, round(avg(abs(c)), 2) AS mean_abs FROM shares GROUP BY feature",
)
def linear_attribution(spark, sf_dir):
    """Mean absolute contribution per feature of a linear model, where sampled Shapley values are exact."""
    run = _order_run(spark, sf_dir)
    shares = M.sampled_shapley(run.model, run.test, run.train, "o_orderkey", run.preparation.names)
    return M.global_attribution(shares).withColumn("mean_abs", F.round("mean_abs", 2))


@query(
    "ML-21",
    f"""WITH {_ATTRIBUTION}, raw AS (SELECT 'o_custkey' AS feature, abs(wa) AS v FROM w UNION ALL SELECT 'year', abs(wb) FROM w)
    SELECT feature, round(v / sum(v) OVER (), 4) AS importance, CAST(row_number() OVER (ORDER BY v DESC) AS INTEGER) AS place FROM raw""",
)
def linear_importance(spark, sf_dir):
    """Shares of the absolute coefficients of a linear model."""
    run = _order_run(spark, sf_dir)
    return M.importances(spark, run.model, run.preparation.names)


def _percent(x: str) -> str:
    return f"format('{{:.1f}}%', {x} * 100)"


@query(
    "ML-19 ML-21 ML-23 ML-24",
    f"""WITH {_ATTRIBUTION},
    p AS (SELECT t, y, (SELECT avg(y) FROM z WHERE NOT t) + wa * a + wb * b AS p FROM z, w),
    r AS (SELECT t, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 4) AS r2, round(sqrt(sum((y - p) ** 2) / count(*)), 4) AS rmse
          FROM p GROUP BY t),
    o AS (SELECT (SELECT r2 FROM r WHERE NOT t) AS train, (SELECT r2 FROM r WHERE t) AS test, (SELECT rmse FROM r WHERE t) AS extra,
                 CASE WHEN abs(wa) >= abs(wb) THEN 'o_custkey' ELSE 'year' END AS f1, CASE WHEN abs(wa) >= abs(wb) THEN 'year' ELSE 'o_custkey' END AS f2,
                 round(greatest(abs(wa), abs(wb)) / (abs(wa) + abs(wb)), 4) AS i1, round(least(abs(wa), abs(wb)) / (abs(wa) + abs(wb)), 4) AS i2 FROM w),
    b AS (SELECT *, {_BAND} AS band FROM o)
    SELECT 'Linear Regression' AS model_name, train AS train_score, test AS test_score, round(extra, 2) AS extra, band,
      '## 🤖 AI Model Explainer Report — Linear Regression' || {_NL} || {_NL} || '### 🧠 What Did the Model Learn?' || {_NL} || {_NL}
      || 'Your **Linear Regression** was trained on a **regression** task. The most influential input signals driving predictions were **' || f1 || '**, **' || f2
      || '**. This means the model found strong patterns in these features that predict the target variable.'
      || {_NL} || {_NL} || '### 📊 Performance Summary' || {_NL} || {_NL} || '- **Train R²**: `' || {_percent('train')} || '`' || {_NL}
      || '- **Test R²**: `' || {_percent('test')} || '`' || {_NL} || '- **Model Health**: ' || {_MARK} || ' ' || band || {_NL} || {_NL}
      || replace({_TEXT}, 'Accuracy', 'R²') || {_NL} || {_NL} || '### 🔍 Feature Impact Explanation' || {_NL} || {_NL}
      || '1. **' || f1 || '** — contributes `' || {_percent('i1')} || '` of the model''s decision weight. This feature has a ↑ strongly positive influence.' || {_NL}
      || '2. **' || f2 || '** — contributes `' || {_percent('i2')} || '` of the model''s decision weight. This feature has a '
      || CASE WHEN i2 > 0.1 THEN '↑ positive' ELSE '→ moderate' END || ' influence.' || {_NL}
      || {_NL} || '### 💡 Actionable Insights' || {_NL} || {_NL} || '- Focus on **' || f1
      || '** as the primary driver of the outcome — small changes here will have the largest impact on predictions.' || {_NL}
      || '- Consider running correlation analysis between **' || f1 || '** and the target to confirm causality.' || {_NL}
      || '- If you want to improve R², consider engineering new features derived from ' || f1 || ', ' || f2 || '.' || {_NL} AS report
    FROM b""",
)
def explained_run(spark, sf_dir):
    """A linear model explained from its scores to its report."""
    out = M.explain(_order_run(spark, sf_dir))
    return out.select("model_name", "train_score", "test_score", F.round("extra", 2).alias("extra"), "band", "report")


@query(
    "ML-26",
    f"""WITH {_ATTRIBUTION} SELECT k AS o_orderkey, feature, round(c, 2) AS contribution,
        CASE WHEN c > 0 THEN '⬆ increases prediction' ELSE '⬇ decreases prediction' END AS direction,
        CAST(row_number() OVER (PARTITION BY k ORDER BY abs(c) DESC, feature) AS INTEGER) AS place, y AS actual FROM shares""",
)
def linear_drivers(spark, sf_dir):
    """Contributions to every test order's predicted total."""
    run = _order_run(spark, sf_dir)
    shares = M.sampled_shapley(run.model, run.test, run.train, "o_orderkey", run.preparation.names)
    out = M.row_attribution(shares, run.test, "o_orderkey", digits=2)
    return out.select(
        "o_orderkey", "feature", "contribution", "direction", "place",
        F.col("actual").cast("double").alias("actual"),
    )


# ----------------------------------------------- trees, forests, boosting and separators with a known answer

# A feature with four values: a tree that can tell them apart predicts the mean, or the majority, of each.
_LEVELS = f"""
d AS (SELECT o_orderkey AS k, o_totalprice * (1 + o_custkey % 4) AS y, o_custkey % 4 AS x, {_in_test('o_orderkey')} AS t,
             md5(o_orderkey || '|42') AS h FROM orders),
g AS (SELECT x, avg(y) AS p FROM d WHERE NOT t GROUP BY x)"""


def _level_split(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 4).alias("level"), F.lit(1).alias("flat"),
        (F.col("o_totalprice") * (1 + F.col("o_custkey") % 4)).alias("price"),
    )
    return M.prepare_split(orders, ["level", "flat"], "price", "o_orderkey")


def _scores(split, names, digits=6):
    out = None
    for name in names:
        row = M.run_scores(M.fit_model(split, name))
        out = row if out is None else out.unionByName(row)
    return out.select("model_name", "task", *[F.round(c, digits).alias(c) for c in ("train_score", "test_score", "extra")])


@query(
    "ML-12 ML-14 ML-19",
    f"""WITH {_LEVELS},
    m AS (SELECT t, 1 - sum((y - p) ** 2) / (var_pop(y) * count(*)) AS r2, sqrt(sum((y - p) ** 2) / count(*)) AS rmse
          FROM d JOIN g USING (x) GROUP BY t)
    SELECT name AS model_name, 'regression' AS task, round((SELECT r2 FROM m WHERE NOT t), 3) AS train_score,
           round((SELECT r2 FROM m WHERE t), 3) AS test_score, round((SELECT rmse FROM m WHERE t), 3) AS extra
    FROM (VALUES ('Decision Tree Regressor'), ('Gradient Boosting Regressor')) AS v(name)""",
)
def tree_scores(spark, sf_dir):
    """A tree and boosted trees on four levels predict each level's mean price."""
    return _scores(_level_split(spark, sf_dir), ["Decision Tree Regressor", "Gradient Boosting Regressor"], 3)


SEPARATORS = [
    "Logistic Regression", "Support Vector Classifier (SVC)", "Decision Tree Classifier", "Random Forest Classifier",
    "Gradient Boosting Classifier",
]


@query(
    "ML-12 ML-13 ML-14 ML-15 ML-17 ML-20",
    f"""WITH said AS (SELECT {_in_test('event_id')} AS t, CASE WHEN user_id % 4 < 2 THEN 'low' ELSE 'high' END AS p,
                 CASE WHEN (user_id % 4 < 2) <> (event_id % 10 = 0) THEN 'low' ELSE 'high' END AS y FROM events),
    {_f1_sql('said')}
    SELECT name AS model_name, 'classification' AS task, round((SELECT acc FROM m WHERE NOT t), 6) AS train_score,
           round((SELECT acc FROM m WHERE t), 6) AS test_score, round((SELECT f1 FROM m WHERE t), 6) AS extra
    FROM (VALUES {', '.join(f"('{n}')" for n in SEPARATORS)}) AS v(name)""",
)
def separable_scores(spark, sf_dir):
    """Classifiers on four levels, every tenth label wrong: each must predict its level's majority."""
    low = (F.col("user_id") % 4 < 2) != (F.col("event_id") % 10 == 0)
    events = table(spark, sf_dir, "events").select(
        "event_id", (F.col("user_id") % 4).alias("level"), F.when(low, "low").otherwise("high").alias("side")
    )
    return _scores(M.prepare_split(events, ["level"], "side", "event_id"), SEPARATORS)


@query(
    "ML-13 ML-14 ML-21",
    """SELECT name AS model_name, feature, importance, CAST(place AS INTEGER) AS place
       FROM (VALUES ('Random Forest Regressor'), ('Gradient Boosting Regressor')) AS v(name),
            (VALUES ('level', 1.0::DOUBLE, 1), ('flat', 0.0::DOUBLE, 2)) AS w(feature, importance, place)""",
)
def level_importance(spark, sf_dir):
    """A forest and boosted trees give a constant column no weight."""
    split, out = _level_split(spark, sf_dir), None
    for name in ("Random Forest Regressor", "Gradient Boosting Regressor"):
        run = M.fit_model(split, name)
        row = M.importances(spark, run.model, run.preparation.names).withColumn("model_name", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


_LEVEL_SHARES = f"""{_LEVELS},
bg AS (SELECT avg(p) AS z FROM (SELECT p FROM d JOIN g USING (x) WHERE NOT t ORDER BY substr(h, 1, 8), k LIMIT 8)),
shares AS (SELECT k, y, p, 'level' AS feature, p - z AS c FROM d JOIN g USING (x), bg WHERE t
           UNION ALL SELECT k, y, p, 'flat', 0.0 FROM d JOIN g USING (x) WHERE t)"""


@query(
    "ML-25",
    f"WITH {_LEVEL_SHARES} SELECT feature, round(avg(abs(c)), 2) AS mean_abs FROM shares GROUP BY feature",
)
def tree_attribution(spark, sf_dir):
    """Contributions to a tree of one feature: what its level's mean differs from the background's."""
    run = M.fit_model(_level_split(spark, sf_dir), "Decision Tree Regressor")
    shares = M.sampled_shapley(run.model, run.test, run.train, "o_orderkey", run.preparation.names)
    return M.global_attribution(shares).withColumn("mean_abs", F.round("mean_abs", 2))


@query(
    "ML-26",
    f"""WITH {_LEVEL_SHARES} SELECT k AS o_orderkey, feature, round(c, 2) AS contribution,
        CAST(CASE feature WHEN 'level' THEN 1 ELSE 2 END AS INTEGER) AS place, round(p, 2) AS predicted FROM shares""",
)
def tree_drivers(spark, sf_dir):
    """The contributions to every test order's predicted price."""
    run = M.fit_model(_level_split(spark, sf_dir), "Decision Tree Regressor")
    shares = M.sampled_shapley(run.model, run.test, run.train, "o_orderkey", run.preparation.names)
    out = M.row_attribution(shares, run.test, "o_orderkey", digits=2)
    return out.select(
        "o_orderkey", "feature", (F.col("contribution") + 0.0).alias("contribution"), "place",
        F.round(F.col("prediction").cast("double"), 2).alias("predicted"),
    )


# Two features with two values each: a tree that splits on the stronger one first holds the mean of every cell.
_CELLS = f"""
d AS (SELECT o_orderkey AS k, o_custkey % 2 AS a, CAST(o_orderkey % 3 = 0 AS INTEGER) AS b, {_in_test('o_orderkey')} AS t FROM orders),
e AS (SELECT *, 1000 * a + 100 * b + 50 * a * b + (k % 16) / 1000.0::DOUBLE AS y FROM d),
n AS (SELECT avg(y) AS none FROM e WHERE NOT t),
pa AS (SELECT a, avg(y) AS with_a, count(*) * 1.0::DOUBLE / (SELECT count(*) FROM e WHERE NOT t) AS share FROM e WHERE NOT t GROUP BY a),
pab AS (SELECT a, b, avg(y) AS both_known FROM e WHERE NOT t GROUP BY a, b),
pb AS (SELECT b, sum(share * both_known) AS with_b FROM pab JOIN pa USING (a) GROUP BY b)"""


def _cell_run(spark, sf_dir, name):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 2).alias("a"), (F.col("o_orderkey") % 3 == 0).cast("int").alias("b")
    )
    price = 1000 * F.col("a") + 100 * F.col("b") + 50 * F.col("a") * F.col("b") + (F.col("o_orderkey") % 16) / 1000.0
    return M.train_model(orders.withColumn("price", price), ["a", "b"], "price", name, "o_orderkey")


@query(
    "ML-25 ML-26",
    f"""WITH {_CELLS},
    x AS (SELECT * FROM e JOIN pa USING (a) JOIN pb USING (b) JOIN pab USING (a, b), n WHERE t)
    SELECT k AS o_orderkey, 'a' AS feature, round(((with_a - none) + (both_known - with_b)) / 2, 4) AS contribution FROM x
    UNION ALL SELECT k, 'b', round(((with_b - none) + (both_known - with_a)) / 2, 4) FROM x""",
)
def cell_shapley(spark, sf_dir):
    """Exact path-dependent Shapley values of every test order for a tree of two features that act together."""
    run = _cell_run(spark, sf_dir, "Decision Tree Regressor")
    shares = M.attribution(run, run.test, "o_orderkey")
    return shares.select("o_orderkey", "feature", F.round("contribution", 4).alias("contribution"))


@query(
    "ML-25 ML-26",
    f"""WITH {_CELLS} SELECT count(*) AS n_rows, 0 AS unexplained FROM e WHERE t""",
)
def forest_shapley(spark, sf_dir):
    """Test orders whose contributions in a random forest do not add up to what it predicts above its baseline."""
    run = _cell_run(spark, sf_dir, "Random Forest Regressor")
    shares = M.attribution(run, run.test, "o_orderkey")
    base = baseline(trees_of(run.model, spark))
    sums = shares.groupBy("o_orderkey").agg(F.sum("contribution").alias("explained"))
    off = F.abs(F.col("predicted") - F.col("explained") - F.lit(base)) > 1e-6
    return run.test.join(sums, "o_orderkey").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(off).cast("int").alias("unexplained")
    )


# ------------------------------------------------------------------------------- RBF support vectors

_RING_RADIUS = "(CASE WHEN c_custkey % 2 = 1 THEN 1 ELSE 3 END + (c_custkey % 7) / 20.0)"


@query(
    "ML-17 ML-20",
    f"""SELECT c_custkey, CASE WHEN c_custkey % 2 = 1 THEN 'inner' ELSE 'outer' END AS predicted
        FROM customer WHERE {_in_test('c_custkey')}""",
)
def ring_classes(spark, sf_dir):
    """Two rings around one centre, which no straight line parts: each test customer's ring."""
    angle = F.radians((F.col("c_custkey") * 37 % 360).cast("double"))
    ring = F.when(F.col("c_custkey") % 2 == 1, "inner").otherwise("outer")
    points = spread(table(spark, sf_dir, "customer")).select(
        "c_custkey", (F.expr(_RING_RADIUS) * F.cos(angle)).alias("x"), (F.expr(_RING_RADIUS) * F.sin(angle)).alias("y"),
        ring.alias("ring"),
    )
    run = M.train_model(points, ["x", "y"], "ring", "Support Vector Classifier (SVC)", "c_custkey")
    return run.test.select("c_custkey", "predicted")


_GAMMA, _LANDMARKS = 0.5, 20


@query(
    "ML-17",
    f"""WITH p AS (SELECT c_custkey, c_acctbal / 1000 AS x, c_nationkey / 10.0::DOUBLE AS y,
              ('0x' || substr(md5(c_custkey || '|42'), 1, 8))::BIGINT AS h FROM customer),
    l AS (SELECT x AS lx, y AS ly FROM p ORDER BY h, c_custkey LIMIT {_LANDMARKS})
    SELECT c_custkey, round(sum(exp(-{_GAMMA}::DOUBLE * ((x - lx) ** 2 + (y - ly) ** 2))), 4) + 0.0 AS similarity
    FROM p, l GROUP BY c_custkey""",
)
def kernel_similarity(spark, sf_dir):
    """Products of mapped customers with mapped landmarks, added up: the kernel itself, as SQL computes it."""
    points = table(spark, sf_dir, "customer").select(
        "c_custkey",
        array_to_vector(F.array(F.col("c_acctbal").cast("double") / 1000, F.col("c_nationkey") / 10.0)).alias("features"),
    )
    mapping = K.fit_map(points, "c_custkey", _GAMMA, _LANDMARKS)
    total = F.array(*[F.lit(float(v)) for v in mapping.apply(mapping.landmarks).sum(axis=0)])
    product = F.zip_with(vector_to_array(K.MAPPED), total, lambda a, b: a * b)
    similarity = F.aggregate(product, F.lit(0.0), lambda a, b: a + b)
    return mapping.transform(points).select("c_custkey", F.round(similarity, 4).alias("similarity"))


# ------------------------------------------------------------------------- trained models, rows only

ITEM_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
QUALITY_FEATURES = ["n_chars", "lang", "n_words", "n_distinct"]


def items(spark, sf_dir):
    """Line items with a key that is unique: order, part and supplier hashed together."""
    return spread(table(spark, sf_dir, "lineitem")).select(
        F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("row_key"),
        *ITEM_FEATURES, "l_extendedprice",
    )


def quality(spark, sf_dir):
    """Judged documents with simple text features."""
    from lectern.functions import text as T

    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "text"))
    shaped = docs.withColumn("_t", T.tokens(F.col("text"))).select(
        "doc_id", "lang", "n_chars", F.size("_t").alias("n_words"), F.size(F.array_distinct("_t")).alias("n_distinct")
    )
    judged = shaped.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    # Every fit reads the features several times; the texts behind them are read once.
    return cut(judged)


@query("ML-12 ML-13 ML-21")
def forest_importance(spark, sf_dir):
    """Importances of a forest that predicts the price of a line item."""
    run = M.train_model(items(spark, sf_dir), ITEM_FEATURES, "l_extendedprice", "Random Forest Regressor", "row_key")
    return M.importances(spark, run.model, run.preparation.names)


@query("ML-8 ML-9 ML-10 ML-11 ML-12 ML-19")
def regression_scores(spark, sf_dir):
    """Train and test scores of the linear and tree regressors on line items."""
    split = M.prepare_split(items(spark, sf_dir), ITEM_FEATURES, "l_extendedprice", "row_key")
    return M.run_scores(*[M.fit_model(split, name) for name in [*PENALISED, "Decision Tree Regressor"]])


@query("ML-8 ML-12 ML-15 ML-17 ML-18 ML-20")
def classifier_scores(spark, sf_dir):
    """Train and test scores of the classifiers that predict a document's quality label."""
    split = M.prepare_split(quality(spark, sf_dir), QUALITY_FEATURES, "quality", "doc_id")
    out = None
    for name in [
        "Logistic Regression", "Support Vector Classifier (SVC)", "Decision Tree Classifier", "Naive Bayes",
        "K-Nearest Neighbors (KNN)",
    ]:
        row = M.run_scores(M.fit_model(split, name))
        out = row if out is None else out.unionByName(row)
    return out


@query("ML-14 ML-21")
def boosted_importance(spark, sf_dir):
    """Importances of boosted trees for the quality label."""
    run = M.train_model(
        quality(spark, sf_dir), QUALITY_FEATURES, "quality", "Gradient Boosting Classifier", "doc_id"
    )
    return M.importances(spark, run.model, run.preparation.names)


def _part_run(spark, sf_dir):
    parts = spread(table(spark, sf_dir, "part")).select("p_partkey", "p_size", "p_type", "p_retailprice")
    return M.train_model(parts, ["p_size", "p_type"], "p_retailprice", "Decision Tree Regressor", "p_partkey")


@query("ML-25")
def shapley_sample(spark, sf_dir):
    """Mean absolute contribution per feature of a tree that predicts part prices, over all test parts."""
    run = _part_run(spark, sf_dir)
    shares = M.sampled_shapley(run.model, run.test, run.train, "p_partkey", run.preparation.names)
    return M.global_attribution(shares)


@query("ML-26")
def row_drivers(spark, sf_dir):
    """The strongest contributions to every test part's predicted price."""
    run = _part_run(spark, sf_dir)
    shares = M.sampled_shapley(run.model, run.test, run.train, "p_partkey", run.preparation.names)
    return M.row_attribution(shares, run.test, "p_partkey")
