import random
import statistics
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import profiling as P
from lectern.operators import quantiles as Q
from lectern.operators import ranking
from lectern.operators import relational as L


def test_never_ordered(spark):
    customers = spark.createDataFrame([(1, "Joe"), (3, "Ann")], "id int, name string")
    orders = spark.createDataFrame([(1, 3)], "id int, customerId int")
    assert [r["name"] for r in L.never_ordered(customers, orders, "id", "customerId").collect()] == ["Joe"]


def test_best_per_group(spark):
    rows = [(1, 3, 95), (1, 2, 95), (1, 1, 80), (2, 9, 70)]
    frame = spark.createDataFrame(rows, "student_id int, course_id int, grade int")
    best = L.best_per_group(frame, "student_id", "grade", ["course_id"], ["student_id", "course_id", "grade"])
    assert sorted(map(tuple, best.collect())) == [(1, 2, 95), (2, 9, 70)]


def test_streaks(spark):
    days = [(1, d) for d in (1, 2, 3, 7)] + [(2, d) for d in (1, 2, 4, 5)]
    rows = [(u, datetime(2026, 6, d, h)) for u, d in days for h in (1, 9)]
    frame = spark.createDataFrame(rows, "user_id int, ts timestamp")
    assert [r[0] for r in L.active_users(frame, "user_id", "ts").collect()] == [1]
    runs = {(r["user_id"], r["first_day"], r["days"]) for r in L.streaks(frame, "user_id", "ts").collect()}
    assert (1, date(2026, 6, 1), 3) in runs and (2, date(2026, 6, 4), 2) in runs and len(runs) == 4


def test_median_imputation(spark):
    frame = spark.createDataFrame([(10.0,), (None,), (15.0,), (20.0,)], "weight double")
    assert [r[0] for r in L.impute_median(frame, "weight").collect()] == [10.0, 15.0, 15.0, 20.0]


def test_correlated_pairs(spark):
    frame = spark.createDataFrame([(1.0, 2.0, 10.0), (2.0, 4.0, 1.0), (3.0, 5.9, 5.0)], "A double, B double, C double")
    assert [(r["feature_a"], r["feature_b"]) for r in L.correlated_pairs(frame, ["A", "B", "C"], 0.95).collect()] == [("A", "B")]


def test_wide_correlations_equal_plain_ones(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(1000, 1, size=(400, 5))
    x[:, 3] = x[:, 0] * 2 + rng.normal(size=400) * 0.01
    rows = [tuple(None if rng.random() < 0.1 else float(v) for v in r[:4]) + (0.1,) for r in x]
    frame = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(6)
    plain = {(r[0], r[1]): r[2] for r in L.correlations(frame, list("abcde")).collect()}
    monkeypatch.setattr(L, "MAX_PAIR_AGGREGATES", 0)
    wide = {(r[0], r[1]): r[2] for r in L.correlations(frame, list("abcde")).collect()}
    assert set(plain) == set(wide)
    for k, v in plain.items():
        assert wide[k] == (None if "e" in k else pytest.approx(v, abs=1e-9)) and (v is None) == ("e" in k)
    full = {(r[0], r[1]): r[2] for r in P.correlation_matrix(frame, list("abe")).collect()}
    assert len(full) == 9 and full[("a", "a")] == 1.0 and full[("e", "e")] is None and full[("b", "a")] == full[("a", "b")]


def test_retention(spark):
    rows = [(1, datetime(2024, 1, 5)), (1, datetime(2024, 2, 5)), (2, datetime(2024, 1, 9)), (2, datetime(2024, 1, 20)),
            (3, datetime(2024, 2, 1)), (3, datetime(2024, 4, 1))]
    frame = spark.createDataFrame(rows, "user_id int, ts timestamp")
    cells = {(r["cohort"], r["month_offset"]): r["retention_pct"] for r in L.cohort_retention(frame, "user_id", "ts").collect()}
    assert cells == {("2024-01", 0): 100.0, ("2024-01", 1): 50.0, ("2024-02", 0): 100.0, ("2024-02", 2): 100.0}
    wide = {r["cohort"]: r for r in L.retention_pivot(frame, "user_id", "ts", 2).collect()}
    assert wide["2024-01"]["1"] == 50.0 and wide["2024-02"]["1"] is None


def test_text_puzzles(spark):
    frame = spark.createDataFrame(
        [("  hello world  ", "cbaebabacd", "abc", "A man a\tplan"), ("", "ab", "abc", "Never odd or even")],
        "s string, t string, p string, q string",
    )
    got = frame.select(
        L.reverse_words(F.col("s")), L.anagram_starts(F.col("t"), F.col("p")), L.is_palindrome(F.col("q"))
    ).collect()
    assert tuple(got[0]) == ("world hello", [0, 6], False)
    assert tuple(got[1]) == ("", [], True)


def test_merge(spark):
    frame = spark.createDataFrame([([[1, 4, 5], [1, 3, 4], [2, 6]],)], "lists array<array<int>>")
    assert frame.select(L.merge_lists(F.col("lists"))).first()[0] == [1, 1, 2, 3, 4, 4, 5, 6]
    sets = [spark.createDataFrame([(v, i) for v in s], "v int, i int") for i, s in enumerate([[1, 4, 5], [1, 3, 4], [2, 6]])]
    assert [r["v"] for r in L.merge_sorted(sets, "v", ["i"]).collect()] == [1, 1, 2, 3, 4, 4, 5, 6]


def test_second_highest(spark):
    frame = spark.createDataFrame([(5.0,), (5.0,), (3.0,)], "v double")
    assert L.second_highest(frame, "v").first()[0] == 3.0
    assert L.second_highest(frame.filter("v = 5"), "v").first()[0] is None


def test_class_metrics(spark):
    frame = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "y string, p string")
    got = {r["class"]: r for r in L.class_metrics(frame, "y", "p").collect()}
    assert got["a"]["precision"] == 1.0 and got["a"]["recall"] == 0.5
    assert got["b"]["precision"] == pytest.approx(1 / 3) and got["c"]["f1"] == 0.0


@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_quantiles_exact(spark, accuracy):
    """A low accuracy makes the sketch bracket the quantile, so the second pass does the work."""
    rnd = random.Random(5)
    groups = {"hot": [round(rnd.gauss(0, 100), 1) for _ in range(4000)], "dup": [1.0] * 700 + [2.0] * 801, "one": [3.5]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("hot", None)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(6)
    probs = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]
    for r in Q.exact_quantiles(frame, ["g"], "v", probs, accuracy).collect():
        assert r["quantile"] == pytest.approx(float(np.quantile(groups[r["g"]], r["prob"])), abs=1e-9)


def test_blocks_of_columns_give_every_pair(spark, monkeypatch):
    """300 columns in small blocks, with gaps, NaNs and constants: kept sums, handed-on sums and numpy agree."""
    rng = np.random.default_rng(4)
    x = rng.normal(50, 3, size=(90, 300))
    x[:, 7], x[:, 8] = 4.1, x[:, 6] * -2
    x[rng.random(x.shape) < 0.05] = np.nan
    names = [f"v{i}" for i in range(300)]
    rows = [tuple(None if v != v and i % 2 else float(v) for i, v in enumerate(r)) for r in x]
    frame = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(3)
    got = []
    for held in (10**6, 0):
        found = L.wide_correlations(frame, names, block=37, held_pairs=held, values=5000).collect()
        got.append({(r["_a"], r["_b"]): r["correlation"] for r in found})
    assert len(got[0]) == len(got[1]) == 300 * 301 // 2
    assert got[0][6, 8] == pytest.approx(-1) and got[0][5, 5] == 1.0 and got[0][7, 7] is None and got[0][7, 9] is None
    for (a, b), v in got[0].items():
        assert (v is None) == (got[1][a, b] is None) and (v is None) == (7 in (a, b))
        if v is not None:
            both = ~np.isnan(x[:, a]) & ~np.isnan(x[:, b])
            assert v == pytest.approx(got[1][a, b], abs=1e-9)
            assert v == pytest.approx(np.corrcoef(x[both, a], x[both, b])[0, 1], abs=1e-9)
    part = names[:9]
    plain = {(r[0], r[1]): r[2] for r in P.correlation_matrix(frame, part).collect()}
    monkeypatch.setattr(L, "MAX_PAIR_AGGREGATES", 0)
    wide = {(r[0], r[1]): r[2] for r in P.correlation_matrix(frame, part).collect()}
    assert plain.keys() == wide.keys() and len(wide) == 81
    assert all(wide[k] == (None if v is None else pytest.approx(v, abs=1e-9)) for k, v in plain.items())


@pytest.mark.parametrize("slice_rows", [1, 20, 400])
def test_quantile_slices_are_cut_until_they_are_short(spark, monkeypatch, slice_rows):
    """Whole ranges as brackets: slices of thousands of values, cut with three ranges a round."""
    rnd = random.Random(9)
    groups = {
        "far": [rnd.gauss(0, 100) for _ in range(3000)],
        "tied": [1.0] * 900 + [2.0] * 900 + [1 + rnd.random() for _ in range(300)],
        "two": [1.0, 2.0],
    }
    monkeypatch.setattr(Q, "RANGES", 3)
    longest = []
    interpolated = Q._interpolated
    monkeypatch.setattr(Q, "_interpolated", lambda c, g: longest.append(c) or interpolated(c, g))
    frame = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double").repartition(5)
    for r in Q.exact_quantiles(frame, ["g"], "v", [0.0, 0.3, 0.5, 0.97, 1.0], 10, slice_rows).collect():
        assert r["quantile"] == pytest.approx(float(np.quantile(groups[r["g"]], r["prob"])), abs=1e-9)
    sizes = longest[1].groupBy("g", "prob").agg(F.count("_v").alias("n")).agg(F.max("n")).first()[0]
    assert sizes <= max(slice_rows, 2)


def test_missed_brackets_are_taken_again(spark, monkeypatch):
    """A sketch that answers with the largest value everywhere: the counts show it, and the whole range is taken."""
    values = [float(i) for i in range(500)]
    frame = spark.createDataFrame([("a", v) for v in values] + [("b", 7.0)], "g string, v double")
    approx = F.percentile_approx

    def wrong(c, shares, accuracy):
        return F.transform(approx(c, shares, accuracy), lambda _e: F.lit(490.0)) if accuracy == 50 else approx(c, shares, accuracy)

    monkeypatch.setattr(Q.F, "percentile_approx", wrong)
    got = {(r["g"], r["prob"]): r["quantile"] for r in Q.exact_quantiles(frame, ["g"], "v", [0.25, 0.5, 0.98], 50).collect()}
    assert got == {("a", p): pytest.approx(float(np.quantile(values, p))) for p in (0.25, 0.5, 0.98)} | {("b", p): 7.0 for p in (0.25, 0.5, 0.98)}


@pytest.mark.parametrize("per_bucket", [7, 1_000_000])
def test_positions(spark, per_bucket):
    rows = [(i % 3 == 0, i * 10) for i in range(200)]
    frame = spark.createDataFrame(rows, "g boolean, k long").repartition(5)
    got = ranking.positions(frame, ["g"], "k", rows_per_bucket=per_bucket).collect()
    assert len(got) == 200
    for flag in (True, False):
        mine = sorted((r["k"], r["position"]) for r in got if r["g"] is flag)
        assert [p for _, p in mine] == list(range(len(mine)))


TABLE = [("a", 1.0, "u", True), ("a", 3.0, None, False), ("b", None, "u", True), (None, 7.0, "v", None), ("b", 4.0, "v", True)]


@pytest.fixture(scope="module")
def chart(spark):
    return spark.createDataFrame(TABLE, "x string, y double, z string, flag boolean")


def test_chart_data(chart):
    assert [tuple(r) for r in P.chart_data(chart, "x", "y", "bar").collect()] == [("a", 2.0), ("b", 4.0)]
    assert [tuple(r) for r in P.chart_data(chart, "x", "z", "area").collect()] == [("a", "u", 1), ("b", "u", 1), ("b", "v", 1)]
    assert [tuple(r) for r in P.chart_data(chart, "x", "flag", "line").collect()] == [("a", 0.5), ("b", 1.0)]
    assert P.chart_data(chart, "x", "y", "scatter").count() == 3
    assert P.is_numeric(chart, "flag") and not P.is_numeric(chart, "x")


def test_profiles(spark, chart):
    row = P.numeric_profile(chart, ["y"]).first()
    values = [1.0, 3.0, 7.0, 4.0]
    assert (row["mean"], row["min"], row["max"]) == (3.75, 1.0, 7.0)
    assert row["std"] == pytest.approx(statistics.stdev(values))
    cats = {r["column"]: tuple(r)[1:] for r in P.categorical_profile(chart, ["x", "z"]).collect()}
    assert cats == {"x": (2, "a", 2), "z": (2, "u", 2)}
    empty = spark.createDataFrame([(None,)], "x string")
    assert tuple(P.categorical_profile(empty, ["x"]).first()) == ("x", 0, "N/A", 0)


def test_box_summary_counts_outliers(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0]
    frame = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    r = P.box_summary(frame, "g", "v").first()
    assert (r["min"], r["max"], r["outliers"]) == (1.0, 100.0, 1)
    assert r["median"] == 3.5 and r["q1"] == 2.25 and r["q3"] == 4.75


def test_histogram_edges(spark):
    frame = spark.createDataFrame([(float(v), 5.0) for v in range(11)], "v double, c double")
    got = {(r["column"], r["bin"]): r["n"] for r in P.histogram(frame, ["v", "c"], 5).collect()}
    assert got[("v", 5)] == 3 and sum(n for (c, _), n in got.items() if c == "v") == 11 and got[("c", 1)] == 11


def test_description_variants(spark):
    d = "double"
    frame = spark.createDataFrame([(1.005, 2.5, None, None), (1.0, None, 3, 4), (None, None, None, 4)], f"a {d}, b {d}, u long, v long")
    texts = [r[0] for r in frame.select(P.describe(F.lit("Bar"), F.lit("x"), F.lit("y"), *[F.col(c) for c in "abuv"])).collect()]
    assert f"a mean of `{1.005:.2f}`" in texts[0] and "`2.50`" in texts[0] and "unique" not in texts[0]
    assert "**x** contains `3` unique categories. **y** contains `4`" in texts[1]
    assert "**x** contains" not in texts[2] and "**y** contains `4`" in texts[2]


def test_correlations_skip_nan_in_both_plans(spark, monkeypatch):
    import random

    nan = float("nan")
    rng = random.Random(3)
    rows = [(float(i), i * 2.0 + rng.random(), nan if i % 4 == 0 else -float(i), None if i % 5 == 0 else 7.0) for i in range(60)]
    rows += [(nan, nan, nan, nan), (None, None, None, None)]
    frame = spark.createDataFrame(rows, "a double, b double, c double, d double")
    names = ["a", "b", "c", "d"]
    got = []
    for limit in (300, 0):
        monkeypatch.setattr(L, "MAX_PAIR_AGGREGATES", limit)
        found = L.correlations(frame, names).collect()
        got.append({(r["feature_a"], r["feature_b"]): None if r["correlation"] is None else round(r["correlation"], 9) for r in found})
    assert got[0] == got[1]
    assert got[0]["a", "c"] == -1.0 and got[0]["a", "d"] is None and got[0]["a", "b"] > 0.99


def test_statistics_take_nan_for_missing(spark):
    from lectern.operators import profiling as P
    from lectern.operators import quantiles as Q

    frame = spark.createDataFrame([(1.0,), (float("nan"),), (3.5,), (4.0,), (None,)], "v double")
    assert Q.medians(frame, ["v"]) == {"v": 3.5}
    assert Q.exact_quantiles(frame, [], "v", [0.0, 1.0]).orderBy("prob").collect()[1]["quantile"] == 4.0
    row = P.numeric_profile(frame, ["v"]).first()
    assert (row["min"], row["max"]) == (1.0, 4.0) and abs(row["mean"] - 8.5 / 3) < 1e-12
    assert sum(r["n"] for r in P.histogram(frame, ["v"], 3).collect()) == 3
    assert sorted(r["v"] for r in L.impute_median(frame, "v").collect()) == [1.0, 3.5, 3.5, 3.5, 4.0]


def test_median_of_whole_numbers_may_lie_between_them(spark):
    for kind in ("int", "long", "short"):
        df = spark.createDataFrame([(1,), (2,), (None,), (4,), (3,)], f"v {kind}")
        assert sorted(r[0] for r in L.impute_median(df, "v").collect()) == [1.0, 2.0, 2.5, 3.0, 4.0]
    empty = spark.createDataFrame([(None,)], "v int")
    assert [r[0] for r in L.impute_median(empty, "v").collect()] == [None]
