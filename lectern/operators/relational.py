"""Classic relational tasks: anti-join, best row, streaks, retention, imputation, text puzzles (TB-*)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

from lectern.functions import text as T
from lectern.functions.binding import let
from lectern.functions.numbers import number
from lectern.operators import quantiles as Q

# Column pairs up to which correlations are plain aggregates.
MAX_PAIR_AGGREGATES = 300
# Wide correlations: columns of a block, pairs up to which a task keeps its sums, numbers of the table it holds at once.
BLOCK_COLUMNS = 128
HELD_PAIRS = 500_000
HELD_VALUES = 4_000_000
PAIR_SUMS = ("n", "x", "y", "xx", "yy", "xy")


def never_ordered(customers: DataFrame, orders: DataFrame, key: str, order_key: str) -> DataFrame:
    """Customers without an order (TB-1). Order keys are made distinct first, so a hot key shuffles once per task."""
    seen = orders.select(F.col(order_key).alias(key)).distinct()
    return customers.join(seen, key, "left_anti")


def best_per_group(df: DataFrame, group: str, best: str, tie: list[str], keep: list[str]) -> DataFrame:
    """Row with the highest ``best`` per group, ties by ``tie`` ascending (TB-2).

    One aggregation with map-side combine: a hot group sends one row per task and is never sorted whole.
    """
    order = F.struct((-F.col(best)).alias("_neg"), *tie)
    row = F.struct(*[c for c in keep if c != group])
    return df.groupBy(group).agg(F.min_by(row, order).alias("_r")).select(group, "_r.*")


def streaks(df: DataFrame, user: str, ts: str) -> DataFrame:
    """Runs of consecutive days per user: ``first_day``, ``last_day``, ``days`` (TB-3).

    (user, day) is made distinct before the window, so a window holds days, not events.
    """
    days = df.select(user, F.to_date(ts).alias("_day")).distinct()
    w = Window.partitionBy(user).orderBy("_day")
    runs = days.withColumn("_run", F.date_sub(F.col("_day"), F.row_number().over(w)))
    return runs.groupBy(user, "_run").agg(
        F.min("_day").alias("first_day"), F.max("_day").alias("last_day"), F.count(F.lit(1)).alias("days")
    ).drop("_run")


def active_users(df: DataFrame, user: str, ts: str, days: int = 3) -> DataFrame:
    """Users with a streak of at least ``days`` (TB-3)."""
    return streaks(df, user, ts).filter(F.col("days") >= days).select(user).distinct().orderBy(user)


def impute_median(df: DataFrame, column: str) -> DataFrame:
    """Nulls and NaNs of a column replaced by the exact median of the others (TB-4).

    The median of whole numbers may lie between two of them, so a column of integers becomes one of doubles.
    """
    if isinstance(df.schema[column].dataType, t.IntegralType):
        df = df.withColumn(column, F.col(column).cast("double"))
    fitted = Q.medians(df, [column])
    return df.fillna({column: fitted[column]}) if column in fitted else df


def pearson(a: Column, b: Column) -> Column:
    """Correlation aggregate that is NULL for a constant column, where ``corr`` divides by zero; NaN is missing."""
    a, b = number(a), number(b)
    spreads = F.stddev_pop(F.when(b.isNotNull(), a)) * F.stddev_pop(F.when(a.isNotNull(), b))
    return F.try_divide(F.covar_pop(a, b), spreads)


def is_wide(columns: list[str]) -> bool:
    """Too many column pairs for one aggregate each."""
    return len(columns) * (len(columns) - 1) // 2 > MAX_PAIR_AGGREGATES


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every column pair, upper triangle, nulls skipped pairwise (VIZ-9).

    Few columns are one aggregation; wide tables add up small matrices, one pair of column blocks at a time.
    """
    if is_wide(columns):
        return wide_correlations(df, columns).filter("_a < _b").drop("_a", "_b")
    pairs = list(combinations(columns, 2))
    one = df.agg(*[pearson(F.col(a), F.col(b)).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"_{i}").alias("correlation"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return one.select(F.explode(rows).alias("_r")).select("_r.*")


def _matrices(batches: Iterator[pa.RecordBatch], values: int) -> Iterator[np.ndarray]:
    """Rows of the batches as matrices of about ``values`` numbers."""
    held, size = [], 0
    for batch in batches:
        step = max(1, values // batch.num_columns)
        for part in (batch.slice(start, step) for start in range(0, batch.num_rows, step)):
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in part.columns])
            held.append(x)
            size += x.size
            if size >= values:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def wide_correlations(
    df: DataFrame, columns: list[str], block: int | None = None, held_pairs: int | None = None, values: int | None = None
) -> DataFrame:
    """``_a, _b, feature_a, feature_b, correlation`` with ``_a <= _b``, the columns' places, for any number of columns.

    Products are taken for one pair of column blocks at a time, shifted by the column means so that nothing cancels. A
    task keeps its sums while all pairs are at most ``held_pairs``; beyond that it holds ``values`` numbers of the table
    and one pair of blocks, hands the block's sums on and lets Spark add them up, on both sides of the shuffle. Means
    and names, one per column, are what the driver sees. The diagonal is 1, or NULL for a constant column.
    """
    block, values = block or BLOCK_COLUMNS, values or HELD_VALUES
    held_pairs = HELD_PAIRS if held_pairs is None else held_pairs
    spark, width = df.sparkSession, len(columns)
    wide = df.select(*[number(F.col(c)).alias(f"c{i}") for i, c in enumerate(columns)])

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(width), np.zeros(width)
        for x in _matrices(batches, values):
            n += (~np.isnan(x)).sum(axis=0)
            total += np.nansum(x, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(n), pa.array(total)], names=["c", "n", "s"])

    found = wide.mapInArrow(totals, "c int, n double, s double").groupBy("c").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    means = np.zeros(width)
    for r in found.collect():
        means[r["c"]] = r["s"] / r["n"] if r["n"] else 0.0
    starts = range(0, width, block)
    blocks = [(i, j) for i in starts for j in starts if i <= j]

    def products(x: np.ndarray, i: int, j: int) -> np.ndarray:
        a, b = x[:, i : i + block], x[:, j : j + block]
        in_a, in_b = ~np.isnan(a), ~np.isnan(b)
        a, b = np.where(in_a, a - means[i : i + block], 0.0), np.where(in_b, b - means[j : j + block], 0.0)
        in_a, in_b = in_a.astype(float), in_b.astype(float)
        return np.array([in_a.T @ in_b, a.T @ in_b, in_a.T @ b, (a * a).T @ in_b, in_a.T @ (b * b), a.T @ b])

    def rows(sums: np.ndarray, i: int, j: int) -> pa.RecordBatch:
        first, second = np.meshgrid(np.arange(i, i + sums.shape[1]), np.arange(j, j + sums.shape[2]), indexing="ij")
        keep = first <= second
        places = [pa.array(side[keep], pa.int32()) for side in (first, second)]
        return pa.RecordBatch.from_arrays([*places, *[pa.array(m[keep]) for m in sums]], names=["_a", "_b", *PAIR_SUMS])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}
        for x in _matrices(batches, values):
            for i, j in blocks:
                if width * width > 2 * held_pairs:
                    yield rows(products(x, i, j), i, j)
                else:
                    kept[i, j] = kept.get((i, j), 0.0) + products(x, i, j)
        for (i, j), total in kept.items():
            yield rows(total, i, j)

    schema = "_a int, _b int, " + ", ".join(f"{c} double" for c in PAIR_SUMS)
    summed = wide.mapInArrow(sums, schema).groupBy("_a", "_b").agg(*[F.sum(c).alias(c) for c in PAIR_SUMS])
    # Below the noise a spread is the rounding error of the mean, so the column is constant.
    known = [(i, c, float((abs(m) * 1e-15) ** 2)) for i, (c, m) in enumerate(zip(columns, means, strict=True))]
    sides = [
        F.broadcast(spark.createDataFrame(known, f"{at} int, {name} string, {noise} double"))
        for at, name, noise in (("_a", "feature_a", "_noise_x"), ("_b", "feature_b", "_noise_y"))
    ]

    def spread(a: str) -> Column:
        s = F.col("n") * F.col(a + a) - F.col(a) * F.col(a)
        return F.when(s > F.col("n") * F.col("n") * F.col(f"_noise_{a}"), s)

    cov = F.col("n") * F.col("xy") - F.col("x") * F.col("y")
    shared = F.try_divide(cov, F.sqrt(spread("x")) * F.sqrt(spread("y")))
    value = F.when(F.col("_a") < F.col("_b"), shared).otherwise(F.when(spread("x").isNotNull(), 1.0))
    return summed.join(sides[0], "_a").join(sides[1], "_b").select("_a", "_b", "feature_a", "feature_b", value.alias("correlation"))


def correlated_pairs(df: DataFrame, columns: list[str], threshold: float) -> DataFrame:
    """Pairs whose absolute correlation is strictly above the threshold (TB-5)."""
    return correlations(df, columns).filter(F.abs("correlation") > threshold)


def cohort_retention(df: DataFrame, user: str, ts: str) -> DataFrame:
    """Long form (TB-6): ``cohort`` (yyyy-MM), ``month_offset``, ``users``, ``retention_pct``.

    (user, month) is made distinct first; later steps see months, not transactions.
    """
    months = df.select(user, F.trunc(F.col(ts).cast("date"), "month").alias("_m")).distinct()
    first = months.withColumn("_c", F.min("_m").over(Window.partitionBy(user)))
    offset = F.months_between("_m", "_c").cast("int")
    sized = first.groupBy("_c", offset.alias("month_offset")).agg(F.count(F.lit(1)).alias("users"))
    cohort = F.max(F.when(F.col("month_offset") == 0, F.col("users"))).over(Window.partitionBy("_c"))
    return sized.select(
        F.date_format("_c", "yyyy-MM").alias("cohort"),
        "month_offset",
        "users",
        (F.col("users") * 100.0 / cohort).alias("retention_pct"),
    )


def retention_pivot(df: DataFrame, user: str, ts: str, months: int) -> DataFrame:
    """Cohort rows by month-offset columns 0…months, null where nobody came back."""
    long = cohort_retention(df, user, ts)
    return long.groupBy("cohort").pivot("month_offset", list(range(months + 1))).agg(F.first("retention_pct"))


def reverse_words(c: Column) -> Column:
    """Words in reverse order, one space between (TB-7)."""
    return F.array_join(F.reverse(T.words(c)), " ")


def anagram_starts(text: Column, pattern: Column) -> Column:
    """0-based starts of windows that are a permutation of the pattern (TB-8).

    The text becomes an array of letters once, as a substring would walk the text from its start every time.
    A window is sorted only when both its ends are letters of the pattern.
    """
    width = F.length(pattern)
    last = F.length(text) - width

    def matches(b: Column) -> Column:
        chars, letters = b["chars"], b["letters"]
        return F.filter(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.array_contains(letters, F.get(chars, i))
            & F.array_contains(letters, F.get(chars, i + width - 1))
            & (F.sort_array(F.slice(chars, i + 1, width)) == letters),
        )

    both = F.struct(F.split(text, "").alias("chars"), F.sort_array(F.split(pattern, "")).alias("letters"))
    starts = let(both, matches)
    return F.when((last >= 0) & (width > 0), starts).otherwise(F.array().cast("array<int>"))


def merge_sorted(frames: list[DataFrame], value: str, ties: list[str]) -> DataFrame:
    """One ascending set of k sorted sets, duplicates kept (TB-9). Sets that lie in one table are given as one frame.

    The range sort takes the tie columns as well, so a value held by many rows is split over tasks.
    """
    return reduce(DataFrame.unionByName, frames).orderBy(value, *ties)


def merge_lists(lists: Column) -> Column:
    """Per-row form of TB-9 for an array of sorted arrays."""
    return F.sort_array(F.flatten(lists))


def second_highest(df: DataFrame, value: str, alias: str = "second_highest") -> DataFrame:
    """Second-highest distinct value, NULL when there is none (TB-10).

    Both steps are aggregates with map-side combine; the top value comes in as a scalar subquery.
    """
    top = df.agg(F.max(value))
    return df.filter(F.col(value) < top.scalar()).agg(F.max(value).alias(alias))


def filtered_groups(df: DataFrame, where: Column, group: str, agg: Column, having: Column) -> DataFrame:
    """Row filter, grouping, group filter (TB-11)."""
    return df.filter(where).groupBy(group).agg(agg).filter(having)


def group_average(df: DataFrame, group: str, value: str, alias: str) -> DataFrame:
    """Average by group (TB-12)."""
    return df.groupBy(group).agg(F.avg(value).alias(alias))


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def class_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support per class (TB-13); 0 where a denominator is 0.

    Everything after the first count works on the confusion table, whose size is the number of class pairs.
    """
    table = confusion(df, label, prediction)
    marks = table.select(
        F.explode(
            F.array(
                F.struct(F.col("label").alias("class"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("said"),
                         F.when(F.col("label").eqNullSafe(F.col("prediction")), F.col("n")).otherwise(0).alias("hit")),
                F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("actual"),
                         F.col("n").alias("said"), F.lit(0).cast("bigint").alias("hit")),
            )
        ).alias("_m")
    ).select("_m.*").filter(F.col("class").isNotNull())
    per = marks.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("actual", "said", "hit")])

    def ratio(a, b):
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))

    p, r = ratio("hit", "said"), ratio("hit", "actual")
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return per.select("class", p.alias("precision"), r.alias("recall"), f1.alias("f1"), F.col("actual").alias("support"))


def is_palindrome(c: Column) -> Column:
    """Ignoring case and whitespace (TB-14)."""
    flat = F.regexp_replace(F.lower(c), f"(?U){T.BLANK}+", "")
    return F.reverse(flat) == flat
