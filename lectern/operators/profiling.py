"""Chart data and column profiles (VIZ-*)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from lectern.functions.bounded import broadcast_if_small
from lectern.functions.numbers import number
from lectern.functions.rounding import fixed
from lectern.operators import quantiles as Q


def pair(df: DataFrame, x: str, y: str) -> DataFrame:
    """Two columns, rows with a null in either removed (VIZ-1); also the scatter rows (VIZ-5)."""
    return df.select(x, y).dropna()


def is_numeric(df: DataFrame, column: str) -> bool:
    """Numbers and booleans count as numeric (VIZ-2)."""
    return isinstance(df.schema[column].dataType, (t.NumericType, t.BooleanType))


def group_mean(df: DataFrame, x: str, y: str) -> DataFrame:
    """Mean of y by x, ordered by x (VIZ-3)."""
    return pair(df, x, y).groupBy(x).agg(F.avg(F.col(y).cast("double")).alias(y)).orderBy(x)


def group_count(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows by (x, y) in ``Count`` (VIZ-4)."""
    return pair(df, x, y).groupBy(x, y).agg(F.count(F.lit(1)).alias("Count")).orderBy(x, y)


def chart_data(df: DataFrame, x: str, y: str, chart: str) -> DataFrame:
    """Rows behind a bar, line, area or scatter chart."""
    if chart == "scatter":
        return pair(df, x, y)
    if chart not in ("bar", "line", "area"):
        raise ValueError(f"unknown chart {chart}")
    return group_mean(df, x, y) if is_numeric(df, y) else group_count(df, x, y)


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, min, max and sample deviation, nulls and NaNs skipped, all columns in one pass (VIZ-6)."""
    stats = {"mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp}
    one = df.agg(*[fn(number(F.col(c))).alias(f"{c}__{s}") for c in columns for s, fn in stats.items()])
    rows = F.array(
        *[F.struct(F.lit(c).alias("column"), *[F.col(f"{c}__{s}").alias(s) for s in stats]) for c in columns]
    )
    return one.select(F.explode(rows).alias("_r")).select("_r.*")


def categorical_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct non-null values, the commonest one and its frequency per column (VIZ-7); ties: smallest value.

    Values are counted first with map-side combine; the per-column step then merges one partial row per task.
    An empty column gives 0, "N/A", 0.
    """
    return counts_profile(value_counts(df, columns))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, value, n``: how often each column holds each value; null has a row and counts 0."""
    return Q.unpivot(df, columns, dtype="string").groupBy("column", "value").agg(F.count("value").alias("n"))


def counts_profile(counted: DataFrame) -> DataFrame:
    """The profile of ``categorical_profile`` from ``value_counts``."""
    seen = F.when(F.col("value").isNotNull(), F.struct((-F.col("n")).alias("o"), "value"))
    return counted.groupBy("column").agg(
        F.count("value").alias("unique_count"),
        F.coalesce(F.min_by("value", seen), F.lit("N/A")).alias("most_common"),
        F.coalesce(F.max("n"), F.lit(0)).cast("bigint").alias("most_common_frequency"),
    )


# Sentences of the chart description.
DESCRIBE_HEAD = "This **%s** visualizes the distribution and mapping between the independent variable **%s** on the X-axis and the dependent variable **%s** on the Y-axis.\n\n"
DESCRIBE_MEANS = "Statistical insights show that **%s** has a mean of `%s` and **%s** has a mean of `%s`. "
DESCRIBE_UNIQUE = "**%s** contains `%d` unique categories. "
DESCRIBE_TAIL = "This visualization helps students inspect how **%s** correlates or trends with **%s**. Analyzing such charts is a vital Exploratory Data Analysis (EDA) step to identify patterns, skewed features, and variance distribution before feeding variables into downstream machine learning models."


def describe(
    chart: Column, x: Column, y: Column,
    x_mean: Column, y_mean: Column, x_unique: Column, y_unique: Column,
) -> Column:
    """Chart description (VIZ-8): both means when both are known, else the unique counts that are."""
    means = F.format_string(DESCRIBE_MEANS, x, fixed(x_mean, 2), y, fixed(y_mean, 2))
    uniques = F.concat(
        F.when(x_unique.isNotNull(), F.format_string(DESCRIBE_UNIQUE, x, x_unique)).otherwise(""),
        F.when(y_unique.isNotNull(), F.format_string(DESCRIBE_UNIQUE, y, y_unique)).otherwise(""),
    )
    return F.concat(
        F.format_string(DESCRIBE_HEAD, chart, x, y),
        F.when(x_mean.isNotNull() & y_mean.isNotNull(), means).otherwise(uniques),
        F.format_string(DESCRIBE_TAIL, y, x),
    )


def profile(df: DataFrame, numeric_columns: list[str], categorical_columns: list[str]) -> DataFrame:
    """Both profiles as one long table with nulls where a statistic does not apply."""
    parts = []
    if numeric_columns:
        parts.append(numeric_profile(df, numeric_columns))
    if categorical_columns:
        parts.append(categorical_profile(df, categorical_columns))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Full symmetric Pearson matrix in long form, nulls skipped pairwise, NULL for a constant column (VIZ-9)."""
    from lectern.operators.relational import correlations, is_wide, wide_correlations

    wide = is_wide(columns)
    full = wide_correlations(df, columns) if wide else correlations(df, columns)
    both = F.array(
        F.struct("feature_a", "feature_b", "correlation"),
        F.struct(F.col("feature_b").alias("feature_a"), F.col("feature_a").alias("feature_b"), "correlation"),
    )
    if wide:
        # The diagonal stays one row.
        both = F.when(F.col("_a") == F.col("_b"), F.slice(both, 1, 1)).otherwise(both)
        return full.select(F.explode(both).alias("_r")).select("_r.*")
    off = full.select(F.explode(both).alias("_r")).select("_r.*")
    present = df.agg(*[F.stddev_pop(number(F.col(c))).alias(c) for c in columns])
    diagonal = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature_a"), F.lit(c).alias("feature_b"),
                F.when(F.col(c) > 0, F.lit(1.0)).alias("correlation"),
            )
            for c in columns
        ]
    )
    return off.unionByName(present.select(F.explode(diagonal).alias("_r")).select("_r.*"))


def box_summary(df: DataFrame, group: str, value: str) -> DataFrame:
    """Min, quartiles, max, 1.5·IQR fences and outlier count per group (VIZ-10), exact at any group size."""
    clean = pair(df, group, value).withColumn(value, F.col(value).cast("double"))
    long = Q.exact_quantiles(clean, [group], value, [0.25, 0.5, 0.75])
    quartiles = long.groupBy(group).agg(
        *[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    )
    iqr = F.col("q3") - F.col("q1")
    fenced = broadcast_if_small(
        quartiles.withColumn("lower_fence", F.col("q1") - 1.5 * iqr).withColumn("upper_fence", F.col("q3") + 1.5 * iqr)
    )
    outside = (F.col(value) < F.col("lower_fence")) | (F.col(value) > F.col("upper_fence"))
    return clean.join(fenced, group).groupBy(group, "q1", "median", "q3", "lower_fence", "upper_fence").agg(
        F.min(value).alias("min"), F.max(value).alias("max"), F.count_if(outside).alias("outliers")
    )


def histogram(df: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """Equal-width bins per numeric column (VIZ-11): ``column``, ``bin`` (1…bins), edges, ``n``.

    The top edge belongs to the last bin; a constant column has one bin; nulls and NaNs are in none.
    """
    long = Q.unpivot(df, columns).filter(F.col("value").isNotNull())
    edges = broadcast_if_small(long.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi")))
    width = (F.col("hi") - F.col("lo")) / bins
    index = F.when(F.col("hi") == F.col("lo"), F.lit(1)).otherwise(
        F.least(F.floor((F.col("value") - F.col("lo")) / F.nullif(width, F.lit(0.0))).cast("int") + 1, F.lit(bins))
    )
    counted = (
        long.join(edges, "column").groupBy("column", "lo", "hi", index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.select(
        "column", "bin", (F.col("lo") + (F.col("bin") - 1) * width).alias("left_edge"),
        (F.col("lo") + F.col("bin") * width).alias("right_edge"), "n",
    )


def scatter_grid(df: DataFrame, columns: list[str], bins: int = 50) -> DataFrame:
    """Counts on a grid of ``bins`` by ``bins`` cells for every column pair: the scatter plots of tables of any size.

    ``x_column, y_column, x_bin, y_bin, n`` (VIZ-5, VIZ-12); bins as in ``histogram``, numbered from 1. At most
    ``bins`` squared rows per pair come out. A row with a null or NaN in a pair is left out of that pair.
    """
    values = {c: number(F.col(c)) for c in columns}
    edges = df.agg(*[f(v).alias(f"{n}{i}") for i, v in enumerate(values.values()) for n, f in (("lo", F.min), ("hi", F.max))])
    row = edges.first()

    def bin_of(i: int, value: Column) -> Column:
        lo, hi = row[f"lo{i}"], row[f"hi{i}"]
        if lo is None or lo == hi:
            return F.when(value.isNotNull(), 1)
        width = (F.lit(hi) - F.lit(lo)) / bins
        return F.least(F.floor((value - F.lit(lo)) / width).cast("int") + 1, F.lit(bins))

    binned = {c: bin_of(i, v) for i, (c, v) in enumerate(values.items())}
    cells = F.array(
        *[
            F.struct(F.lit(a).alias("x_column"), F.lit(b).alias("y_column"), binned[a].alias("x_bin"), binned[b].alias("y_bin"))
            for a, b in combinations(columns, 2)
        ]
    )
    long = df.select(F.explode(cells).alias("_c")).select("_c.*").filter("x_bin is not null and y_bin is not null")
    return long.groupBy("x_column", "y_column", "x_bin", "y_bin").agg(F.count(F.lit(1)).alias("n"))


def scatter_matrix(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Long table of (x, y) points for every column pair (VIZ-12); rows with a null in the pair are left out."""
    points = F.array(
        *[
            F.struct(
                F.lit(a).alias("x_column"), F.lit(b).alias("y_column"),
                number(F.col(a)).alias("x"), number(F.col(b)).alias("y"),
            )
            for a, b in combinations(columns, 2)
        ]
    )
    return (
        df.select(*keys, F.explode(points).alias("_p"))
        .select(*keys, "_p.*")
        .filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    )
