"""Exact quantiles of groups of any size, without holding a group in one buffer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.bounded import broadcast_if_small
from lectern.functions.numbers import number
from lectern.session import cut

ACCURACY = 10_000
FINE_ACCURACY = 200_000
# Distinct values of one slice that one task may order, ranges that a longer slice is cut into, and rows (of up to that
# many numbers) up to which the cut points travel to all tasks.
SLICE_ROWS = 200_000
RANGES = 200
MAX_CUT_ROWS = 1_000


def exact_quantiles(
    df: DataFrame, groups: list[str], value: str, probs: list[float], accuracy: int = ACCURACY, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Linear-interpolated quantiles per group: ``groups``, ``prob``, ``quantile``; nulls are skipped.

    A sketch of bounded size brackets each quantile within a few parts in ``accuracy`` of the group's ranks. One more
    pass counts what lies below each bracket and keeps the distinct values inside it. Groups with at most ``accuracy``
    rows are kept whole. For the others the counts are verified: a bracket that misses its quantile is taken again over
    the group's whole range, and slices of more than ``slice_rows`` distinct values are cut into ranges of which only
    those around the quantile stay, until no task orders more than that.
    """
    if not groups:
        one = exact_quantiles(df.withColumn("_all", F.lit(0)), ["_all"], value, probs, accuracy, slice_rows)
        return one.drop("_all")
    values = df.select(*groups, number(F.col(value)).alias("_v")).filter(F.col("_v").isNotNull())
    slack = 3.0 / accuracy
    edges = [max(0.0, p - slack) for p in probs] + [min(1.0, p + slack) for p in probs]
    sketch = cut(
        values.groupBy(*groups).agg(
            F.count(F.lit(1)).alias("_n"),
            F.min("_v").alias("_min"),
            F.max("_v").alias("_max"),
            F.percentile_approx("_v", edges, accuracy).alias("_e"),
        )
    )
    tiny = F.col("_n") <= accuracy

    def bracket(i: int, p: float) -> Column:
        low, high = F.col("_e")[i], F.col("_e")[len(probs) + i]
        return F.struct(
            F.lit(p).alias("p"),
            F.when(tiny | F.lit(edges[i] <= 0.0), F.col("_min")).otherwise(low).alias("lo"),
            F.when(tiny | F.lit(edges[len(probs) + i] >= 1.0), F.col("_max")).otherwise(high).alias("hi"),
        )

    brackets = sketch.withColumn("_b", F.array(*[bracket(i, p) for i, p in enumerate(probs)]))
    large = brackets.filter(~tiny).select(*groups, "_n", "_b")
    if large.isEmpty():
        return _interpolated(_counted(values, brackets.select(*groups, "_n", "_b"), groups), groups)
    counted = cut(_counted(values, large, groups))
    missed = _missed(counted, groups)
    if not missed.isEmpty():
        whole = F.struct(F.col("prob").alias("p"), F.col("_min").alias("lo"), F.col("_max").alias("hi"))
        wide = missed.join(sketch, groups).groupBy(*groups, "_n").agg(F.collect_list(whole).alias("_b"))
        kept = counted.join(missed, [*groups, "prob"], "left_anti")
        counted = cut(kept.unionByName(_counted(values, wide, groups)))
    counted = _refined(counted, groups, slice_rows)
    small = _counted(values, brackets.filter(tiny).select(*groups, "_n", "_b"), groups)
    return _interpolated(small, groups).unionByName(_interpolated(counted, groups))


def _counted(values: DataFrame, brackets: DataFrame, groups: list[str]) -> DataFrame:
    """``groups, prob, _n, _v, _c``: distinct values inside each bracket with their counts.

    A null value stands for everything below the bracket and sorts first.
    """
    relevant = F.filter("_b", lambda b: F.col("_v") <= b["hi"])
    placed = (
        values.join(broadcast_if_small(brackets), groups)
        .select(*groups, "_n", "_v", F.explode(relevant).alias("_b"))
        .select(
            *groups, "_n", F.col("_b.p").alias("prob"),
            F.when(F.col("_v") >= F.col("_b.lo"), F.col("_v")).alias("_v"),
        )
    )
    return placed.groupBy(*groups, "prob", "_n", "_v").agg(F.count(F.lit(1)).alias("_c"))


def _target() -> Column:
    """Rank of a quantile, with a fraction between two ranks."""
    return F.col("prob") * (F.col("_n") - 1)


def _missed(counted: DataFrame, groups: list[str]) -> DataFrame:
    """``groups, prob`` of the brackets that do not hold both ranks around their quantile."""
    sums = counted.groupBy(*groups, "prob", "_n").agg(
        F.sum(F.when(F.col("_v").isNull(), F.col("_c")).otherwise(0)).alias("_below"), F.sum("_c").alias("_upto")
    )
    held = (F.floor(_target()) >= F.col("_below")) & (F.ceil(_target()) < F.col("_upto"))
    return sums.filter(~held).select(*groups, "prob")


def _refined(counted: DataFrame, groups: list[str], slice_rows: int) -> DataFrame:
    """The same slices with at most ``slice_rows`` values each, as far as they are not one range already.

    A slice above the bound is cut into ``RANGES`` ranges of about equal numbers of distinct values. The ranges' counts
    are added up, and the values of the two ranges that hold the ranks around the quantile stay. As the values of a
    slice are distinct, every round shortens it.
    """
    keys = [*groups, "prob"]
    # Two ranks may need two values.
    longest = max(slice_rows, 2)
    shares = [i / RANGES for i in range(1, RANGES)]
    while True:
        sizes = counted.groupBy(*keys).agg(F.count("_v").alias("_size")).filter(F.col("_size") > longest)
        if sizes.isEmpty():
            return counted
        cuts = counted.join(sizes, keys, "left_semi").groupBy(*keys).agg(
            F.percentile_approx("_v", shares, 20 * RANGES).alias("_cuts")
        )
        long = counted.join(broadcast_if_small(cuts, MAX_CUT_ROWS), keys)
        at = F.when(F.col("_v").isNull(), -1).otherwise(F.size(F.filter("_cuts", lambda c: c < F.col("_v"))))
        long = long.withColumn("_range", at).drop("_cuts")
        order = Window.partitionBy(*keys).orderBy("_range")
        ranges = long.groupBy(*keys, "_n", "_range").agg(F.sum("_c").alias("_rows"))
        ranges = ranges.withColumn("_upto", F.sum("_rows").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        # A range below the quantile's only adds to what lies below.
        stays = (F.col("_upto") > F.floor(_target())) & (F.col("_upto") - F.col("_rows") <= F.ceil(_target()))
        kept = ranges.filter(stays & (F.col("_range") >= 0)).select(*keys, "_range")
        below = ranges.filter(F.col("_upto") <= F.floor(_target())).groupBy(*keys, "_n").agg(F.sum("_rows").alias("_c"))
        narrow = long.join(broadcast_if_small(kept, MAX_CUT_ROWS), [*keys, "_range"]).select(*counted.columns)
        lower = below.withColumn("_v", F.lit(None).cast("double")).select(*counted.columns)
        counted = cut(counted.join(sizes, keys, "left_anti").unionByName(narrow).unionByName(lower))


def _interpolated(counted: DataFrame, groups: list[str]) -> DataFrame:
    w = Window.partitionBy(*groups, "prob").orderBy(F.asc_nulls_first("_v"))
    ranked = (
        counted.withColumn("_end", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_start", F.col("_end") - F.col("_c"))
        .withColumn("_pos", _target())
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_start")) & (rank < F.col("_end")), F.col("_v")))

    picked = ranked.groupBy(*groups, "prob").agg(
        at(F.floor("_pos")).alias("_a"), at(F.ceil("_pos")).alias("_z"), F.max("_pos").alias("_pos")
    )
    share = F.col("_pos") - F.floor("_pos")
    return picked.select(
        *groups, "prob", (F.col("_a") + (F.col("_z") - F.col("_a")) * share).alias("quantile")
    )


def unpivot(df: DataFrame, columns: list[str], keep: list[str] | None = None, dtype: str = "double") -> DataFrame:
    """Long form: ``keep``, ``column``, ``value``; a NaN among doubles is null."""
    values = {c: number(F.col(c)) if dtype == "double" else F.col(c).cast(dtype) for c in columns}
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), v.alias("value")) for c, v in values.items()])
    return df.select(*(keep or []), F.explode(pairs).alias("_p")).select(
        *(keep or []), F.col("_p.column").alias("column"), F.col("_p.value").alias("value")
    )


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact median per column as fitted scalars (one row per column reaches the driver)."""
    # A handful of groups: a finer sketch keeps the slice that one task orders to some millionths of the rows.
    found = exact_quantiles(unpivot(df, columns), ["column"], "value", [0.5], FINE_ACCURACY)
    return {r["column"]: r["quantile"] for r in found.collect()}
