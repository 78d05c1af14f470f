"""Row positions over one global order without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import ranges
from lectern.functions.bounded import broadcast_if_small
from lectern.session import cut

ROWS_PER_BUCKET = 1_000_000


def positions(
    df: DataFrame,
    groups: list[str],
    order: str,
    position: str = "position",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Adds the 0-based position of each row in its group, ordered by the numeric key ``order``, null keys first.

    The key range is cut at approximate quantiles into buckets of about ``rows_per_bucket`` rows. Rows are numbered
    inside (group, bucket) and shifted by the group's row count in the buckets before. Rows of equal keys share a
    bucket; their order among themselves is not fixed. Null groups are groups.
    """
    kind = df.schema[order].dataType.simpleString()
    size = df.agg(F.count(F.lit(1))).first()[0]
    cuts = ranges.cut_points(df, F.col(order), -(-size // rows_per_bucket))
    bucketed = df.withColumn("_bucket", ranges.range_of(F.col(order), cuts, kind))
    inside = Window.partitionBy(*groups, "_bucket").orderBy(F.col(order).asc_nulls_first())
    numbered = bucketed.withColumn("_row", F.row_number().over(inside) - 1)
    own = [F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)]
    counts = bucketed.groupBy(*own, F.col("_bucket").alias("_b")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*[f"_g{i}" for i in range(len(groups))]).orderBy("_b")
    earlier = F.sum("_rows").over(before.rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.withColumn("_shift", F.coalesce(earlier, F.lit(0))).drop("_rows")
    same = F.col("_bucket") == F.col("_b")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    placed = numbered.join(shifts, same).withColumn(position, (F.col("_row") + F.col("_shift")).cast("bigint"))
    return placed.select(*df.columns, position)


def row_numbers(df: DataFrame, order: list[str], number: str) -> DataFrame:
    """Adds the 0-based place of each row in the order of any columns, nulls first, in a written table.

    The rows are sorted once, by range; the tasks' row counts, one row per task, shift the numbers. Rows of equal keys may
    lie in several ranges, so a hot key is not one task; their order among themselves is not fixed.
    """
    sort = df.withColumn("_any", F.monotonically_increasing_id()).orderBy(*order, "_any").drop("_any")
    tasks = cut(sort.withColumn("_id", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_id", 33)))
    counts = tasks.groupBy("_task").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = F.sum("_rows").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    shifts = broadcast_if_small(counts.select("_task", F.coalesce(earlier, F.lit(0)).alias("_shift")))
    # The number inside the task is in the lower 33 bits.
    inside = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return tasks.join(shifts, "_task").select(*df.columns, (inside + F.col("_shift")).alias(number))
