"""Joins whose keys are missing in most rows, or are few."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.bounded import as_broadcast, broadcast_if_small

#: Rows of the bank, and rows that ask, of one key in one cell, when the rows of a key are dealt over several.
PART_ROWS = 2_000
SLICE_ROWS = 5_000
#: Pairs that one task should write, and the most tasks.
TASK_PAIRS = 5_000_000
MAX_TASKS = 20_000


def left_join_known(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Left join on a string key that most rows may lack: rows without it are spread over the tasks by a hash."""
    spread = F.concat(F.lit("\u0000"), F.xxhash64(*rows.columns).cast("string"))
    keyed = rows.withColumn("_join", F.coalesce(F.col(key), spread))
    return keyed.join(known.withColumnRenamed(key, "_join"), "_join", "left").drop("_join")


def join_few_keys(
    rows: DataFrame, bank: DataFrame, keys: list[str], max_rows: int | None = None, part_rows: int | None = None,
    slice_rows: int | None = None,
) -> DataFrame:
    """Join on keys of which there is a handful: the bank is broadcast when proven small.

    In a larger bank the pairs of a key are dealt over cells of at most some ``slice_rows`` rows times ``part_rows`` rows
    of the bank: a row goes to every part of its own key, a bank row to every slice. So no key is one task, rows of other
    keys are not copied, and the tasks follow the pairs to be written, not the bytes that are shuffled.
    """
    few = as_broadcast(bank) if max_rows is None else as_broadcast(bank, max_rows)
    if few is not None:
        return rows.join(few, keys)
    part_rows, slice_rows = part_rows or PART_ROWS, slice_rows or SLICE_ROWS
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).join(
        bank.groupBy(*keys).agg(F.count(F.lit(1)).alias("_items")), keys
    ).select(
        *keys, F.ceil(F.col("_rows") / slice_rows).cast("int").alias("_slices"),
        F.ceil(F.col("_items") / part_rows).cast("int").alias("_parts"),
        (F.col("_rows").cast("double") * F.col("_items")).alias("_pairs"),
    )
    sizes = broadcast_if_small(sizes)
    cells, pairs = sizes.agg(F.sum(F.col("_slices").cast("bigint") * F.col("_parts")), F.sum("_pairs")).first()
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A number given to ``repartition`` stays: the planner would join cells by their bytes, which say little here.
    tasks = min(cells or 1, max(least, math.ceil((pairs or 0) / TASK_PAIRS)), MAX_TASKS)

    def dealt(side: DataFrame, own: str, of: str, other: str, others: str) -> DataFrame:
        placed = side.join(sizes, keys).withColumn(own, F.pmod(F.xxhash64(*side.columns), F.col(of)).cast("int"))
        met = placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(others) - 1)))
        return met.drop("_slices", "_parts", "_pairs").repartition(tasks, *keys, "_slice", "_part")

    asked = dealt(rows, "_slice", "_slices", "_part", "_parts")
    items = dealt(bank, "_part", "_parts", "_slice", "_slices")
    # All pairs of a bank row follow one another, so a written file repeats its columns.
    pairs = items.hint("merge").join(asked, [*keys, "_slice", "_part"])
    return pairs.select(*keys, *[c for side in (rows, bank) for c in side.columns if c not in keys])
