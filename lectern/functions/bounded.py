"""Broadcast only what is proven small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROWS = 10_000


def as_broadcast(df: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame | None:
    """The rows as a broadcast table when there are at most ``max_rows``, else None.

    The check reads at most ``max_rows + 1`` rows, and the small result is computed once. The planner's own
    choice rests on file sizes, which say little after an explode.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return None
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows as a broadcast table when they are few, else the frame to be joined by shuffling."""
    small = as_broadcast(df, max_rows)
    return df.hint("merge") if small is None else small
