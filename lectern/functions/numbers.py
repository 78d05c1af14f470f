"""Numbers as the statistics see them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    """The column as a double; NaN, which data written by pandas uses for missing, is null."""
    value = c.cast("double")
    return F.when(~F.isnan(value), value)
