"""Ranges of a numeric key: cut points from the data, and the range a key falls in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.binding import let

FANOUT = 64


def numbers(values: list, kind: str) -> Column:
    """A literal array, made from one string, since a literal per number is slow to build."""
    if not values:
        return F.array().cast(f"array<{kind}>")
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def cut_points(df: DataFrame, key: Column, ranges: int) -> list:
    """At most ``ranges - 1`` keys, ascending, that cut the rows into about equal ranges; null keys do not count."""
    if ranges < 2:
        return []
    shares = numbers([i / ranges for i in range(1, ranges)], "double")
    found = df.agg(F.percentile_approx(key, shares, F.lit(10 * ranges + 1000))).first()[0]
    return sorted(set(found or []))


def range_of(key: Column, cuts: list, kind: str) -> Column:
    """How many cuts lie below the key, looked up in two steps; -1 for a null key."""
    known, coarse = numbers(cuts, kind), numbers(cuts[FANOUT - 1 :: FANOUT], kind)

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda c: c < key))

    at = let(below(coarse), lambda g: g * FANOUT + below(F.slice(known, g * FANOUT + 1, F.lit(FANOUT))))
    return F.when(key.isNull(), -1).otherwise(at)
