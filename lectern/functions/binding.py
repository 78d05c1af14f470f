"""Compute a value once per row and use it inside lambdas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    A column that occurs once in an expression is folded into it by the optimizer, even into a lambda, where
    it would run again for every array element. Bound as the element of a one-item array it runs once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(array: Column) -> Column:
    """The array itself, in a form to be exploded.

    Exploding a plain column makes the optimizer filter on its size first and push that filter down, where the
    expression behind the column is computed a second time.
    """
    return F.transform(array, lambda x: x)
