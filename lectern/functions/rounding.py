"""Half-even rounding of the binary value, as ``round`` and ``%.nf`` do it outside the JVM.

``F.round`` and ``F.bround`` look at the shortest decimal text of a double, so 7.35 (binary 7.3499…)
goes up there and must go down here. Near a tie the distance to the tie point is computed without
rounding error: ``2 * 10**digits`` is split into powers of two, each product with a power of two is
exact, and the partial sums cancel towards zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column, digits: int) -> Column:
    x = x.cast("double")
    a = F.abs(x)
    scale = 10**digits
    twice = 2 * scale
    powers = [1 << b for b in range(twice.bit_length() - 1, -1, -1) if twice >> b & 1]
    lower = F.floor(a * scale)
    gap = a * float(powers[0]) - (lower * 2 + 1).cast("double")
    for p in powers[1:]:
        gap = gap + a * float(p)
    even = lower % 2 == 0
    near_tie = F.abs(gap) < F.lit(1e-6)
    tied = F.when((gap > 0) | ((gap == 0) & ~even), lower + 1).otherwise(lower)
    rounded = F.when(near_tie, tied.cast("double") / float(scale)).otherwise(F.round(a, digits))
    return F.when(x < 0, -rounded).otherwise(rounded)


def fixed(x: Column, digits: int) -> Column:
    """Text with a fixed number of decimals."""
    return F.format_string(f"%.{digits}f", half_even(x, digits))


def percent(x: Column, digits: int = 1) -> Column:
    """Text of a ratio as a percentage."""
    return F.concat(fixed(x * 100.0, digits), F.lit("%"))
