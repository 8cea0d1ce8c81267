"""Rounding as the domain's rules do it: half to even, on the exact value of a double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column) -> Column:
    """To one decimal. 20 x is held as a sum of two doubles without error, so that a tie is told from a number that only
    prints like one: 6.25 gives 6.2, 2.35 (which is a little more) gives 2.4."""
    a, b = x * F.lit(16.0), x * F.lit(4.0)
    high = a + b
    rest = high - a
    low = (a - (high - rest)) + (b - rest)
    tenths = F.floor(high / F.lit(2.0))
    over = (high - (tenths * 2 + 1).cast("double")) + low
    whole = F.when(over > 0, tenths + 1).when(over < 0, tenths).otherwise(tenths + F.pmod(tenths, F.lit(2)))
    return whole.cast("double") / F.lit(10.0)


def whole(x: Column) -> Column:
    """To a whole number, as a double."""
    return F.rint(x)


def thousands_of(x: Column) -> Column:
    """An amount in thousands."""
    return x / F.lit(1000.0)
