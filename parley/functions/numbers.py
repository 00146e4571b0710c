"""Rounding as Python does it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column, digits: int) -> Column:
    """``round(x, digits)`` of a double that is not huge: to the nearest, by the exact value of the double, ties to even.

    The product with the power of ten is taken with its rounding error, so a double just below or above a tie is seen
    for what it is. Null stays null.
    """
    power = 10.0**digits
    x = c.cast("double")
    product = x * power
    # the error of the product, from both factors split into halves of 26 bits
    split = 134217729.0
    hi = x * split - (x * split - x)
    lo = x - hi
    power_hi = power * split - (power * split - power)
    power_lo = power - power_hi
    error = ((hi * power_hi - product) + hi * power_lo + lo * power_hi) + lo * power_lo
    floor = F.floor(product).cast("double")
    tie = product - floor == 0.5
    exact_tie = F.when(error > 0, floor + 1).when(error < 0, floor).otherwise(F.rint(product))
    return F.when(tie, exact_tie).otherwise(F.rint(product)) / power
