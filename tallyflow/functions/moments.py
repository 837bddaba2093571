"""Mean, standard deviation and outlier tests from exact sums.

n, the sum s and the sum of squares q of decimal amounts are exact, so the same rows give the same bits in any
partitioning, and amounts that are all equal have a deviation of exactly 0 and no outliers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sums(amount: Column) -> list[Column]:
    """Aggregates n, s and q; usable in a groupBy and over a window."""
    return [F.count(amount), F.sum(amount), F.sum(amount * amount)]


def _spread(n: Column, s: Column, q: Column) -> Column:
    """n*q - s*s in units of 1/10000, a whole number: exact while it fits 38 digits, in double beyond."""
    wide = n.cast("decimal(20,0)")
    exact = F.try_multiply(F.try_subtract(F.try_multiply(wide, q), F.try_multiply(s, s)), F.lit(10000))
    loose = (n.cast("double") * q.cast("double") - s.cast("double") * s.cast("double")) * F.lit(1e4)
    return F.greatest(F.coalesce(exact.cast("double"), loose), F.lit(0.0))


def mean(n: Column, s: Column) -> Column:
    return s.cast("double") / n


def sd_pop(n: Column, s: Column, q: Column) -> Column:
    return F.sqrt(_spread(n, s, q)) / (n * F.lit(100.0))


def sd_samp(n: Column, s: Column, q: Column) -> Column:
    """NULL below two values."""
    return F.when(n > 1, F.sqrt(_spread(n, s, q) / (n.cast("double") * (n - 1))) / F.lit(100.0))


def above(amount: Column, times: float, n: Column, s: Column, q: Column, sample: bool = False) -> Column:
    """amount > mean + times * sd, multiplied through by n so that the left side stays exact."""
    excess = ((n.cast("decimal(20,0)") * amount - s) * 100).cast("double")
    spread = _spread(n, s, q)
    if sample:
        spread = F.when(n > 1, spread * n / (n - 1))
    return excess > F.lit(float(times)) * F.sqrt(spread)
