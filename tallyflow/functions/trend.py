"""Least-squares line through values at x = 0, 1, ..., n-1, from exact sums.

With x known in advance the line needs only n, the sum of y and the sum of x*y. They are exact decimals, so a
flat series has a slope of exactly 0 and the same rows give the same line in any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def line_sums(x: Column, y: Column) -> list[Column]:
    """Aggregates n, sum(y) and sum(x*y)."""
    return [F.count(y), F.sum(y), F.sum(x * y)]


def _index_sums(n: Column) -> tuple[Column, Column, Column]:
    """Sum of x, sum of x squared, and the determinant n*sxx - sx*sx, NULL for a single point."""
    wide = n.cast("bigint")
    sx = (wide * (wide - 1)) / 2
    sxx = ((wide - 1) * wide * (wide * 2 - 1)) / 6
    return sx.cast("decimal(20,0)"), sxx.cast("decimal(20,0)"), F.nullif((wide * wide * (wide * wide - 1)) / 12, F.lit(0.0))


def _divide(numerator: Column, determinant: Column) -> Column:
    """In hundredths first: an integer, exact in double up to 2**53."""
    return (numerator * 100).cast("double") / (determinant * F.lit(100.0))


def slope(n: Column, sy: Column, sxy: Column) -> Column:
    sx, _, det = _index_sums(n)
    return _divide(n.cast("decimal(20,0)") * sxy - sx * sy, det)


def value_at(x: Column, n: Column, sy: Column, sxy: Column) -> Column:
    """The line at an integer x; the intercept is the line at 0."""
    sx, sxx, det = _index_sums(n)
    rise = n.cast("decimal(20,0)") * sxy - sx * sy
    return _divide(sy * sxx - sx * sxy + x.cast("decimal(20,0)") * rise, det)
