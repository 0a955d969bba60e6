"""Vector arithmetic on array<double> columns; all of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def squared_distance(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)))


def minus(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a - b)


def normalized(x: Column) -> Column:
    """Unit vector; a zero vector gives NaN in every place."""
    return F.transform(x, lambda v: F.when(norm(x) == 0, F.lit(float("nan"))).otherwise(v / norm(x)))


def minmax(x: Column) -> Column:
    """Scaled to [0, 1] by its own extremes; a flat vector gives NaN in every place."""
    low, width = F.array_min(x), F.array_max(x) - F.array_min(x)
    return F.transform(x, lambda v: F.when(width == 0, F.lit(float("nan"))).otherwise((v - low) / width))


def gaussian(d2: Column, sigma: float) -> Column:
    """exp(-d2 / sigma^2), without the factor of two."""
    return F.exp(-d2 / F.lit(sigma * sigma))


def decay(d: Column, sigma: float) -> Column:
    return F.exp(-d / F.lit(sigma))


def logarithms(x: Column) -> Column:
    """Natural logarithm of each element."""
    return F.transform(x, lambda v: F.ln(v))


def rounded(x: Column, places: int = 6) -> Column:
    """Each element to so many decimals, halves away from zero; what rounds to zero keeps its sign, as in floating-point arithmetic."""
    unit = float(10**places)
    return F.transform(x, lambda v: F.signum(v) * (F.round(F.abs(v) * unit) / unit))


def round_away(x: Column) -> Column:
    """To the nearest integer, halves away from zero: places of updated clusters."""
    return F.round(x).cast("int")


def round_even(x: Column) -> Column:
    """To the nearest integer, halves to the even one: offsets of split and merged clusters."""
    return F.bround(x).cast("int")


def truncated(x: Column) -> Column:
    """Towards zero: grid steps and colours."""
    return x.cast("int")
