"""Statistics as columns over moment sums, with the behaviour at degenerate input in the name.

Bare ``corr`` fails on constant columns in ANSI mode, so correlations are made from sums.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def moments(x: Column, y: Column) -> list[Column]:
    """Aggregates n, sx, sy, sxx, syy, sxy and apart (the largest difference)."""
    return [
        F.count(x).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"),
        F.sum(x * y).alias("sxy"), F.max(F.abs(x - y)).alias("apart"),
    ]


def _ratio() -> Column:
    n = F.col("n")
    over = n * F.col("sxy") - F.col("sx") * F.col("sy")
    left, right = n * F.col("sxx") - F.col("sx") * F.col("sx"), n * F.col("syy") - F.col("sy") * F.col("sy")
    # the relative bound keeps rounding of constant columns from counting as variance
    varies = (left > 1e-9 * F.greatest(n * F.col("sxx"), F.lit(1e-300))) & (right > 1e-9 * F.greatest(n * F.col("syy"), F.lit(1e-300)))
    return F.when(varies, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), over / F.sqrt(F.when(varies, left * right).otherwise(1.0)))))


def pearson_zero() -> Column:
    """0 for no rows or a constant side."""
    return F.coalesce(_ratio(), F.lit(0.0))


def pearson_equal1() -> Column:
    """1 for no rows, and for a constant side if both sides are equal, else 0."""
    return F.when(F.col("n") == 0, F.lit(1.0)).otherwise(F.coalesce(_ratio(), F.when(F.coalesce(F.col("apart"), F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.lit(0.0))))


def pearson_null() -> Column:
    """Null for fewer than two rows or a constant side."""
    return F.when(F.col("n") >= 2, _ratio())


def cosine_equal1() -> Column:
    """1 if both sides are all zero, 0 if one is."""
    size = F.sqrt(F.col("sxx") * F.col("syy"))
    return F.when((F.col("sxx") == 0) & (F.col("syy") == 0), F.lit(1.0)).when(size == 0, F.lit(0.0)).otherwise(F.try_divide(F.col("sxy"), size))


def safe_fraction(top: Column, bottom: Column) -> Column:
    """0 if the denominator is not positive."""
    return F.when(bottom > 0, F.try_divide(top, bottom)).otherwise(F.lit(0.0))


def stable_id(*parts: Column) -> Column:
    """24 hexadecimal digits of the SHA-256 of the parts joined with 0x1f."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 24)


def hamming(a: Column, b: Column) -> Column:
    """Number of differing places of equally long texts; null otherwise."""
    differ = F.filter(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    return F.when(F.length(a) == F.length(b), F.size(differ))
