"""Vector arithmetic as column expressions, in double precision. They run in the JVM; hot paths use the numpy kernels of the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product. Vectors of different lengths give null."""
    return _fold(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def l2sq(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return _fold(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    n = norm(v)
    return F.when(n == 0, doubles(v)).otherwise(F.transform(doubles(v), lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def argmin(values: Column) -> Column:
    """First place (from 0) of the least value; null for an empty array."""
    return F.array_position(values, F.array_min(values)).cast("int") - 1


def argmax(values: Column) -> Column:
    return F.array_position(values, F.array_max(values)).cast("int") - 1


def rounded(c: Column, digits: int = 6) -> Column:
    """For comparison across engines: rounded, and without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def rounded_by_product(c: Column, digits: int = 6) -> Column:
    """As rounded, by the product with a power of ten and not by decimals: 2.0339395 is just below a half and goes down."""
    scaled = c * 10.0**digits
    whole = F.when(F.abs(scaled) < 2.0**52, F.signum(c) * F.floor(F.abs(scaled) + 0.5)).otherwise(scaled)  # floor gives a long, and greater products have no fraction
    return F.when(F.abs(scaled) < float("inf"), whole / 10.0**digits).otherwise(c) + F.lit(0.0)
