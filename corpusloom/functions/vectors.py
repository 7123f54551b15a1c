"""Column expressions on vectors (arrays of numbers), accumulated in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product of two vectors of one length; null if either is null."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(a, a))


def usable(a: Column) -> Column:
    """Whether a vector has a direction: not null, no null or NaN or infinite part, not zero."""
    length = norm(a)
    sound = a.isNotNull() & ~F.exists(a, lambda x: x.isNull())
    return F.coalesce(sound & ~F.isnan(length) & (length > 0) & (length < float("inf")), F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector has no direction, as a missing vector is similar to nothing."""
    return F.when(usable(a) & usable(b), dot(a, b) / (norm(a) * norm(b))).otherwise(F.lit(0.0))
