"""Vector columns (array<double>)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_vector(c: Column) -> Column:
    return c.cast("array<double>")


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is missing, empty or zero, or the lengths differ."""
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(usable, dot(a, b) / (norm(a) * norm(b))).otherwise(F.lit(0.0))


def normalized(a: Column) -> Column:
    return F.when(norm(a) > 0, F.transform(a, lambda x: x / norm(a))).otherwise(a)


def taste(embedding: Column, liked: Column, disliked: Column) -> Column:
    """Nearness to what was liked less nearness to what was disliked; a missing centroid counts 0."""
    return cosine(embedding, liked) - cosine(embedding, disliked)


def advance(centroid: Column, count: Column, value: Column) -> Column:
    """The mean after one more value; an empty centroid or count starts anew."""
    moved = F.zip_with(centroid, value, lambda c, v: (c * count + v) / (count + 1))
    return F.when(centroid.isNull() | (F.size(centroid) == 0) | (count == 0), value).otherwise(moved)
