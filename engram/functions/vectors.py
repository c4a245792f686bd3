"""Vector expressions over array<float>, accumulated in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """array<double> of length one; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different length, without length or of length zero."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), F.try_divide(dot(a, b), n)).otherwise(F.lit(0.0))


def distance_score(d: Column) -> Column:
    """Score of a Euclidean distance between unit vectors: their cosine, not below 0."""
    return F.greatest(F.lit(0.0), 1 - d * d / 2)
