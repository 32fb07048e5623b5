"""Arithmetic on vectors held as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(v: Column) -> Column:
    """The vector over its length; a zero vector stays as it is, so its cosines are 0.

    The length is the argument of a lambda, so that it is computed once, and not again for each place.
    """
    d = doubles(v)
    return F.get(F.transform(F.array(norm(d)), lambda n: F.when(n > 0, F.transform(d, lambda x: x / n)).otherwise(d)), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two label sets; the union counts as 1 at least."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
