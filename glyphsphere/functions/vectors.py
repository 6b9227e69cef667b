"""Column expressions over ``array<float>`` embeddings; all arithmetic in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dbl(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(dbl(a), dbl(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(dbl(a), dbl(b), lambda x, y: (x - y) * (x - y))))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(dbl(a), dbl(b), lambda x, y: x + y)


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(dbl(a), dbl(b), lambda x, y: x - y)


def analogy(positive: Column, negative: Column, query: Column) -> Column:
    """query + (positive - negative)."""
    return add(query, sub(positive, negative))


def normalize(a: Column) -> Column:
    n = norm(a)
    return F.transform(dbl(a), lambda x: x / n)


def truncate(a: Column, dims: int) -> Column:
    return F.slice(dbl(a), 1, dims)


def to_int8(a: Column) -> Column:
    """Components times 127, rounded half away from zero, within [-127, 127]."""
    return F.transform(dbl(a), lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x * 127).cast("int"))))
