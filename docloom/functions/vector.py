"""Vector functions over array columns, native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import col


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def dot(a: str | Column, b: str | Column) -> Column:
    return _sum(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: str | Column) -> Column:
    return F.sqrt(_sum(F.transform(col(a), lambda x: x.cast("double") * x.cast("double"))))


def cosine_similarity(a: str | Column, b: str | Column) -> Column:
    """0 where either norm is 0; vectors of different lengths are an error."""
    a, b = col(a), col(b)
    size = norm(a) * norm(b)
    same = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length")).cast("double"))
    return F.coalesce(same, F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size))


def euclidean_distance(a: str | Column, b: str | Column) -> Column:
    """Over the shorter length."""
    a, b = col(a), col(b)
    n = F.least(F.size(a), F.size(b))
    return F.sqrt(_sum(F.transform(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") - y.cast("double")), lambda d: d * d)))


def pearson(a: str | Column, b: str | Column) -> Column:
    """Null where either vector does not vary."""
    a, b = col(a), col(b)
    mean = lambda v: _sum(F.transform(v, lambda x: x.cast("double"))) / F.size(v)
    centred = lambda v: F.transform(v, lambda x: x.cast("double") - mean(v))
    x, y = centred(a), centred(b)
    size = norm(x) * norm(y)
    return F.when(size > 0, dot(x, y) / size)


def spearman(pairs: int | Column, squared_differences: Column) -> Column:
    """From the number of rank pairs and the sum of their squared differences; 0 for fewer than two pairs."""
    n = pairs if isinstance(pairs, Column) else F.lit(pairs)
    return F.when(n < 2, F.lit(0.0)).otherwise(1 - 6 * squared_differences / (n * (n * n - 1)).cast("double"))
