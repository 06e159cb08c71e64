"""Vector expressions over arrays of floats, summed in doubles in index order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def norm(v) -> Column:
    return F.sqrt(_sum(F.transform(col(v), lambda x: x.cast("double") * x.cast("double"))))


def dot(a, b) -> Column:
    """Over the shorter length of the two."""
    a, b = col(a), col(b)
    n = F.least(F.size(a), F.size(b))
    return _sum(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a, b, norm_a=None, norm_b=None) -> Column:
    """0 if either is the zero vector; norms may be given where they are kept."""
    na, nb = (norm(a) if norm_a is None else col(norm_a)), (norm(b) if norm_b is None else col(norm_b))
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))
