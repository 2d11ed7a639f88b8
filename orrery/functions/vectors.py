"""Distances and scalar functions on dense vectors, as Spark columns.

Vectors are array<double>; sums run from left to right in double precision, so
that results are the same wherever they are computed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a norm is at least, where a zero vector must not be divided by zero.
EPSILON = 1e-30
METRICS = ("l2", "inner_product", "cosine")


def as_double(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def l2(a, b) -> Column:
    """Squared Euclidean distance."""
    return total(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)))


def dot(a, b) -> Column:
    return total(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def norm2(a) -> Column:
    return total(F.transform(as_double(a), lambda x: x * x))


def norm(a) -> Column:
    return F.sqrt(norm2(a))


def inner_product(a, b) -> Column:
    """The inner product as a distance: smaller is nearer."""
    return -dot(a, b)


def cosine(a, b) -> Column:
    """One less the cosine; 1 where either vector is zero."""
    both = norm(a) * norm(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(1.0 - dot(a, b) / both)


def fast_l2(a, b) -> Column:
    """Orders b as l2 does for one a: the norm of a is left out."""
    return norm2(b) - 2.0 * dot(a, b)


def distance(metric: str, a, b) -> Column:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")
    return {"l2": l2, "inner_product": inner_product, "cosine": cosine}[metric](a, b)


def scale(a, by: Column) -> Column:
    return F.transform(as_double(a), lambda x: x / by)


def normalise(a) -> Column:
    """a over its norm; a zero vector stays."""
    n = norm(a)
    return F.when(n == 0, as_double(a)).otherwise(scale(a, n))


def normalise_safely(a) -> Column:
    """a over its norm, which counts as EPSILON at least."""
    return scale(a, F.greatest(norm(a), F.lit(EPSILON)))


def normalised_cosine(a, b) -> Column:
    """Half the squared distance of the normalised vectors: one less the cosine, for vectors that aren't zero."""
    return l2(normalise(a), normalise(b)) / 2


def lift_base(a, max_norm: Column) -> Column:
    """One more dimension, so that nearest by l2 is largest by inner product: x / M and sqrt(max(0, 1 - |x|^2 / M^2))."""
    rest = F.sqrt(F.greatest(F.lit(0.0), 1.0 - norm2(a) / (max_norm * max_norm)))
    return F.concat(scale(a, max_norm), F.array(rest))


def lift_query(a) -> Column:
    return F.concat(normalise(a), F.array(F.lit(0.0)))


def add(a, b) -> Column:
    return F.zip_with(as_double(a), as_double(b), lambda x, y: x + y)


def subtract(a, b) -> Column:
    return F.zip_with(as_double(a), as_double(b), lambda x, y: x - y)
