"""Vector column expressions; all arithmetic in double, all JVM-side.

A null vector or two vectors of different length give a null score. A zero
vector gives cosine 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "dot")

# Scores are ranked on this many decimals, so that summation order, which
# differs between physical plans, never decides between equal similarities.
RANK_DIGITS = 12


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def check_metric(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"unknown similarity metric: {metric!r}")
    return metric


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: str | Column, b: str | Column) -> Column:
    a, b = col(a), col(b)
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), total(products))


def norm(a: str | Column) -> Column:
    squares = F.transform(col(a), lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(total(squares))


def cosine_from(dot_product: Column, norm_a: Column, norm_b: Column) -> Column:
    scale = norm_a * norm_b
    return F.when(scale == 0.0, F.lit(0.0)).otherwise(dot_product / scale)


def cosine(a: str | Column, b: str | Column) -> Column:
    return cosine_from(dot(a, b), norm(a), norm(b))


def similarity(a: str | Column, b: str | Column, metric: str = "cosine") -> Column:
    return {"cosine": cosine, "dot": dot}[check_metric(metric)](a, b)


def clamp01(score: Column) -> Column:
    """Limit to [0, 1]; null stays null."""
    return F.when(score.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))


def leading(vector: str | Column, n: int) -> Column:
    """The first ``n`` components."""
    return F.slice(col(vector), 1, n)


def rooted(vector: str | Column) -> Column:
    """Square root of every component, signs kept: large components weigh less in the cosine."""
    return F.transform(col(vector), lambda x: F.signum(x.cast("double")) * F.sqrt(F.abs(x.cast("double"))))


def absolute_similarity(a: str | Column, b: str | Column) -> Column:
    """1 minus the sum of absolute differences over the sum of absolute components; 0 for two zero vectors."""
    a, b = col(a), col(b)
    size = lambda v: total(F.transform(v, lambda x: F.abs(x.cast("double"))))
    apart = total(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    scale = size(a) + size(b)
    return F.when(F.size(a) == F.size(b), F.when(scale == 0.0, F.lit(0.0)).otherwise(1.0 - apart / scale))


def scaled_to_unit(vector: str | Column) -> Column:
    """Divide by the length; a zero vector stays as it is.

    The length is the element of an outer one-element array, so that it is
    computed once per vector and not once per component.
    """
    vector = col(vector)
    divisor = F.transform(F.array(norm(vector)), lambda n: F.when(n == 0.0, F.lit(1.0)).otherwise(n))
    return F.transform(divisor, lambda n: F.transform(vector, lambda x: x.cast("double") / n))[0]


def distance_to_similarity(distance: str | Column, kind: str = "cosine") -> Column:
    """Similarity of a distance reported by a vector index.

    ``cosine``: 1 - d. ``l2sq``: squared Euclidean distance of unit vectors,
    which is twice the cosine distance.
    """
    distance = col(distance)
    if kind == "cosine":
        return 1.0 - distance
    if kind == "l2sq":
        return 1.0 - distance / 2.0
    raise ValueError(f"unknown distance: {kind!r}")
