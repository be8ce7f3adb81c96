"""Vector expressions: cosine similarity and validity tests."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(left: Column, right: Column) -> Column:
    """Sum of products in index order."""
    return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def cosine(left: Column, right: Column) -> Column:
    """Cosine in [-1, 1]; 0 when a norm is 0; an error when the dimensions differ."""
    l, r = left.cast("array<double>"), right.cast("array<double>")
    norms = dot(l, l) * dot(r, r)
    value = F.when(norms == 0, F.lit(0.0)).otherwise(
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(l, r) / F.sqrt(norms)))
    )
    return F.when(
        F.size(left) != F.size(right), F.raise_error(F.lit("vector dimensions differ; rebuild the index"))
    ).otherwise(value)


def is_valid_vector(vector: Column, dimension: int) -> Column:
    """Non-null, of the expected dimension, every component finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) == dimension) & finite, F.lit(False))


def valid_similarity(value: Column) -> Column:
    """The similarity, or null when it is missing, not finite or outside [-1, 1]."""
    v = value.cast("double")
    return F.when(~F.isnan(v) & v.between(-1.0, 1.0), v)


def validated_threshold(value: float, name: str) -> float:
    """``value`` as a float: a number or its text, finite, and no boolean."""
    try:
        number = math.nan if isinstance(value, bool) else float(value)
    except (TypeError, ValueError):
        number = math.nan
    if not math.isfinite(number):
        raise ValueError(f"{name}: {value!r} is no finite number")
    return number


def threshold_pair(refuse_below: float, answer_from: float) -> tuple[float, float]:
    """Both evidence thresholds, checked to be finite and ordered."""
    lower = validated_threshold(refuse_below, "refuse_below")
    upper = validated_threshold(answer_from, "answer_from")
    if lower >= upper:
        raise ValueError("refuse_below must be less than answer_from")
    return lower, upper
