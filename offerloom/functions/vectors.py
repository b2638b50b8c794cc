"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    squares = F.aggregate(
        vector,
        F.lit(0.0),
        lambda total, x: total + x.cast("double") * x.cast("double"),
    )
    return F.sqrt(squares)


def same_length(left: Column, right: Column) -> Column:
    return (F.size(left) == F.size(right)) & (F.size(left) > 0)


def ratio_4dp(dot_product: Column, left_norm: Column, right_norm: Column) -> Column:
    """Cosine from its parts, rounded half-even to 4 places; a zero norm gives null."""
    return F.bround(F.try_divide(dot_product, left_norm * right_norm), 4)


def cosine_4dp(left: Column, right: Column, strict: bool = True) -> Column:
    """Cosine similarity of two vectors.

    Empty vectors or unequal lengths raise an error, or give null when not strict.
    """
    value = ratio_4dp(dot(left, right), norm(left), norm(right))
    checked = F.when(same_length(left, right), value)
    if strict:
        bad = left.isNotNull() & right.isNotNull() & ~same_length(left, right)
        message = F.lit("vectors must be non-empty and of equal length")
        checked = F.when(bad, F.raise_error(message).cast("double")).otherwise(checked)
    return checked


def normalise(vector: Column) -> Column:
    """Scale to unit length; a zero vector gives nulls."""
    length = norm(vector)
    return F.transform(vector, lambda x: F.try_divide(x.cast("double"), length))


def mean_vector(vectors: Column) -> Column:
    """Element-wise mean of an array of equally long vectors; empty gives null."""
    total = F.aggregate(
        F.slice(vectors, F.lit(2), F.greatest(F.size(vectors) - 1, F.lit(0))),
        F.transform(F.get(vectors, F.lit(0)), lambda x: x.cast("double")),
        lambda acc, vector: F.zip_with(acc, vector, lambda x, y: x + y.cast("double")),
    )
    return F.when(
        F.size(vectors) > 0, F.transform(total, lambda x: x / F.size(vectors).cast("double"))
    )


def weighted_score(role: Column, skills: Column, role_weight: Column) -> Column:
    return role * role_weight + skills * (F.lit(1.0) - role_weight)
