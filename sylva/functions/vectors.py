"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; null where either is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def l2_normalize(a: Column) -> Column:
    """a over its norm, computed once per vector; a zero vector stays as it is."""
    return F.get(F.transform(F.array(F.coalesce(F.nullif(norm(a), F.lit(0.0)), F.lit(1.0))), lambda n: F.transform(a, lambda x: x.cast("double") / n)), 0)


def cosine_distance(similarity: Column) -> Column:
    return 1 - similarity


def cosine_score(similarity: Column) -> Column:
    """Similarity moved to 0..1."""
    return (similarity + 1) / 2


def yes_probability(yes: Column, no: Column) -> Column:
    """Two-class softmax of logits."""
    return 1 / (1 + F.exp(no - yes))
