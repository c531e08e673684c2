"""Aggregates over scored answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accuracy_and_f1(rows: DataFrame, answerable: Column, answered: Column, score: str = "score") -> DataFrame:
    """One row: mean score, recall over answerable rows, precision over answered ones, and their harmonic mean."""
    hit = F.sum(F.when(answerable, F.col(score)))
    recall = hit / F.nullif(F.count(F.when(answerable, 1)), F.lit(0))
    precision = hit / F.nullif(F.count(F.when(answered, 1)), F.lit(0))
    out = rows.agg(F.avg(score).alias("accuracy"), recall.alias("recall"), precision.alias("precision"))
    f1 = F.coalesce(2 * F.col("recall") * F.col("precision") / F.nullif(F.col("recall") + F.col("precision"), F.lit(0.0)), F.lit(0.0))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns], F.round(f1, 6).alias("f1"))
