"""What the corpus operators share: words, hashes to uniforms, and the core's stage tables and components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.operators.graph import components
from sylva.stages import free, shared_dir, short_shuffles, small_or_shuffled, stage_path, stage_table

__all__ = ["components", "free", "shared_dir", "short_shuffles", "small_or_shuffled", "stage_path", "stage_table"]

#: The six ASCII separators, as a Java character class, and as characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

def let(value: Column, body) -> Column:
    """body(value) with value computed once: what stands in a lambda would otherwise be computed in each of its rounds."""
    return F.get(F.transform(F.array(value), body), 0)


def where_late(df: DataFrame, condition: str) -> DataFrame:
    """df.where(condition), evaluated above the projections of df.

    Pushed below a chain of projections a condition takes in every expression of the chain, each as often as it is
    used, and the plan explodes; a filter does not pass a projection that holds the number of the partition.
    """
    return df.withColumn("_at", F.spark_partition_id()).where(f"({condition}) and _at >= 0").drop("_at")


def words(text: Column) -> Column:
    """The words of a text, split at ASCII white space; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_CLASS + "+"))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def uniform(*keys: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on keys and seed only."""
    return (F.shiftrightunsigned(F.xxhash64(*keys, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
