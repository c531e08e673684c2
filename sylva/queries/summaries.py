"""Trees of summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylva.catalog import query, table
from sylva.operators import raptor


@query("summary_tree")
def summary_tree(spark, sf_dir):
    """Levels of summaries over the benchmark items, with the words of each."""
    texts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    out = None
    for depth, level in enumerate(raptor.build(texts)):
        rows = level.select(F.lit(depth).alias("depth"), "id", F.size(F.split("text", " ")).alias("words"))
        out = rows if out is None else out.unionByName(rows)
    return out
