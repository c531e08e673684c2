"""Merging scores, skylines, cuts and other ordered selections."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.stages import stage_table


def merge_scores(lists: Sequence[DataFrame], key: str) -> DataFrame:
    """One row for each key in any of the lists (key, score); a list without it counts 0.0. Columns: score_0, score_1, ..."""
    named = [d.groupBy(key).agg(F.max("score").alias(f"score_{i}")) for i, d in enumerate(lists)]
    merged = reduce(lambda a, b: a.join(b, key, "full_outer"), named)
    return merged.select(key, *[F.coalesce(f"score_{i}", F.lit(0.0)).alias(f"score_{i}") for i in range(len(lists))])


def skyline_2d(rows: DataFrame, x: str, y: str, buckets: int = 256) -> DataFrame:
    """Rows that no other row dominates (at least as good in both, better in one); equal rows stay together.

    Without a pair of rows being compared: the best y of every distinct x, then a running best over falling x. Only rows
    that hold the best y of their x can stay, and these are thinned by the running best within ranges of x before the one
    ordered pass over what is left.
    """
    best = rows.groupBy(x).agg(F.max(y).alias("_y"))
    low, high = best.agg(F.min(x), F.max(x)).first()
    if low is None:
        return rows
    # Ranges of x that hold about as many rows each, so that an outlier does not put all rows in one.
    cuts = sorted(set(best.agg(F.percentile_approx(x, F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), F.lit(1000))).first()[0]))
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(x)))
    part = best.withColumn("_b", bucket)
    falling = lambda p: Window.partitionBy(*p).orderBy(F.desc(x)).rowsBetween(Window.unboundedPreceding, -1)
    part = part.where("_y is not null").withColumn("_m", F.max("_y").over(falling(["_b"]))).where("_m is null or _y > _m")
    tops = part.groupBy("_b").agg(F.max("_y").alias("_top"))  # `buckets` rows at most
    tops = tops.withColumn("_above", F.max("_top").over(Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)))
    front = part.join(F.broadcast(tops.select(F.col("_b").alias("_c"), "_above")), F.col("_b") == F.col("_c")).where("_above is null or _y > _above").select(F.col(x).alias("_x"), "_y")
    return rows.join(front, (F.col(x) == F.col("_x")) & (F.col(y) == F.col("_y")), "left_semi")


def skyline(rows: DataFrame, dims: Sequence[str]) -> DataFrame:
    """The skyline in any number of dimensions, all to be maximised.

    Every task first reduces its rows to their own skyline (rows sorted by falling sum can only be dominated by earlier
    ones); skylines of eight tasks at a time are then merged, up a tree.
    """
    if len(dims) == 2:
        return skyline_2d(rows, *dims)
    import numpy as np

    def local(frames):
        import pandas as pd

        front = None
        for frame in frames:
            frame = frame if front is None else pd.concat([front, frame], ignore_index=True)
            v = frame[list(dims)].to_numpy(float)
            keep: list[int] = []
            for i in np.argsort(-v.sum(1), kind="stable"):
                w = v[keep]
                if not len(keep) or not ((w >= v[i]).all(1) & (w > v[i]).any(1)).any():
                    keep.append(i)
            front = frame.iloc[sorted(keep)].reset_index(drop=True)
        if front is not None:
            yield front

    distinct = rows.select(*dims).distinct().na.drop()
    fronts = distinct.mapInPandas(local, distinct.schema)
    parts = max(1, fronts.rdd.getNumPartitions())
    while parts > 1:  # up a tree: each round merges the fronts of eight tasks
        parts = -(-parts // 8)
        fronts = stage_table(fronts, "fronts").coalesce(parts).mapInPandas(local, distinct.schema)
    named = fronts.select(*[F.col(d).alias(f"_{d}") for d in dims])
    return rows.join(named, reduce(lambda a, b: a & b, [F.col(d) == F.col(f"_{d}") for d in dims]), "left_semi")


def top(rows: DataFrame, score: str, key: str, k: int) -> DataFrame:
    return rows.orderBy(F.desc(score), key).limit(k)


def skyline_filter(merged: DataFrame, key: str, topk: int, text: str = "score_0", graph: str = "score_1", variant: str = "standard", best_of_each: int = 5) -> DataFrame:
    """Keys chosen from merged scores: the skyline, or what a variant asks for.

    wo_graph and wo_text take the topk of the other score. standard returns all where the graph's list, in which every
    node stands, be it with 0, is shorter than topk; else the skyline, and where that is smaller than topk the best of each
    score besides.
    """
    if variant == "wo_graph":
        return top(merged, text, key, topk).select(key)
    if variant == "wo_text":
        return top(merged, graph, key, topk).select(key)
    if merged.limit(topk).count() < topk:
        return merged.select(key)
    front = skyline_2d(merged, text, graph).select(key)
    if front.limit(topk).count() >= topk:
        return front
    return front.union(top(merged, text, key, best_of_each).select(key)).union(top(merged, graph, key, best_of_each).select(key)).distinct()


def gradient_cut(rows: DataFrame, group: str | list[str], score: str, key: str, g: float, least: int = 1) -> DataFrame:
    """The best rows of each group: the first `least`, then as long as a score is at least g times the one before."""
    order = Window.partitionBy(group).orderBy(F.desc(score), key)
    broken = (F.col("_rank") > least) & (F.col(score) < g * F.lag(score).over(order))
    return (
        rows.withColumn("_rank", F.row_number().over(order)).withColumn("_stop", broken.cast("int"))
        .withColumn("_stopped", F.max(F.coalesce("_stop", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .where("_stopped = 0").drop("_rank", "_stop", "_stopped")
    )


def contiguous_split(rows: DataFrame, order: Sequence[str], parts: int) -> DataFrame:
    """rows with part: blocks of ceil(n / parts) rows in an order.

    Rows are numbered within ranges of the order, and the ranges' sizes are added up, so that no task sees all rows.
    """
    n = rows.count()
    size = max(1, -(-n // parts))
    ranged = rows.repartitionByRange(max(1, min(200, n // 10_000 + 1)), *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    ranged = stage_table(ranged, "ranges")  # numbered once: what reads them twice must read the same numbers
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("_p").alias("_q"), "_before", "_first")
    placed = ranged.join(F.broadcast(before), F.col("_p") == F.col("_q"))  # a row for each of 200 ranges at most
    return placed.withColumn("part", F.floor((F.col("_i") - F.col("_first") + F.col("_before")) / size).cast("int")).drop("_p", "_i", "_q", "_before", "_first")


def keep_first(rows: DataFrame, by: str | list[str], order: str) -> DataFrame:
    """The first row of each key in an order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(order))).where("_r = 1").drop("_r")


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows drawn by the hash of key and seed: the same rows every time."""
    return rows.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))).orderBy("_h", key).limit(n).drop("_h")
