"""Mixing sources to target weights by Pareto order sampling.

Every source has a target in words. A document's expected number of copies is its source's target over the source's
size, times its own importance if one is given, and three at most. Whole copies are certain. The remainder is an
inclusion probability p: documents are ranked within their source by Pareto odds (u / (1 - u)) / (p / (1 - p)), u being
uniform and drawn from the document's id, source and text, and the lowest are taken until the words still wanted are filled.

The cut through a source is found from a histogram of the ranks (sources times BINS rows); only the documents in the
one bin that the cut runs through are sorted, so a source with most rows is never gathered in a task.

Cases: null text has size 0, and documents of size 0 are taken for 0 words; a null source is a source, the last; equal
rows have equal ranks and each its own copies, which of them has more is arbitrary and changes no total; rows that
share an id alone are drawn apart; sources without words have target 0; an
empty table gives an empty result; extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.llm._common import n_words, small_or_shuffled, stage_table, uniform

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
BINS = 4096
SEED = 7
MAX_BROADCAST_ROWS = 100_000


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = MOST_COPIES, share: float = 1.0) -> DataFrame:
    """source, source_size, target from rows of source and size.

    Weights repeat over the sources in code point order, null last. share of all words is dealt by weight; a target
    stops at cap times its source's size and the excess is dealt again. In the end every target is the smaller of its
    cap and level times its weight, so level follows from the sources in the order in which they reach their caps.
    The windows run over one row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    wheel = F.array(*[F.lit(float(w)) for w in weights])
    sources = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(wheel, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1))
        .withColumn("cap", F.col("source_size") * F.lit(float(cap)))
        .withColumn("full_at", F.col("cap") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(by_fill), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_fill), F.lit(0.0)))
        .withColumn("level", F.when(F.col("left") <= F.col("full_at") * F.col("left_weight"), F.col("left") / F.col("left_weight")))
    )
    return sources.select(
        "source", "source_size",
        F.least("cap", F.coalesce(F.max("level").over(every), F.max("full_at").over(every)) * F.col("weight")).alias("target"),
    )


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = MOST_COPIES, seed: int = SEED, importance: str | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, copies, taken (copies times size).

    importance: a column of positive numbers; expected copies within a source are in proportion to it. carry: columns of
    docs that each row brings along in a struct, row, so that copies need no join back to the documents.
    """
    mass = F.coalesce(F.col(importance).cast("double"), F.lit(1.0)) if importance else F.lit(1.0)
    rows = stage_table(
        docs.select(
            "doc_id", "source", n_words(F.col("text")).alias("size"), mass.alias("mass"),
            uniform(F.col("doc_id"), F.coalesce("source", F.lit("")), F.xxhash64("text"), seed=seed).alias("u"),
            *([F.struct(*carry).alias("row")] if carry else []),
        ),
        "mix-sizes",
    )
    targets = source_targets(rows, weights, cap)
    mean = rows.groupBy(F.col("source").alias("_s")).agg((F.sum(F.col("mass") * F.col("size")) / F.nullif(F.sum("size"), F.lit(0))).alias("mean_mass"))
    targets = stage_table(targets.join(mean, targets.source.eqNullSafe(mean._s), "left").drop("_s").withColumnRenamed("source", "_source"), "mix-targets")
    odds = F.col("u") / (1 - F.col("u"))
    drawn = (
        rows.join(small_or_shuffled(targets, MAX_BROADCAST_ROWS), F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("expected", F.when(F.col("source_size") > 0, F.least(F.lit(float(cap)), F.col("target") / F.col("source_size") * F.col("mass") / F.col("mean_mass"))).otherwise(0.0))
        .withColumn("certain", F.floor("expected").cast("int"))
        .withColumn("p", F.col("expected") - F.col("certain"))
        .withColumn("q", F.when(F.col("p") > 0, odds / (F.col("p") / (1 - F.col("p")))))
        .withColumn("bin", F.when(F.col("q").isNotNull(), F.least(F.lit(BINS - 1), F.floor(F.col("q") / (1 + F.col("q")) * BINS)).cast("int")))
        .drop("_source", "mass", "mean_mass", "u")
    )
    # The bin of each source through which its cut runs, and the words wanted of it.
    filled = (
        drawn.groupBy("source", "bin", "target")
        .agg(F.sum("size").alias("words"), F.sum(F.col("certain") * F.col("size")).alias("sure"))
        .withColumn("wanted", F.col("target") - F.sum("sure").over(Window.partitionBy("source")))
        .where("bin is not null")
        .withColumn("through", F.sum("words").over(Window.partitionBy("source").orderBy("bin")))
        .where("through >= wanted")
        .withColumn("_first", F.row_number().over(Window.partitionBy("source").orderBy("bin")))
        .where("_first = 1")
        .select(F.col("source").alias("_source"), F.col("bin").alias("cut"), (F.col("wanted") - F.col("through") + F.col("words")).alias("want_here"))
    )
    cuts = small_or_shuffled(stage_table(filled, "mix-cuts"), MAX_BROADCAST_ROWS)
    placed = drawn.join(cuts, F.col("source").eqNullSafe(F.col("_source")), "left")
    on_cut = F.coalesce(F.col("bin") == F.col("cut"), F.lit(False))
    clear = placed.where(~on_cut).withColumn("more", F.when(F.col("bin").isNotNull() & (F.col("cut").isNull() | (F.col("bin") < F.col("cut"))), 1).otherwise(0))
    order = Window.partitionBy("source", "bin").orderBy("q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    split = (
        placed.where(on_cut)
        .withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0)))
        .withColumn("more", F.when(F.col("before") + F.col("size") / 2 <= F.col("want_here"), 1).otherwise(0))
        .drop("before")
    )
    copies = (F.col("certain") + F.col("more")).cast("int")
    return clear.unionByName(split).select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), *(["row"] if carry else [])
    )
