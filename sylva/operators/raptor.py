"""A tree of summaries over texts: reduce dimensions, cluster softly, summarise clusters, repeat."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.stages import stage_table
from sylva.plans.providers import Embedder, FirstSentence, HashedWords, TextProvider, complete, embed

FEW, MEMBER, MAX_LEVELS, TINY = 6, 0.1, 20, 1e-6


def cluster_counts(n: int) -> range:
    """Numbers of clusters to choose from for n rows: below a tenth of n and 50, or about a hundredth of many rows."""
    if n > 5000:
        return range(max(2, n // 100 - 1), n // 100 + 1)
    return range(1, max(2, min(50, n // 10)))


def _one_gaussian(reduced: DataFrame, n: int, dims: int) -> float:
    """The log-likelihood of one Gaussian; principal components are uncorrelated, so variances are all of its covariance."""
    from pyspark.ml.functions import vector_to_array

    x = vector_to_array("_p")
    found = reduced.agg(*[F.var_pop(x[i]).alias(f"v{i}") for i in range(dims)]).first()
    return -n / 2 * sum(math.log(2 * math.pi * max(v, TINY)) + 1 for v in found)


def cluster(rows: DataFrame, key: str, vector: str, dims: int = 8, seed: int = 1) -> DataFrame:
    """(key, cluster): soft clusters of a Gaussian mixture on principal components, its size chosen by BIC.

    A row belongs to every cluster of probability above MEMBER. FEW rows or fewer are one cluster.
    """
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    n = rows.count()
    counts = cluster_counts(n)
    if n <= FEW or counts == range(1, 2):
        return rows.select(key, F.lit(0).alias("cluster"))
    vectors = rows.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    dims = min(dims, n - 1)
    reduced = PCA(k=dims, inputCol="_v", outputCol="_p").fit(vectors).transform(vectors).select(key, "_p")
    reduced = stage_table(reduced, "components")
    best, least = None, math.inf
    for k in counts:
        model = GaussianMixture(k=k, featuresCol="_p", seed=seed, maxIter=20).fit(reduced) if k > 1 else None
        free = k - 1 + k * dims + k * dims * (dims + 1) / 2
        bic = free * math.log(n) - 2 * (model.summary.logLikelihood if model else _one_gaussian(reduced, n, dims))
        if bic < least:
            best, least = model, bic
    if best is None:
        return rows.select(key, F.lit(0).alias("cluster"))
    found = best.transform(reduced).select(key, F.posexplode(vector_to_array("probability")).alias("cluster", "_q"))
    return found.where(F.col("_q") > MEMBER).select(key, "cluster")


def build(texts: DataFrame, embedder: Embedder | None = None, model: TextProvider | None = None) -> list[DataFrame]:
    """Levels (id, text): the texts, summaries of their clusters, summaries of these, and so on until five are left."""
    levels = [texts.select("id", "text")]
    for _ in range(MAX_LEVELS):
        below = levels[-1]
        n = below.count()
        if n <= 5:
            break
        groups = cluster(embed(below, "text", "v", embedder or HashedWords()), "id", "v")
        joined = groups.join(below, "id").groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]), "\n").alias("prompt"))
        made = complete(joined.select(F.col("cluster").cast("long").alias("id"), "prompt"), "prompt", "text", model or FirstSentence()).select("id", "text")
        if made.count() >= n:
            break
        levels.append(made)
    return levels
