"""Weighted undirected graphs as tables of edges (src, dst, weight), walked by joins and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylva.stages import free, short_shuffles, stage_table

#: Nodes of a partition's forest before it is handed on; rows of links that one task finishes; partitions merged into one.
FOREST = 2_000_000
MERGED = 500_000
FAN = 8


def canonical(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """edges with the smaller end first, without loops."""
    a, b = F.col(src), F.col(dst)
    return edges.where(a != b).withColumn("_s", F.least(a, b)).withColumn("_d", F.greatest(a, b)).drop(src, dst).withColumnRenamed("_s", src).withColumnRenamed("_d", dst)


def last_write(edges: DataFrame, order: str) -> DataFrame:
    """One edge for each unordered pair: the last by order."""
    w = Window.partitionBy("src", "dst").orderBy(F.desc(order))
    return canonical(edges).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").union(edges.select("dst", "src", "weight"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are in nodes (node)."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")


def rename_nodes(edges: DataFrame, alias: DataFrame) -> DataFrame:
    """edges with ends replaced through alias (old, new); loops that arise are dropped."""
    for end in ("src", "dst"):
        edges = edges.join(alias.select(F.col("old").alias(end), F.col("new").alias("_new")), end, "left").withColumn(end, F.coalesce("_new", end)).drop("_new")
    return edges.where("src <> dst")


def _local_forest(frames):
    """Links of one partition as stars: each node hangs on the least node that the partition connects it to."""
    import pandas as pd

    up: dict = {}

    def find(x):
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    for frame in frames:
        for u, v in zip(frame["u"].tolist(), frame["v"].tolist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                up[max(a, b)] = min(a, b)
        if len(up) > FOREST:
            yield pd.DataFrame({"u": list(up), "v": [find(x) for x in list(up)]})
            up.clear()
    if up:
        yield pd.DataFrame({"u": list(up), "v": [find(x) for x in list(up)]})


def components(links: DataFrame, a: str = "a", b: str = "b", merged: int = MERGED, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links, component being the smallest node reachable.

    Each partition of the links first reduces them to a forest of stars, and once more after partitions are merged by
    FAN. What is then at most `merged` rows (counted) is one small task's work. More go through alternating large-star
    and small-star rounds: each hangs the neighbours of a node on the smallest of them, so stars form in a number of
    rounds that grows with the logarithm of a component's diameter. They have formed when every node hangs on one node
    and no node that another hangs on hangs itself. Every round is a written table; nothing is gathered on the driver.

    Cases: null ends and loops are no links; repeated links count once; no links give no rows; ends are numbers or strings.
    """
    kind = links.schema[a].dataType.simpleString()
    shape = f"u {kind}, v {kind}"
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    edges = stage_table(edges.mapInPandas(_local_forest, shape).where("u <> v"), "forest")

    def swap(new: DataFrame, label: str) -> DataFrame:
        new = stage_table(new, label)
        free(edges)
        return new

    with short_shuffles(links.sparkSession):
        for at in range(max_rounds):
            if edges.count() <= merged:
                edges = swap(edges.coalesce(1).mapInPandas(_local_forest, shape).where("u <> v"), "forest")
                break
            if at == 0:
                edges = swap(edges.coalesce(-(-edges.rdd.getNumPartitions() // FAN)).mapInPandas(_local_forest, shape).where("u <> v"), "forest")
                continue
            ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(edges.select("v", F.lit(0), F.lit(1)))
            if ends.groupBy("x").agg(F.sum("hangs").alias("h"), F.max("holds").alias("o")).where("h > 1 or h = 1 and o = 1").isEmpty():
                break
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = (
                large.join(low, "u")
                .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
                .select("e.*").where("u <> v").distinct()
            )
            edges = swap(small, "star")
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def personalization(hits: DataFrame, node: str, similarity: str) -> DataFrame:
    """(node, p): sums of (cosine + 1) / 2 per node over their total."""
    sums = hits.groupBy(F.col(node).alias("node")).agg(F.sum((F.col(similarity) + 1) / 2).alias("s"))
    total = sums.agg(F.sum("s").alias("t")).select("t").scalar()
    return sums.select("node", (F.col("s") / total).alias("p"))


def pagerank(edges: DataFrame, seeds: DataFrame, alpha: float = 0.85, iterations: int = 10, tolerance: float | None = None) -> DataFrame:
    """(node, rank): personalised PageRank over an undirected weighted graph, seeds (node, p) summing to 1.

    Starts uniform. A node without weight hands its rank to the seeds. With a tolerance it stops when the L1 change falls
    below nodes times tolerance, else after a fixed number of iterations. Shares and nodes are written once; each
    iteration joins the ranks to the shares, sums by target and is written, so plans stay as long as one step. What nodes
    without weight lose is added up only if there are such nodes.
    """
    with short_shuffles(edges.sparkSession):
        ways = both_ways(edges).where("weight > 0")
        out = ways.groupBy(F.col("src").alias("_s")).agg(F.sum("weight").alias("_out"))
        shares = stage_table(ways.join(out, F.col("src") == F.col("_s")).select("src", "dst", (F.col("weight") / F.col("_out")).alias("share")), "rank-shares")
        ends = both_ways(edges).select(F.col("src").alias("node")).union(seeds.select("node")).distinct()
        linked = shares.select(F.col("src").alias("node")).distinct().withColumn("linked", F.lit(True))
        base = ends.join(seeds, "node", "left").join(linked, "node", "left").select("node", F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("linked", F.lit(False)).alias("linked"))
        base = stage_table(base, "rank-nodes")
        n = base.count()
        idle = not base.where("not linked").isEmpty()
        ranks = base.select("node", "p", "linked", F.lit(1.0 / max(n, 1)).alias("rank"))
        for _ in range(iterations):
            lost = ranks.where("not linked").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost")).select("lost").scalar() if idle else F.lit(0.0)
            arrived = shares.join(ranks.select("node", "rank"), F.col("src") == F.col("node")).groupBy(F.col("dst").alias("_n")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
            new = ranks.join(arrived, F.col("node") == F.col("_n"), "left").select(
                "node", "p", "linked", (alpha * (F.coalesce("got", F.lit(0.0)) + lost * F.col("p")) + (1 - alpha) * F.col("p")).alias("rank"), F.col("rank").alias("_old")
            )
            new = stage_table(new, "rank")
            free(ranks)
            ranks = new
            if tolerance is not None:
                moved = new.agg(F.sum(F.abs(F.col("rank") - F.col("_old")))).first()[0]
                if moved is None or moved < n * tolerance:
                    break
        free(shares)
    return ranks.select("node", "rank")


def pagerank_each(edges: DataFrame, seeds: DataFrame, alpha: float = 0.5, iterations: int = 10) -> DataFrame:
    """(query_id, node, rank): for each query its own personalised PageRank, from seeds (query_id, node, p) summing to 1 each.

    It starts at the seeds, so only nodes that a walk from them reaches have a row; the others have rank 0. A node without
    weight hands its rank to the seeds of the query. The queries are dealt to tasks (sylva/operators/walks.py).
    """
    from sylva.operators.walks import Walks

    return Walks(edges, seeds, alpha, iterations).run(None, None)


def rank_into(ranks: DataFrame, mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, score): summed ranks of the entities that each node mentions (node_id, node); 0 for others in nodes."""
    got = mentions.join(ranks, "node").groupBy("node_id").agg(F.sum("rank").alias("score"))
    return nodes.select("node_id").join(got, "node_id", "left").select("node_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def similarity_cut(pairs: DataFrame, edges: DataFrame, similarity: str, percentile: float) -> Column:
    """The similarity at a percentile (linearly interpolated) among existing edges; 1.0 if there are none."""
    on = edges.select("src", "dst").join(pairs, ["src", "dst"])
    return on.agg(F.coalesce(F.percentile(similarity, F.lit(percentile)), F.lit(1.0)).alias("c")).select("c").scalar()


def degree_cap(edges: DataFrame, nodes: DataFrame) -> int:
    """ceil of the average degree, at least 1."""
    n = nodes.count()
    return max(1, -(-2 * edges.count() // n)) if n else 1


def semantic_edges(pairs: DataFrame, edges: DataFrame, nodes: DataFrame, similarity: str = "similarity", percentile: float = 0.85, capped: bool = True, known: DataFrame | None = None) -> DataFrame:
    """Pairs (src < dst, similarity) above the cut that are not edges; capped, each node brings its nearest few.

    known: the edges with their similarities, where pairs holds only those above the cut.

    With the cap a pair stays if it is among the best of either end (ties by id), which does not depend on an order of nodes.
    """
    new = pairs.where(F.col(similarity) > similarity_cut(pairs if known is None else known, edges, similarity, percentile)).join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
    if not capped:
        return new
    cap = degree_cap(edges, nodes)
    ends = new.select(F.col("src").alias("a"), F.col("dst").alias("b"), similarity).union(new.select("dst", "src", similarity))
    return best_of_either(ends, cap, similarity)


def best_of_either(ends: DataFrame, cap: int, similarity: str = "similarity") -> DataFrame:
    """(src, dst, similarity): of pairs seen from an end (a, b) those among the cap best of it, ties by b."""
    best = ends.withColumn("_r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc(similarity), "b"))).where(F.col("_r") <= cap)
    return best.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), similarity).distinct()
