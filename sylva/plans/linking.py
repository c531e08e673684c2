"""From questions to entities, sections and scores: the steps that planned and graph strategies are made of."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylva.operators import bm25, dense, walks
from sylva.plans.providers import Embedder, Reranker, embed, rerank
from sylva.stages import short_shuffles, stage_table

#: Words of the longest name that is looked for in a question.
LONGEST_NAME = 3


def entity_vectors(entities: DataFrame, embedder: Embedder, text: str = "node") -> DataFrame:
    """(id, node, v): the entity collection, built anew from a graph's entities (node); id is a hash of the name."""
    named = entities.select("node", F.col(text).alias("_text")).dropDuplicates(["node"])
    return embed(named, "_text", "v", embedder).select(F.xxhash64("node").alias("id"), "node", "v")


def name_grams(text: Column, longest: int = LONGEST_NAME) -> Column:
    """The distinct runs of up to `longest` words of a text, lower-cased, without punctuation at their ends."""
    ws = F.transform(bm25.tokens(text), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    runs = [F.transform(F.sequence(F.lit(0), F.greatest(F.size(ws) - n, F.lit(0))), lambda i, n=n: F.array_join(F.slice(ws, i + 1, n), " ")) for n in range(1, longest + 1)]
    return F.filter(F.array_distinct(F.concat(*runs)), lambda w: w != "")


def named_entities(questions: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, node): entities (node) whose whole name stands in the question."""
    runs = questions.select("query_id", F.explode(name_grams(F.col("question"))).alias("_w"))
    return runs.join(entities.select("node", F.lower("node").alias("_w")).distinct(), "_w").select("query_id", "node").distinct()


def nearest_entities(questions: DataFrame, collection: DataFrame, embedder: Embedder, k: int) -> DataFrame:
    """(query_id, node, similarity, rank): the k entities of a collection nearest to each question."""
    asked = embed(questions.select("query_id", "question"), "question", "v", embedder).select("query_id", "v")
    found = dense.batch_search(collection, asked, k, "id", "v")
    return found.join(collection.select("id", "node"), "id").select("query_id", "node", "similarity", "rank")


def link(questions: DataFrame, entities: DataFrame, collection: DataFrame, embedder: Embedder, k: int = 5, near: float = 0.3, of_nearest: int = 2, force_one: bool = True) -> DataFrame:
    """(query_id, node, similarity): the entities that a question starts from.

    Names that stand in the question count with similarity 1. A question without one takes the of_nearest nearest of its k
    entities that lie within the distance `near`, and, if there is none and force_one, the nearest of all. What is left
    out (no collection rows at all) starts from no entity.
    """
    exact = named_entities(questions, entities).withColumn("similarity", F.lit(1.0))
    close = nearest_entities(questions.join(exact.select("query_id").distinct(), "query_id", "left_anti"), collection, embedder, k)
    wanted = (F.col("rank") <= of_nearest) & (1 - F.col("similarity") < near)
    if force_one:
        wanted = wanted | (F.col("rank") == 1)
    return exact.unionByName(close.where(wanted).select("query_id", "node", "similarity"))


def sections(nodes: DataFrame, depth: int) -> DataFrame:
    """(node_id, section): the ancestor at a depth, or a node itself above it; nodes (node_id, parent_id)."""
    from sylva.operators import tree

    of = tree.ancestor_at(nodes, depth).withColumnRenamed("ancestor_id", "section")
    return nodes.select("node_id").join(of, "node_id", "left").select("node_id", F.coalesce("section", "node_id").alias("section"))


def select_sections(questions: DataFrame, linked: DataFrame, mentions: DataFrame, nodes: DataFrame, of_section: DataFrame, reranker: Reranker, extra: int = 2) -> DataFrame:
    """(query_id, section): sections that hold a mention of a linked entity, and the `extra` best of those that remain.

    Those that remain are ranked by the reranker on their own text: all sections that share a word with the question.
    """
    named = linked.select("node").distinct()
    of_entity = mentions.join(named, "node", "left_semi").join(of_section, "node_id").select("node", "section").distinct()
    held = linked.join(of_entity, "node").select("query_id", "section").distinct()
    titles = nodes.join(of_section.select("section").distinct(), F.col("node_id") == F.col("section")).select("section", "text")
    words = titles.select("section", F.explode(F.array_distinct(bm25.tokens(F.col("text")))).alias("_w"))
    asked = questions.select("query_id", F.explode(F.array_distinct(bm25.tokens(F.col("question")))).alias("_w"))
    remaining = asked.join(words, "_w").select("query_id", "section").distinct().join(held, ["query_id", "section"], "left_anti")
    scored = rerank(remaining.join(questions, "query_id").join(titles, "section").select("query_id", "section", "question", "text"), "question", "text", "score", reranker)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "section")
    return held.unionByName(scored.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= extra).select("query_id", "section"))


def walks_of(linked: DataFrame, edges: DataFrame, alpha: float, ids: list | None = None, iterations: int = 10) -> walks.Walks:
    """Each query's walk starts from its linked entities, each weighing (similarity + 1) / 2 of their total."""
    weight = (F.col("similarity") + 1) / 2
    total = F.sum(weight).over(Window.partitionBy("query_id"))
    return walks.Walks(edges, linked.withColumn("p", weight / total), alpha, iterations, ids)


def numbers_of(questions: DataFrame) -> tuple[list, list[str]]:
    """The ids of the questions, a stated set, in their order, and their texts."""
    rows = sorted((r[0], r[1] or "") for r in questions.select("query_id", "question").collect())
    return [r[0] for r in rows], [r[1] for r in rows]


def asking(selected: DataFrame, ids: list, key: str = "node_id") -> DataFrame:
    """(key, qs): the numbers of the queries that selected (query_id, key) each row of a key."""
    kind = selected.schema["query_id"].dataType.simpleString()
    numbers = selected.sparkSession.createDataFrame(list(zip(ids, range(len(ids)))), f"query_id {kind}, _q int")
    return selected.join(F.broadcast(numbers), "query_id").groupBy(key).agg(F.collect_set("_q").alias("qs"))


def _scored(texts: list[str] | None, reranker: Reranker | None, queries: int) -> Callable:
    """Of a batch (node_id, text, qs, names) the scores of its texts for the queries that selected them, NaN for the others."""

    def score(x: pa.RecordBatch) -> np.ndarray:
        qs = x.column("qs")
        wanted = np.zeros((x.num_rows, queries), bool)
        wanted[np.repeat(np.arange(x.num_rows), np.asarray(qs.value_lengths())), np.asarray(qs.flatten())] = True
        scores = np.zeros(wanted.shape) if texts is None else reranker.score_table(texts, [t or "" for t in x.column("text").to_pylist()], wanted)
        return np.where(wanted, scores, np.nan)

    return score


def selected_rows(nodes: DataFrame, asked: DataFrame, mentions: DataFrame, of: walks.Walks, texts: list[str] | None, reranker: Reranker | None) -> DataFrame:
    """Selected nodes (asked: node_id, qs) packed for a walk: what they mention, and with texts of the questions their scores.

    Each text is read once, and scored for all queries that selected it.
    """
    rows = nodes.select("node_id", "text" if texts is not None else F.lit(None).cast("string").alias("text")).join(asked, "node_id")
    rows = rows.join(of.mentioned(mentions), "node_id", "left").select(F.col("node_id").cast("long"), "text", "qs", "names")
    groups, score = of.groups, _scored(texts, reranker, len(of.ids))

    def run(batches):
        for x in batches:
            table, ids, out = score(x), x.column("node_id").to_numpy().astype(np.int64), []
            sizes, names = np.asarray(x.column("names").value_lengths().fill_null(0), np.int32), np.asarray(x.column("names").flatten(), np.int32)
            for g in range(groups):
                own = table[:, g::groups]
                some = ~np.isnan(own).all(1)
                if some.any():
                    out.append((g, walks.ROWS, ids[some], sizes[some], names[np.repeat(some, sizes)], np.ascontiguousarray(own[some].T)))
            if out:
                yield walks.packed_batch(out)

    with short_shuffles(nodes.sparkSession):
        return stage_table(rows.mapInArrow(run, walks.PACKED), "selected-rows")


def best_texts(nodes: DataFrame, asked: DataFrame, ids: list, texts: list[str], reranker: Reranker, k: int) -> DataFrame:
    """(query_id, node_id, score): of each query's selected nodes (asked: node_id, qs) the k best by the reranker, from whole texts.

    Each task keeps k of each query.
    """
    kind = nodes.sparkSession.createDataFrame(list(zip(ids, range(len(ids)))), "query_id long, q int")
    rows, score = nodes.select("node_id", "text").join(asked, "node_id").select(F.col("node_id").cast("long"), "text", "qs"), _scored(texts, reranker, len(ids))

    def run(batches):
        best = [walks.Best(k) for _ in ids]
        for x in batches:
            table, node = score(x), x.column("node_id").to_numpy().astype(np.int64)
            for q in np.nonzero(~np.isnan(table).all(0))[0]:
                some = ~np.isnan(table[:, q])
                best[q].add(node[some], np.zeros(some.sum()), table[some, q])
        for q, b in enumerate(best):
            node, _, t = b.result()
            if len(node):
                yield pa.RecordBatch.from_pydict({"q": np.full(len(node), q, np.int32), "node_id": node, "score": t})

    with short_shuffles(nodes.sparkSession):
        found = stage_table(rows.mapInArrow(run, "q int, node_id long, score double"), "best-texts")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "node_id")
    return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).join(F.broadcast(kind), "q").select("query_id", "node_id", "score")


def graph_scores(selected: DataFrame, linked: DataFrame, mentions: DataFrame, edges: DataFrame, alpha: float, iterations: int = 10) -> DataFrame:
    """(query_id, node_id, g): of every selected node the summed ranks of the entities it mentions, 0 where a walk reaches none."""
    ids = [r[0] for r in selected.select("query_id").distinct().orderBy("query_id").collect()]
    of = walks_of(linked.join(selected.select("query_id").distinct(), "query_id", "left_semi"), edges, alpha, ids, iterations)
    rows = selected_rows(selected.select("node_id").distinct(), asking(selected, ids), mentions, of, None, None)
    return of.run(rows, walks.Every).select("query_id", "node_id", "g")


def skyline_each(merged: DataFrame, topk: int, best_of_each: int = 5) -> DataFrame:
    """(query_id, node_id, t, g): of each query's rows the skyline in t and g, by the policy of rank.skyline_filter().

    A query with fewer than topk rows keeps all; where its skyline has fewer than topk, the best of each score join it.
    Of rows with one t only those with the best g can stay, and only if no larger t has as much.
    """
    each = Window.partitionBy("query_id")
    tops = merged.groupBy("query_id", "t").agg(F.max("g").alias("_g"))
    above = F.max("_g").over(each.orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, -1))
    front = merged.join(tops.withColumn("_above", above), ["query_id", "t"]).withColumn("front", (F.col("g") == F.col("_g")) & F.coalesce(F.col("_above") < F.col("g"), F.lit(True)))
    sized = front.withColumn("n", F.sum(F.col("front").cast("int")).over(each)).withColumn("rows", F.count("*").over(each))
    best = lambda c: F.row_number().over(each.orderBy(F.desc(c), "node_id")) <= best_of_each
    kept = sized.withColumn("bt", best("t")).withColumn("bg", best("g"))
    return kept.where((F.col("rows") < topk) | F.col("front") | ((F.col("n") < topk) & (F.col("bt") | F.col("bg")))).select("query_id", "node_id", "t", "g")
