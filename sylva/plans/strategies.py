"""Question-answering strategies by name: each retrieves nodes for questions; the rest of the way is shared.

Inputs are tables: questions (query_id, question), nodes (node_id, text, and parent_id, type, page_idx, path_titles where
a step needs them), mentions (node_id, node), edges (src, dst, weight), aliases (old, new) of entities, vectors (node_id, v)
of texts and image_vectors (node_id, v) of pictures. What a strategy does not need may be left out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.operators import bm25, dense, entities, filters, graph, walks
from sylva.plans import linking, planning
from sylva.plans.providers import Embedder, FirstSentence, HashedWords, Reranker, SharedWords, TextProvider, complete, embed, rerank
from sylva.stages import short_shuffles, stage_table


@dataclass
class Inputs:
    questions: DataFrame
    nodes: DataFrame
    mentions: DataFrame | None = None
    edges: DataFrame | None = None
    vectors: DataFrame | None = None
    image_vectors: DataFrame | None = None
    aliases: DataFrame | None = None
    embedder: Embedder = field(default_factory=HashedWords)
    reranker: Reranker = field(default_factory=SharedWords)
    model: TextProvider = field(default_factory=FirstSentence)


#: Defaults of each strategy, and what a variant changes.
DEFAULTS = {
    "planned": {"topk": 10, "alpha": 0.5, "topk_ent": 5, "similarity": 0.3, "select_depth": 2, "budget": 800},
    "graph": {"topk": 5, "alpha": 0.5, "topk_ent": 1, "similarity": 0.0, "budget": 800},
    "traverse": {"topk": 5, "max_depth": 5, "budget": 800},
    "vanilla": {"topk": 5, "budget": 800},
    "bm25": {"topk": 5, "budget": 800},
    "tree_entity": {"topk": 10, "topk_ent": 5, "alpha": 0.5, "budget": 800},
    "mmr": {"topk": 5, "budget": 800},
    "summaries": {"topk": 5, "budget": 800},
}
VARIANTS = ("standard", "wo_plan", "wo_selector", "wo_graph", "wo_text", "wo_er", "wo_map")
_registry: dict[str, Callable[[Inputs, dict], DataFrame]] = {}


def strategy(name: str):
    def put(f):
        _registry[name] = f
        return f

    return put


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _asked(inputs: Inputs) -> DataFrame:
    return embed(inputs.questions.select("query_id", "question"), "question", "v", inputs.embedder).select("query_id", "v")


def _vectors(inputs: Inputs) -> DataFrame:
    return inputs.vectors if inputs.vectors is not None else embed(inputs.nodes.select("node_id", "text"), "text", "v", inputs.embedder).select("node_id", "v")


@strategy("vanilla")
def _vanilla(inputs: Inputs, options: dict) -> DataFrame:
    near = dense.batch_search(_vectors(inputs), _asked(inputs), options["topk"], "node_id", "v")
    return near.select("query_id", F.col("id").alias("node_id"), F.col("similarity").alias("score"))


@strategy("mmr")
def _multimodal(inputs: Inputs, options: dict) -> DataFrame:
    """The best of a node's text and picture: each is searched, and the nodes are ranked by the larger similarity."""
    if inputs.image_vectors is None:
        return _vanilla(inputs, options)
    both = [dense.batch_search(v, _asked(inputs), options["topk"], "node_id", "v") for v in (_vectors(inputs), inputs.image_vectors)]
    best = both[0].unionByName(both[1]).groupBy("query_id", F.col("id").alias("node_id")).agg(F.max("similarity").alias("score"))
    return _ranked(best, options["topk"]).select("query_id", "node_id", "score")


@strategy("summaries")
def _summaries(inputs: Inputs, options: dict) -> DataFrame:
    """Dense search over all levels of the summary tree; leaves and summaries stand side by side, summaries with ids below 0."""
    from sylva.operators import raptor

    levels = raptor.build(inputs.nodes.select(F.col("node_id").cast("long").alias("id"), "text"), inputs.embedder, inputs.model)
    placed = [level.select((F.col("id") if n == 0 else -(F.lit(n) * (1 << 40) + F.col("id") + 1)).alias("node_id"), "text") for n, level in enumerate(levels)]
    rows = embed(reduce(DataFrame.unionByName, placed), "text", "v", inputs.embedder)
    near = dense.batch_search(rows, _asked(inputs), options["topk"], "node_id", "v")
    return near.select("query_id", F.col("id").alias("node_id"), F.col("similarity").alias("score"))


@strategy("bm25")
def _lexical(inputs: Inputs, options: dict) -> DataFrame:
    found = bm25.search_docs(inputs.nodes, "node_id", "text", inputs.questions, options["topk"], "query_id", "question")
    return found.select("query_id", F.col("id").alias("node_id"), "score")


def _graph_of(inputs: Inputs, options: dict) -> tuple[DataFrame, DataFrame]:
    """mentions and edges with aliases of entities followed to their ends; the variant wo_er leaves entities as extracted."""
    if inputs.aliases is None or options["variant"] == "wo_er":
        return inputs.mentions, inputs.edges
    ends = stage_table(entities.resolve_aliases(inputs.aliases), "aliases")
    named = inputs.mentions.join(ends, F.col("node") == F.col("old"), "left").select("node_id", F.coalesce("new", "node").alias("node")).distinct()
    edges = graph.canonical(graph.rename_nodes(inputs.edges, ends)).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    return named, edges


def _linked(inputs: Inputs, mentions: DataFrame, options: dict) -> DataFrame:
    names = mentions.select("node").distinct()
    collection = stage_table(linking.entity_vectors(names, inputs.embedder), "entity-vectors")
    return stage_table(linking.link(inputs.questions, names, collection, inputs.embedder, options["topk_ent"], options["similarity"]), "linked")


@strategy("graph")
def _graph(inputs: Inputs, options: dict) -> DataFrame:
    """The best nodes by the ranks of a walk from a question's entities over the whole graph, summed into nodes."""
    mentions, edges = _graph_of(inputs, options)
    linked = _linked(inputs, mentions, options)
    each = linked.withColumn("p", F.lit(1.0) / F.count("*").over(Window.partitionBy("query_id")))
    of = walks.Walks(edges, each, options["alpha"], 10)
    k = options["topk"]
    return of.run(of.rows(mentions), lambda: walks.Best(k, 0.0)).select("query_id", "node_id", F.col("g").alias("score"))


@strategy("tree_entity")
def _tree_and_entities(inputs: Inputs, options: dict) -> DataFrame:
    """The nearest nodes, and the nodes that mention the nearest entities, with the larger similarity of the two."""
    mentions, _ = _graph_of(inputs, options)
    collection = stage_table(linking.entity_vectors(mentions.select("node").distinct(), inputs.embedder), "entity-vectors")
    near = linking.nearest_entities(inputs.questions, collection, inputs.embedder, options["topk_ent"])
    entity = near.join(mentions, "node").groupBy("query_id", "node_id").agg(F.max("similarity").alias("score"))
    return _vanilla(inputs, options).unionByName(entity).groupBy("query_id", "node_id").agg(F.max("score").alias("score"))


@strategy("traverse")
def _traverse(inputs: Inputs, options: dict) -> DataFrame:
    """Down from the root of a question's document (doc_id), or of the one tree there is, to the child that suits it best.

    An only child is followed without asking. nodes need parent_id; without doc_id more than one root is an error.
    """
    by_doc = "doc_id" in inputs.questions.columns and "doc_id" in inputs.nodes.columns
    nodes = inputs.nodes.select("node_id", "parent_id", "text")
    roots = inputs.nodes.where("parent_id is null")
    if by_doc:
        at = inputs.questions.select("query_id", "question", "doc_id").join(roots.select("doc_id", "node_id"), "doc_id").drop("doc_id")
    else:
        found = roots.select("node_id").limit(2).collect()
        if len(found) > 1:
            raise ValueError("there are several roots: questions and nodes need doc_id")
        kind = nodes.schema["node_id"].dataType
        at = inputs.questions.select("query_id", "question", (F.lit(found[0][0]) if found else F.lit(None)).cast(kind).alias("node_id")).where("node_id is not null")
    taken: list[DataFrame] = []
    while options["max_depth"] < 0 or len(taken) < options["max_depth"]:
        kids = at.join(nodes.withColumnRenamed("node_id", "_kid"), F.col("node_id") == F.col("parent_id")).select("query_id", "question", F.col("_kid").alias("node_id"), "text")
        scored = rerank(kids, "question", "text", "score", inputs.reranker)
        at = stage_table(_ranked(scored, 1).select("query_id", "question", "node_id", "score"), "descent")
        if at.isEmpty():
            break
        taken.append(at.select("query_id", "node_id", "score"))
        at = at.drop("score")
    kind = nodes.schema["node_id"].dataType.simpleString()
    none = nodes.sparkSession.createDataFrame([], f"query_id {inputs.questions.schema['query_id'].dataType.simpleString()}, node_id {kind}, score double")
    return reduce(DataFrame.unionByName, taken, none)


def _looked_up(inputs: Inputs, options: dict) -> DataFrame:
    """(query_id, node_id, score) for questions that are looked up: link, select, rank by graph and by text, skyline."""
    variant = options["variant"]
    mentions, edges = _graph_of(inputs, options)
    linked = _linked(inputs, mentions, options)
    ids, texts = linking.numbers_of(inputs.questions)
    if variant != "wo_selector" and "parent_id" in inputs.nodes.columns:
        of_section = stage_table(linking.sections(inputs.nodes.select("node_id", "parent_id"), options["select_depth"]), "sections")
        chosen = linking.select_sections(inputs.questions, linked, mentions, inputs.nodes, of_section, inputs.reranker)
        selected = of_section.join(linking.asking(chosen, ids, "section"), "section").select("node_id", "qs")
    else:
        # Without a selection: nodes that mention a linked entity, and the lexically best.
        held = linked.join(mentions, "node").select("query_id", "node_id")
        lexical = bm25.search_docs(inputs.nodes, "node_id", "text", inputs.questions, 4 * options["topk"], "query_id", "question")
        selected = linking.asking(held.union(lexical.select("query_id", F.col("id").alias("node_id"))), ids)
    with short_shuffles(inputs.nodes.sparkSession):
        selected = stage_table(selected, "selected")
    topk = options["topk"]
    if variant == "wo_graph":
        return linking.best_texts(inputs.nodes, selected, ids, texts, inputs.reranker, topk)
    of = linking.walks_of(linked, edges, options["alpha"], ids)
    rows = linking.selected_rows(inputs.nodes, selected, mentions, of, None if variant == "wo_text" else texts, inputs.reranker)
    if variant == "wo_text":
        return of.run(rows, lambda: walks.Best(topk)).select("query_id", "node_id", F.col("g").alias("score"))
    return of.run(rows, lambda: walks.Skyline(topk, 5)).select("query_id", "node_id", F.greatest("t", "g").alias("score"))


@strategy("planned")
def _planned(inputs: Inputs, options: dict) -> DataFrame:
    """Plan, then by type: the parts of complex questions and simple ones are looked up; global ones take all that passes their filters.

    wo_plan looks up every question as it is; the other variants leave out or replace a step of the look-up.
    """
    if options["variant"] == "wo_plan":
        return _looked_up(inputs, options)
    plans = stage_table(planning.check(planning.plan(inputs.questions.select("query_id", "question"))), "plans")
    parts = F.filter("sub_questions", lambda q: q["type"] == "retrieval")
    asked = F.when(F.col("query_type") == "complex", F.transform(parts, lambda q: q["question"])).otherwise(F.array("question"))
    # Sub-questions are questions of their own, and what they find is their question's.
    split = stage_table(plans.where("query_type <> 'global'").select("query_id", F.posexplode(asked).alias("_no", "question")).select(F.xxhash64("query_id", "_no").alias("_sub"), "query_id", "question"), "sub-questions")
    found = _looked_up(replace(inputs, questions=split.select(F.col("_sub").alias("query_id"), "question")), options)
    of_parts = found.withColumnRenamed("query_id", "_sub").join(split.select("_sub", "query_id"), "_sub").groupBy("query_id", "node_id").agg(F.max("score").alias("score"))
    return of_parts.unionByName(_passing(inputs, plans))


def _passing(inputs: Inputs, plans: DataFrame) -> DataFrame:
    """(query_id, node_id, score 1): the nodes that pass the filters of each global question. Equal filters are applied once."""
    out = inputs.nodes.select(F.lit(None).cast(plans.schema["query_id"].dataType).alias("query_id"), "node_id", F.lit(1.0).alias("score")).limit(0)
    if not {"type", "page_idx", "path_titles"} <= set(inputs.nodes.columns):
        return out
    asked = plans.where("query_type = 'global' and size(filters) > 0").groupBy(F.to_json("filters").alias("f")).agg(F.first("filters").alias("filters"), F.collect_list("query_id").alias("ids"))
    for r in asked.orderBy("f").collect():  # a row for each kind of filters; questions are a stated set
        passing = filters.structural(inputs.nodes, [(f.filter_type, f.filter_value) for f in r.filters]).select("node_id")
        out = out.unionByName(passing.select(F.explode(F.array(*[F.lit(i).cast(plans.schema["query_id"].dataType) for i in r.ids])).alias("query_id"), "node_id", F.lit(1.0).alias("score")))
    return out


def retrieve(name: str, inputs: Inputs, variant: str = "standard", **options) -> DataFrame:
    """(query_id, node_id, score) by a strategy."""
    if name not in _registry or variant not in VARIANTS:
        raise ValueError(f"no strategy {name} in variant {variant}; there are {', '.join(_registry)} and {', '.join(VARIANTS)}")
    return _registry[name](inputs, DEFAULTS[name] | options | {"variant": variant})


def answer(name: str, inputs: Inputs, variant: str = "standard", **options) -> DataFrame:
    """(query_id, answer): retrieve, pack evidence into prompts, answer each, and put the answers of a question together."""
    chosen = DEFAULTS[name] | options
    found = retrieve(name, inputs, variant, **options).join(inputs.nodes.select("node_id", "text"), "node_id")
    pack = planning.first_prompt if variant == "wo_map" else planning.pack_evidence
    prompts = pack(found, "query_id", "node_id", "text", chosen["budget"])
    if variant == "wo_map":
        prompts = prompts.withColumn("prompt_no", F.lit(0))
    asked = prompts.join(inputs.questions, "query_id").withColumn("prompt", F.concat("question", F.lit("\n\n"), "evidence"))
    partial = complete(asked.select("query_id", "prompt_no", "prompt"), "prompt", "partial", inputs.model)
    return planning.reduce_answers(partial, "query_id", "prompt_no", "partial")


def names() -> list[str]:
    return sorted(_registry)

