"""The steps of planned retrieval against plain versions."""

import collections

import pytest
from pyspark.sql import functions as F

from sylva.operators import bm25, graph, rank, tree
from sylva.plans import linking, providers, strategies


def _walk(edges, seeds, alpha, steps):
    """A personalised PageRank by hand."""
    near = collections.defaultdict(dict)
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0) + w
        near[b][a] = near[b].get(a, 0) + w
    ranks = dict(seeds)
    for _ in range(steps):
        new, lost = collections.Counter(), 0.0
        for n, r in ranks.items():
            total = sum(near[n].values())
            if not total:
                lost += r
            for m, w in near[n].items():
                new[m] += alpha * r * w / total
        for n, p in seeds.items():
            new[n] += p * (1 - alpha + alpha * lost)
        ranks = new
    return ranks


def test_pagerank_of_each_query(spark):
    edges = [("a", "b", 1.0), ("b", "c", 2.0), ("c", "a", 1.0), ("d", "e", 5.0)]
    seeds = {1: {"a": 0.5, "d": 0.5}, 2: {"lone": 0.25, "b": 0.75}}
    got = collections.defaultdict(dict)
    rows = [(q, n, p) for q, s in seeds.items() for n, p in s.items()]
    found = graph.pagerank_each(spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame(rows, "query_id long, node string, p double"), 0.5, 6)
    for r in found.collect():
        got[r.query_id][r.node] = r.rank
    for q, s in seeds.items():
        assert got[q] == pytest.approx(_walk(edges, s, 0.5, 6)) and sum(got[q].values()) == pytest.approx(1)


def test_linking(spark):
    questions = spark.createDataFrame([(1, "Where is Green Hall, near Oak?"), (2, "oaks and elms"), (3, "nothing known")], "query_id long, question string")
    names = spark.createDataFrame([("Green Hall",), ("Oak",), ("elms",), ("other words",)], "node string")
    collection = linking.entity_vectors(names, providers.HashedWords())
    got = {(r.query_id, r.node, round(r.similarity, 6)) for r in linking.link(questions, names, collection, providers.HashedWords()).collect()}
    assert {g for g in got if g[0] < 3} == {(1, "Green Hall", 1.0), (1, "Oak", 1.0), (2, "elms", 1.0)} and len([g for g in got if g[0] == 3]) == 1
    none = linking.link(questions, names, collection, providers.HashedWords(), force_one=False, near=1e-9).collect()
    assert {r.query_id for r in none} == {1, 2}


def test_skyline_of_each_query(spark):
    rows = [(1, i, t, g) for i, (t, g) in enumerate([(0.9, 0.1), (0.8, 0.5), (0.8, 0.4), (0.1, 0.9), (0.2, 0.2), (0.9, 0.1)])] + [(2, 7, 0.0, 0.0), (2, 8, 0.1, 0.0)]
    df = spark.createDataFrame(rows, "query_id long, node_id long, t double, g double")
    got = collections.defaultdict(set)
    for r in linking.skyline_each(df, 4, best_of_each=1).collect():
        got[r.query_id].add(r.node_id)
    assert got == {1: {0, 5, 1, 3}, 2: {7, 8}}
    one = df.where("query_id = 1").select(F.col("node_id").alias("id"), F.col("t").alias("score_0"), F.col("g").alias("score_1"))
    assert {r.id for r in rank.skyline_filter(one, "id", 4).collect()} == {0, 5, 1, 3}
    assert {r.id for r in rank.skyline_filter(one, "id", 7).collect()} == set(range(6))


@pytest.fixture
def inputs(spark):
    questions = spark.createDataFrame([(1, "what does Alder say"), (2, "list all tables on page 2"), (3, "tell of Birch and then tell of Cedar")], "query_id long, question string")
    nodes = [(0, None, "root", "title", 0), (1, 0, "Alder chapter", "title", 0), (2, 0, "Birch chapter", "title", 1), (3, 1, "Alder is a tree of wet ground", "text", 0), (4, 1, "it says little", "text", 0), (5, 2, "Birch is white", "text", 1), (6, 2, "a table of trees", "table", 1), (7, 2, "Cedar smells", "text", 2)]
    frame = spark.createDataFrame([(*n, ["root"]) for n in nodes], "node_id long, parent_id long, text string, type string, page_idx int, path_titles array<string>")
    mentions = spark.createDataFrame([(3, "Alder"), (5, "Birch"), (7, "Cedar"), (7, "Birches")], "node_id long, node string")
    edges = spark.createDataFrame([("Alder", "Birch", 1.0), ("Birches", "Cedar", 1.0)], "src string, dst string, weight double")
    return strategies.Inputs(questions, frame, mentions, edges, aliases=spark.createDataFrame([("Birches", "Birch")], "old string, new string"))


def _found(inputs, variant, **options):
    got = collections.defaultdict(dict)
    for r in strategies.retrieve("planned", inputs, variant, select_depth=1, **options).collect():
        got[r.query_id][r.node_id] = r.score
    return got


def test_planned_takes_its_steps(inputs):
    got = _found(inputs, "standard")
    # The section that mentions the entity is selected; one that shares no word with the question is not.
    assert {3, 4} <= set(got[1]) and set(got[2]) == {6} and {5, 7} <= set(got[3])
    assert set(_found(inputs, "wo_plan")[2]) != {6}  # a question as it is: no filters
    wide, narrow = _found(inputs, "wo_selector"), got
    assert 4 not in wide[1] or 0 in wide[1] or set(wide[1]) != set(narrow[1])
    text, walk = _found(inputs, "wo_graph", topk=2), _found(inputs, "wo_text", topk=2)
    assert all(len(v) <= 4 for v in (*text.values(), *walk.values()))
    # Alder leads to Birch, and through the alias Birches -> Birch on to Cedar; without resolution the walk ends at Birch.
    far = lambda v: _found(inputs, v, topk=1)
    merged = {r.node_id: r.g for r in _scores(inputs, "standard")}
    plain = {r.node_id: r.g for r in _scores(inputs, "wo_er")}
    assert merged[7] > 0 and plain[7] == 0 and far("standard")


def _scores(inputs, variant):
    options = strategies.DEFAULTS["planned"] | {"variant": variant}
    mentions, edges = strategies._graph_of(inputs, options)
    one = inputs.questions.where("query_id = 1")
    linked = linking.link(one, mentions.select("node").distinct(), linking.entity_vectors(mentions.select("node").distinct(), inputs.embedder), inputs.embedder)
    selected = inputs.nodes.select(F.lit(1).cast("long").alias("query_id"), "node_id")
    return linking.graph_scores(selected, linked, mentions, edges, 0.5).collect()


def test_providers_fail_one_by_one(spark):
    class Picky(providers.TextProvider):
        def complete(self, prompts):
            if any(p == "bad" for p in prompts):
                raise ValueError("no")
            return list(prompts) if len(prompts) < 3 else prompts[:1]

    got = providers.complete(spark.createDataFrame([("a",), ("bad",), ("c",)], "p string").coalesce(1), "p", "out", Picky()).collect()
    assert [r.out for r in got] == ["a", "Error: no", "c"]


def test_deep_trees_and_cycles(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(15)], "node_id long, parent_id long")
    assert {r.node_id: r.depth for r in tree.with_depth(chain).collect()} == {i: i for i in range(15)}
    assert {r.node_id: r["rank"] for r in tree.preorder(chain).collect()} == {i: i + 1 for i in range(15)}
    with pytest.raises(ValueError, match="cycle"):
        tree.closure(spark.createDataFrame([(1, 2), (2, 1)], "node_id long, parent_id long"))


def test_index_is_saved_and_filled(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word number{i % 3}" if i else None) for i in range(9)], "id long, text string")
    bm25.build(docs, "id", "text").save(str(tmp_path))
    asked = spark.createDataFrame([(1, "number1"), (2, "unknown")], "query_id long, text string")
    found = bm25.search(bm25.load(spark, str(tmp_path)), asked, 5)
    direct = bm25.search_docs(docs, "id", "text", asked, 5)
    rows = lambda df: sorted((r.query_id, r["rank"], r.id, r.score) for r in df.collect())
    assert rows(found.select("query_id", "rank", "id", "score")) == rows(direct.select("query_id", "rank", "id", "score")) == rows(bm25.search_docs(docs, "id", "text", asked, 5, most=0).select("query_id", "rank", "id", "score"))
    full = rows(bm25.filled(direct, asked, docs, 5))
    assert [(q, i) for q, _, i, _ in full] == [(1, 1), (1, 4), (1, 7), (1, 0), (1, 2), (2, 0), (2, 1), (2, 2), (2, 3), (2, 4)]


def test_extraction_gleans_repairs_and_chooses(spark):
    from sylva.operators import entities as E
    from sylva.operators import extract as X

    class Twice(X.CapitalisedRecords):
        def complete(self, prompts):
            return ['("entity"<|>"late"<|>"term"<|>"x")' if p.startswith("Some were") else a for p, a in zip(prompts, super().complete(prompts))]

    nodes = spark.createDataFrame([(1, "Green Halls stand."), (2, "nothing"), (3, None)], "node_id long, text string")
    records = E.parse_records(X.from_texts(nodes, Twice(), gleanings=2))
    assert {(r.node_id, r.name) for r in E.entities_of(records).collect()} == {(1, "green"), (1, "halls"), (1, "late")}
    found = spark.createDataFrame([(1, "green hall", "PLACE", "a"), (1, "oak", "TREE", "b"), (2, "oak", "TREE", "c")], "node_id long, name string, type string, description string")
    relations = spark.createDataFrame([(1, "green halls", "oak", "near", 1.0), (1, "green hall", "oak", "near", 2.0), (2, "oak", "somewhere else", "in", 1.0)], "node_id long, src string, dst string, relation string, weight double")
    merged, mended = X.repair(found, relations)
    assert {(r.name, r.type) for r in merged.collect()} == {("green hall", "PLACE"), ("oak", "TREE"), ("somewhere else", "UNKNOWN")}
    assert sorted((r.src, r.dst) for r in mended.collect()) == [("green hall", "oak"), ("oak", "somewhere else")]

    class Pick(X.TextProvider):
        def complete(self, prompts):
            return ["2" if "\n\nx\n\n" in p else "9" if "\n\ny\n\n" in p else "none" for p in prompts]

    options = spark.createDataFrame([("x", "a", 0.9), ("x", "b", 0.8), ("y", "a", 0.9), ("z", "a", 0.9)], "entity string, other string, score double")
    assert [(r.entity, r.other) for r in X.chosen(options, Pick()).collect()] == [("x", "b")]
    said = X.synthesised(spark.createDataFrame([("a", "one<SEP>two"), ("b", "one"), ("c", None)], "name string, description string"), providers.FirstSentence())
    assert {(r.name, r.description) for r in said.collect()} == {("a", "one"), ("b", "one"), ("c", None)}
    images = X.from_pictures(spark.createDataFrame([(1, "Great Tower"), (2, "")], "node_id long, text string"), X.CapitalisedRecords(), "image", F.concat(F.lit("image "), F.col("node_id").cast("string")))
    assert {(r.node_id, r.name) for r in images.collect()} == {(1, "great"), (1, "tower"), (2, "image 2")}


def test_aliases_with_cycles(spark):
    from sylva.operators import entities as E

    chain = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "b"), ("0", "x"), ("p", "q"), ("q", "r"), ("s", "s")]
    got = {r.old: r.new for r in E.resolve_aliases(spark.createDataFrame(chain, "old string, new string")).collect()}
    assert got == {"b": "a", "c": "a", "x": "a", "0": "a", "p": "r", "q": "r"}


def test_components_by_stars_and_merged(spark):
    rows = [(i, i + 1) for i in range(0, 300) if i % 50] + [(1000, i) for i in range(1001, 1400)]
    links = spark.createDataFrame(rows, "a long, b long").repartition(9)
    parts = [{(r.node, r.component) for r in graph.components(links, merged=m).collect()} for m in (0, 500_000)]
    assert parts[0] == parts[1] and (1400 - 1, 1000) in parts[0] and (50, 1) in parts[0]


def test_collections(spark, tmp_path):
    from sylva.operators import collections as C

    path = f"file://{tmp_path}/c"
    assert C.open_collection(spark, path, "id long, v array<double>").count() == 0
    C.add_to_collection(spark.createDataFrame([(1, [0.5])], "id long, v array<double>"), path)
    assert C.open_collection(spark, path, "id long, v array<double>").count() == 1
    assert C.reset_collection(spark, path, "id long, v array<double>").count() == 0
    docs = spark.createDataFrame([(1, "One two. Three four. Five six."), (2, None)], "id long, text string")
    assert [r.text for r in C.chunk_rows(docs, "id", "text", 4).orderBy("chunk").collect()] == ["One two. Three four.", "Five six."]
    assert C.chunk_index(docs, "id", "text", "bm25", budget=4).lengths.count() == 2 and C.chunk_index(docs, "id", "text", "vanilla", providers.HashedWords(), 4).count() == 2
    C.save_traces(spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.9)], "query_id long, node_id long, score double"), f"{tmp_path}/t")
    assert [x.node_id for x in spark.read.json(f"{tmp_path}/t").first().retrieved] == [3, 2] and C.room_left(100, 250) == 0
