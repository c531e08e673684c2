"""Operators against brute force and on small fixtures."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sylva.operators import blocks, entities, filters, graph, rank, raptor, tables, tree
from sylva.plans import planning, strategies
from sylva.sources import corpus


def test_skylines(spark):
    rows = [(1, 0.9, 0.1), (2, 0.5, 0.5), (3, 0.4, 0.4), (4, 0.5, 0.5)]
    assert {r.id for r in rank.skyline_2d(spark.createDataFrame(rows, "id int, x double, y double"), "x", "y").collect()} == {1, 2, 4}
    rng = random.Random(3)
    many = [(i, float(rng.randint(0, 30)), float(rng.randint(0, 30)), float(rng.randint(0, 9))) for i in range(300)]
    df = spark.createDataFrame(many, "id int, x double, y double, z double")
    for dims, at in ((["x", "y"], (1, 2)), (["x", "y", "z"], (1, 2, 3))):
        front = {a[0] for a in many if not any(all(b[i] >= a[i] for i in at) and any(b[i] > a[i] for i in at) for b in many)}
        assert {r.id for r in rank.skyline(df, dims).collect()} == front
        assert {r.id for r in rank.skyline(df.repartition(5), dims).collect()} == front
    assert rank.skyline_2d(df.limit(0), "x", "y").count() == 0


def test_gradient_cut(spark):
    df = spark.createDataFrame([("a", i, s) for i, s in enumerate([0.9, 0.8, 0.5, 0.2, 0.19])], "g string, k int, s double")
    assert sorted(r.s for r in rank.gradient_cut(df, "g", "s", "k", 0.6).collect()) == [0.5, 0.8, 0.9]


def test_split(spark):
    got = rank.contiguous_split(spark.createDataFrame([(i,) for i in range(5)], "d long"), ["d"], 2).groupBy("part").count().collect()
    assert sorted(r["count"] for r in got) == [2, 3]


def test_outline(spark):
    titles = spark.createDataFrame([(1, i, lv) for i, lv in enumerate([0, 1, 2, 2, 1], 1)], "doc int, pos int, level int")
    assert [r.naive_parent for r in tree.nearest_smaller(titles, "doc", "pos", "level", 3).orderBy("pos").collect()] == [0, 1, 2, 2, 1]
    ends = spark.createDataFrame([(1, i, 12) for i in (1, 4, 9)], "doc int, pos int, n int")
    assert [r.end_id for r in tree.extents(ends, "doc", "pos", "n").orderBy("pos").collect()] == [4, 9, 13]
    assert spark.range(1).select(tree.effective_height(F.lit(0), F.lit(3.0), F.lit(12.0)).alias("h")).first().h == 12.0


def test_filters(spark):
    df = spark.createDataFrame([(i, "text") for i in range(12)], "page_idx int, type string").withColumn("path_titles", F.array(F.lit("In"), F.lit("tro")))
    assert filters.structural(df, [("page", "3-10")]).count() == 8
    assert filters.structural(df, [("page", None), ("section", None), ("page", "x")]).count() == 12
    assert filters.structural(df, [("section", "INTRO")]).count() == 12 and filters.structural(df, [("section", "intro two")]).count() == 0


def test_grid():
    html = "<table><tr><td rowspan=2>a</td><td>b</td></tr><tr><td>c</td></tr></table>"
    assert tables.grid_cells(html) == [(0, 0, "a"), (0, 1, "b"), (1, 0, "a"), (1, 1, "c")]
    assert tables.grid_cells(None) == [] and tables.grid_cells("<p>no table</p>") == []


def test_continuations(spark):
    rows = [(1, 1, 0, "text", "This paragraph goes on and on without an end and", None), (1, 2, 0, "table", "", None), (1, 3, 1, "text", "then it continues here.", None), (1, 4, 1, "text", "A new one begins here.", None), (1, 5, 5, "text", "far away", None)]
    df = spark.createDataFrame(rows, "doc_id int, pdf_id int, page_idx int, type string, text string, text_level int")
    found = blocks.continuations(df)
    assert [(r.pdf_id, r.candidate_id) for r in found.collect()] == [(1, 3)]
    stitched = {r.pdf_id: (r.text, r.invalid) for r in blocks.stitch(df, found).collect()}
    assert stitched[1][0].endswith("and then it continues here.") and stitched[3][1] and not stitched[1][1]


def test_zip_layout_checks_lengths(spark):
    a = spark.createDataFrame([(1, ["x", "y"])], "doc_id int, content array<string>")
    with pytest.raises(Exception, match="lengths differ"):
        blocks.zip_layout(a, spark.createDataFrame([(1, ["p"])], "doc_id int, boxes array<string>"), "doc_id").collect()


def test_pagerank(spark):
    rng = random.Random(5)
    edges = list({tuple(sorted(rng.sample(range(12), 2))): float(rng.randint(1, 4)) for _ in range(25)}.items())
    df = spark.createDataFrame([(a, b, w) for (a, b), w in edges] + [(20, 21, 0.0)], "src int, dst int, weight double")
    seeds = spark.createDataFrame([(0, 0.5), (20, 0.5)], "node int, p double")
    got = {r.node: r.rank for r in graph.pagerank(df, seeds, 0.6, 40, 1e-9).collect()}
    assert math.isclose(sum(got.values()), 1.0, abs_tol=1e-6)
    nodes = sorted({x for (a, b), _ in edges for x in (a, b)} | {20, 21, 0})
    out = {n: sum(w for e, w in edges if n in e) for n in nodes}
    p = {n: 0.5 if n in (0, 20) else 0.0 for n in nodes}
    r = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(100):
        lost = sum(r[n] for n in nodes if out[n] == 0)
        r = {n: 0.6 * (sum(r[o] * w / out[o] for e, w in edges if n in e for o in e if o != n) + lost * p[n]) + 0.4 * p[n] for n in nodes}
    for n in nodes:
        assert math.isclose(got[n], r[n], abs_tol=1e-6)


def test_entities(spark):
    assert entities.candidates(spark.createDataFrame([(1, 2, 0.1, 0.49)], "entity int, other int, distance double, score double")).count() == 0
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "old string, new string")
    assert {r.new for r in entities.resolve_aliases(chain).collect()} == {"d"}
    text = '("entity"<|>"X"<|>"big thing"<|>"d")##("relationship"<|>"X"<|>"Y"<|>"r"<|>2.5)##("relationship"<|>"X"<|>"Y"<|>"r"<|>often)'
    records = entities.parse_records(spark.createDataFrame([(1, text)], "id int, record_text string"))
    assert [(r.name, r.type) for r in entities.entities_of(records).collect()] == [("x", "BIG_THING")]
    assert sorted(r.weight for r in entities.relations_of(records).collect()) == [1.0, 2.5]


def test_plans(spark):
    asked = spark.createDataFrame([(1, "How many tables are on page 3?"), (2, "What is it?"), (3, "Compare A and B")], "id int, question string")
    plans = planning.check(planning.plan(asked)).orderBy("id").collect()
    assert [p.query_type for p in plans] == ["global", "simple", "complex"] and plans[0].operation == "COUNT"
    broken = planning.plan(asked).withColumn("sub_questions", F.lit(None).cast("array<struct<question:string,type:string>>"))
    with pytest.raises(Exception, match="complex without"):
        planning.check(broken).collect()


def test_strategies_are_checked(spark):
    inputs = strategies.Inputs(spark.createDataFrame([(1, "x")], "query_id long, question string"), spark.createDataFrame([(1, "x y"), (2, "z")], "node_id long, text string"))
    with pytest.raises(ValueError, match="no strategy"):
        strategies.retrieve("nothing", inputs)
    assert strategies.answer("bm25", inputs).first().answer == "x y"
    nodes = spark.createDataFrame([(0, None, "root"), (1, 0, "x thing"), (2, 0, "other"), (3, 1, "leaf x")], "node_id long, parent_id long, text string")
    walk = strategies.retrieve("traverse", strategies.Inputs(inputs.questions, nodes)).collect()
    assert [r.node_id for r in walk] == [1, 3]


def test_files(spark, tmp_path):
    (tmp_path / "q.json").write_text('[{"question": "a", "answer": "b", "doc_uuid": "u", "doc_path": "p", "extra": 1}]')
    assert corpus.read_questions(spark, str(tmp_path / "q.json")).first().extra == 1
    (tmp_path / "bad.json").write_text('[{"question": "a"}]')
    with pytest.raises(ValueError, match="has no answer"):
        corpus.read_questions(spark, str(tmp_path / "bad.json"))
    (tmp_path / "a.md").write_text("# A\ntext")
    assert corpus.read_markdown(spark, str(tmp_path / "a.md")).first().text == "# A\ntext"
    e, d = spark.createDataFrame([("x",)], "name string"), spark.createDataFrame([("x", "y")], "src string, dst string")
    for variant in ("default", "g-2"):
        corpus.save_graph(e, d, str(tmp_path / "graph"), variant)
    assert [t.count() for t in corpus.load_graph(spark, str(tmp_path / "graph"), "g-2")] == [1, 1]
    nested = spark.createDataFrame([(1, (["q1", "q2"], ["a1", "a2"]))], "id int, qas struct<question:array<string>,answer:array<string>>")
    assert [(r.question, r.answer) for r in corpus.unnest(nested, "qas", ("question", "answer")).collect()] == [("q1", "a1"), ("q2", "a2")]


def test_stream_extends_index(spark, tmp_path):
    from sylva.operators import bm25
    from sylva.streaming import incremental

    (tmp_path / "in").mkdir()
    for n in range(2):
        (tmp_path / "in" / f"{n}.json").write_text(f'{{"doc_id": {n}, "text": "word number{n}"}}\n')
        incremental.extend_postings(spark, str(tmp_path / "in"), str(tmp_path / "index"), str(tmp_path / "cp")).awaitTermination()
    index = incremental.read_index(spark, str(tmp_path / "index"))
    assert bm25.search_one(index, spark, "number1", 1).first().id == 1
    assert {r.term: r.df for r in index.terms.collect()} == {"word": 2, "number0": 1, "number1": 1}


def test_summary_tree_grows_with_the_texts(spark):
    assert [list(raptor.cluster_counts(n)) for n in (12, 40, 5001)] == [[1], [1, 2, 3], [49, 50]] and raptor.cluster_counts(200) == range(1, 20) and raptor.cluster_counts(5000) == range(1, 50)
    rng = random.Random(5)
    texts = [(i, " ".join(f"topic{i % 8}word{rng.randrange(4)}" for _ in range(12))) for i in range(160)]
    levels = [level.count() for level in raptor.build(spark.createDataFrame(texts, "id long, text string"))]
    assert levels[0] == 160 and 3 < levels[1] < 16 and levels[-1] <= 5
