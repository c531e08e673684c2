"""Cases of the findings of round 3."""

import collections

import numpy as np
from pyspark.sql import functions as F

from sylva.operators import graph, walks
from sylva.plans import linking, providers, strategies


def test_all_sections_that_share_a_word_are_ranked(spark):
    """the best section stands behind more than 16 that share as many words."""
    nodes = [(i, None, "moss moss stone" if i < 40 else "moss stone") for i in range(41)]
    frame = spark.createDataFrame(nodes, "node_id long, parent_id long, text string")

    class Short(providers.Reranker):
        def score(self, query, texts):
            return [1 / len(t) for t in texts]

    questions = spark.createDataFrame([(1, "moss and stone")], "query_id long, question string")
    none = spark.createDataFrame([], "query_id long, node string, similarity double")
    mentions = spark.createDataFrame([(0, "Nobody")], "node_id long, node string")
    got = linking.select_sections(questions, none, mentions, frame, linking.sections(frame, 0), Short(), 1).collect()
    assert [r.section for r in got] == [40]


def test_whole_texts_are_scored(spark):
    """a word behind the thousandth counts."""
    nodes = spark.createDataFrame([(1, "filler " * 1500 + "heather"), (2, "filler")], "node_id long, text string")
    questions = spark.createDataFrame([(7, "Where is heather")], "query_id long, question string")
    mentions = spark.createDataFrame([(1, "Heather"), (2, "Heather")], "node_id long, node string")
    edges = spark.createDataFrame([("Heather", "Moss", 1.0)], "src string, dst string, weight double")
    inputs = strategies.Inputs(questions, nodes, mentions, edges)
    got = {r.node_id: r.score for r in strategies.retrieve("planned", inputs, "wo_graph").collect()}
    assert got == {1: 1 / 3, 2: 0.0}


def test_walks_in_groups_and_pieces(spark, monkeypatch):
    """More queries than groups; the nodes' sums are those of the joined ranks; copies tie by id."""
    rng = np.random.default_rng(5)
    edges = [(f"e{a}", f"e{b}", float(w)) for a, b, w in zip(rng.integers(0, 60, 200), rng.integers(0, 60, 200), rng.integers(0, 4, 200)) if a != b]
    edges = spark.createDataFrame(edges, "src string, dst string, weight double")
    seeds = spark.createDataFrame([(q, f"e{(q * 7 + i) % 60}", 0.5) for q in range(30) for i in range(2)], "query_id long, node string, p double")
    mentions = [(int(n), f"e{x}") for n in range(50) for x in set(rng.integers(0, 60, 5))]
    mentions = spark.createDataFrame(mentions + [(n + 100, x) for n, x in mentions], "node_id long, node string")
    of = walks.Walks(edges, seeds, 0.5, 4)
    got = {(r.query_id, r.node_id): r.g for r in of.run(of.rows(mentions), lambda: walks.Best(5, 0.0)).collect()}
    sums = graph.pagerank_each(edges, seeds, 0.5, 4).join(mentions, "node").groupBy("query_id", "node_id").agg(F.sum("rank").alias("g")).collect()
    each = collections.defaultdict(list)
    for r in sums:
        each[r.query_id].append((-round(r.g, 12), r.node_id))
    want = {(q, n): -g for q, rows in each.items() for g, n in sorted(rows)[:5]}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_front_and_skyline_in_pieces():
    rng = np.random.default_rng(3)
    t, g, ids = rng.integers(0, 8, 300) / 8, rng.integers(0, 8, 300) / 8, np.arange(300)
    better = lambda i, j: t[j] >= t[i] and g[j] >= g[i] and (t[j] > t[i] or g[j] > g[i])
    assert walks.front(t, g).tolist() == [not any(better(i, j) for j in range(300)) for i in range(300)]
    whole, pieces = walks.Skyline(10, 3), walks.Skyline(10, 3)
    whole.add(ids, t, g)
    for i in range(0, 300, 7):
        pieces.add(ids[i : i + 7], t[i : i + 7], g[i : i + 7])
    assert sorted(whole.result()[0]) == sorted(pieces.result()[0])


def test_trees_against_plain_versions(spark):
    """Trees of all shapes, parents that are not there, nulls, by layers."""
    from sylva.operators import tree

    rng = np.random.default_rng(11)
    up = {i: (i // 40 * 40 + int(rng.integers(0, i % 40)) // 6 if i % 40 else (None if i % 80 else 9999)) for i in range(200)}
    value = {i: None if i % 7 == 0 else float(i) for i in up}
    nodes = spark.createDataFrame([(i, p, value[i]) for i, p in up.items()], "node_id long, parent_id long, value double")
    chain = lambda i: [i] + (chain(up[i]) if up[i] in up else [])
    of = {i: chain(i) for i in up}
    got = tree.closure(nodes).collect()
    assert sorted((r.node_id, r.ancestor_id, r.dist) for r in got) == sorted((i, a, d) for i, c in of.items() for d, a in enumerate(c))
    assert {r.node_id: r.depth for r in tree.with_depth(nodes).collect()} == {i: len(c) - 1 for i, c in of.items()}
    want = {i: [a for a in c[::-1] if up[a] is not None] for i, c in of.items()}
    assert {r.node_id: r.path for r in tree.paths(nodes).collect()} == {i: p for i, p in want.items() if p}
    assert {r.node_id: r.ancestor_id for r in tree.ancestor_at(nodes, 2).collect()} == {i: c[-3] for i, c in of.items() if len(c) > 2}
    sums = {i: [value[j] for j, c in of.items() if i in c and value[j] is not None] for i in of}
    assert {r.node_id: r.total for r in tree.roll_up(nodes, "value").collect()} == {i: sum(s) if s else None for i, s in sums.items()}
    roots = spark.createDataFrame([(5,), (41,), (43,), (12345,)], "node_id long")
    assert sorted(r.node_id for r in tree.subtree(nodes, roots).collect()) == sorted(i for i, c in of.items() if {5, 41, 43} & set(c))
    kids = collections.defaultdict(list)
    for i, c in of.items():
        kids[c[1] if len(c) > 1 else None].append(i)

    def visit(i):
        yield i
        for k in sorted(kids[i]):
            yield from visit(k)

    ranks = {i: (root, n) for root in kids[None] for n, i in enumerate(visit(root), 1)}
    assert {r.node_id: (r.root, r["rank"]) for r in tree.preorder(nodes).collect()} == ranks


def test_pairs_of_vectors_in_tiles(spark):
    """Blocks of several sizes, ties, and pieces smaller than a tile give what brute force gives."""
    from sylva.operators import dense

    rng = np.random.default_rng(2)
    rows = [(i * 3, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(120)]
    rows = [(i, v if any(v) else [1.0, 0.0, 0.0, 0.0]) for i, v in rows]
    df = spark.createDataFrame([(*r, int(r[0]) % 4 + 1) for r in rows] + [(1, None, 1)], "vec_id long, embedding array<double>, most int")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    near = {(i, j): round(float(unit[i] @ unit[j]), 6) for i in unit for j in unit if i < j and round(float(unit[i] @ unit[j]), 6) > 0.5}
    for tile in (16, 4096):
        assert {(r.src, r.dst): r.similarity for r in dense.pairs_above(df, 0.5, tile=tile).collect()} == near
        sums = {r.node: (r.s, r.n) for r in dense.sums_above(df, 0.5, tile=tile).collect()}
        want = {j: [(s + 1) / 2 for (_, y), s in near.items() if y == j] for j in {y for _, y in near}}
        assert set(sums) == set(want) and all(abs(sums[j][0] - sum(w)) < 1e-9 and sums[j][1] == len(w) for j, w in want.items())
        best = collections.defaultdict(list)
        for r in dense.nearest_above(df, 0.5, "most", tile=tile).collect():
            best[r.a].append((-r.similarity, r.b))
        for a in unit:
            k = a % 4 + 1
            assert sorted(best[a])[:k] == sorted((-s, x + y - a) for (x, y), s in near.items() if a in (x, y))[:k]


def test_rows_in_batches_one_by_one(spark):
    """lines of several tables, longer than a batch, empty and null, in their order."""
    from sylva.operators import extract

    rng = np.random.default_rng(4)
    lines = [(f"k{i % 3}", i, None if i == 9 else " ".join(["w"] * int(rng.integers(0, 8)))) for i in range(200)]
    df = spark.createDataFrame(lines, "k string, row int, line string").repartition(7)
    got = {(r.k, r.batch): r.text for r in extract.row_batches(df, "k", "row", "line", 6).collect()}
    for k in ("k0", "k1", "k2"):
        batches, held = [], 7
        for t in [x for a, _, x in lines if a == k]:
            n = len((t or "").split())
            if not batches or held + n > 6:
                batches, held = [*batches, []], 0
            batches[-1] += [] if t is None else [t]
            held += n
        assert {i: "\n".join(b) for i, b in enumerate(batches)} == {i: t for (a, i), t in got.items() if a == k}


def test_closest_names_of_all_lengths(spark):
    """F8: names of 1 to 32 letters, near and far, against brute force; names that share their first half only do not meet."""
    from sylva.operators import entities

    rng = np.random.default_rng(6)
    known = ["".join(rng.choice(list("ab"), int(n))) for n in rng.integers(1, 33, 150)]

    def changed(w, times):
        for _ in range(times):
            i = int(rng.integers(0, len(w) + 1))
            w = [w[:i] + "c" + w[i:], w[:i] + w[i + 1 :], w[:i] + "c" + w[i + 1 :]][int(rng.integers(0, 3))]
        return w

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    asked = sorted({changed(w, int(rng.integers(0, 5))) for w in known} - {""})
    want = {}
    for a in asked:
        near = [(distance(a, w) / max(len(a), len(w)), w) for w in set(known)]
        near = [(d, w) for d, w in near if 1 - d >= 0.9]
        if near:
            want[a] = min(near)[1]
    frame = lambda ws, c: spark.createDataFrame([(1, w) for w in ws], f"block int, {c} string").distinct()
    assert {r.asked: r.name for r in entities.closest_names(frame(asked, "asked"), frame(known, "name"), "block").collect()} == want
