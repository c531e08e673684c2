"""Operators against brute force on the small tables, and on hot groups."""

import collections
import hashlib
import io
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from sylva.llm import _common, brown, embeddings, jaccard, mixing, packing, pii, quality, queries, sharding, urls, warc


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def words(x):
    return re.findall(r"[^\x20\x09-\x0D]+", x)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(name, spark, duck, sf_dir, same_rows):
    same_rows(queries.queries()[name](spark, sf_dir).toPandas(), duck.execute(queries.oracle_sql()[name]).df())


def test_components(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(rng.randint(2000, 2050), rng.randint(2000, 2050)) for _ in range(40)]
    got = {r.node: r.component for r in _common.components(spark.createDataFrame(chain, "a long, b long").repartition(7)).collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in chain:
        if a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    assert got == {n: find(n) for n in list(up)}


def test_sharding(spark, sf_dir, texts):
    rows = queries.op1_virtual_slot_sharding(spark, sf_dir).collect()
    loads = collections.Counter()
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        loads[r.shard] += r.size
    assert len(rows) == len(texts) and set(loads) <= set(range(40))
    assert max(loads.values()) <= max(sum(loads.values()) / 40 * 1.2, max(r.size for r in rows) * 1.05)
    again = {(r.doc_id, r.shard, r.slot) for r in queries.op1_virtual_slot_sharding(spark, sf_dir).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in rows}


def test_rebalancing_moves_few_slots():
    rng = random.Random(4)
    loads = [rng.randint(1, 1000) for _ in range(2000)]
    first = sharding.rebalance(sharding.initial_map(2000, 8), loads, 8)
    for shards in (9, 7):
        new = sharding.rebalance(first, loads, shards)
        total = [sum(w for w, s in zip(loads, new, strict=True) if s == k) for k in range(shards)]
        assert max(total) - min(total) < 0.01 * max(total) and sum(a != b for a, b in zip(first, new, strict=True)) < 2000 * 0.3


def test_embeddings(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((600, 16))
    x[100:160] = x[0] + 0.02 * rng.standard_normal((60, 16))
    x[200:330] = x[1]
    x[400:440] = x[2:42] + 0.1 * rng.standard_normal((40, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df, window=8).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(600)
    for _ in range(600):
        new = np.array([min([label[i], *label[near[i]]]) for i in range(600)])
        if (new == label).all():
            break
        label = new
    assert got == {i: (int(near[i].sum()), int(label[i])) for i in range(600)}
    assert embeddings.passes_needed(10**9) > embeddings.passes_needed(10**4)


def _cone(n: int, hot: int, dim: int = 64):
    """Vectors of which the first `hot` have cosine 0.9 with one another, and pairs among them 0.96."""
    rng = np.random.default_rng(12)
    unit = lambda a: a / np.linalg.norm(a, axis=1)[:, None]
    x = unit(rng.standard_normal((n, dim)))
    x[:hot] = unit(0.9**0.5 * x[0] + 0.1**0.5 * unit(rng.standard_normal((hot, dim))))
    x[: hot // 2] = unit(0.96 * x[hot // 2 : hot] + (1 - 0.96**2) ** 0.5 * unit(rng.standard_normal((hot // 2, dim))))
    return x


def test_links_in_a_dense_cone(spark):
    x = _cone(3000, 1000)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    want = near.sum(1)
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df, window=8).collect()}
    assert want.sum() >= 1000
    assert sum(got.values()) >= 0.995 * want.sum() and all(got[i] <= n for i, n in enumerate(want))


def test_tiles_of_runs_find_the_same(spark):
    x = _cone(800, 600)
    reps = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "rep long, v array<double>")
    rows, crowded = embeddings.keyed(reps, 800, window=8), embeddings.crowded_runs(reps, 800, window=8)
    # One component of many members, as windows would have left it.
    grouped = spark.createDataFrame([(i, 0) for i in range(200)], "rep long, component long")
    found = []
    for tile in (32, 4096):
        links = embeddings.run_links(rows, crowded, grouped, tile=tile).unionByName(grouped.select(F.col("rep").alias("a"), F.col("component").alias("b")))
        found.append({(r.node, r.component) for r in embeddings.components(links).collect()})
    assert found[0] == found[1] and len(found[0]) > 500


def test_brown(spark, sf_dir, texts):
    counts = collections.Counter()
    for i, x in texts.items():
        if zlib.crc32(str(i).encode()) % 10:
            counts.update([*words("".join(c.lower() if c.isascii() else c for c in x)), "<end>"])
    n, v = sum(counts.values()), len(counts)
    base = model = 0.0
    for r in queries.op3_brown_classes(spark, sf_dir).collect():
        ts = [*words("".join(c.lower() if c.isascii() else c for c in texts[r.doc_id])), "<end>"]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0, len(ts), sum(counts[t] > 0 for t in ts), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts), rel_tol=1e-9)
        base, model = base + r.base_score * r.held_out, model + r.score * r.held_out
    assert model > base  # better than word counts alone on texts that were held out


def test_exchange_finds_classes():
    rng = np.random.default_rng(1)
    hidden = np.arange(40) % 4
    m = np.where((hidden[:, None] + 1) % 4 == hidden[None, :], 50, 1) + rng.integers(0, 3, (40, 40))
    of = brown.exchange(m, 4)
    assert all(len(set(of[hidden == k])) == 1 for k in range(4)) and len(set(of)) == 4


def test_brown_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(i, "a b a c a b d" if i % 2 else "b a d") for i in range(40)], "doc_id long, text string")
    counts = _common.stage_table(brown.word_counts(docs), "t")
    model, _ = brown.train(docs, counts, 3)
    assert np.allclose((10**model.transitions).sum(1), 1)
    held = collections.Counter()
    units = brown._Units(model.frequent, model.suffixes)
    for w, (_, log) in model.kept.items():
        held[int(model.of[units[w]])] += 10 ** (log - model.denominators[model.of[units[w]]])
    for k, p in held.items():
        assert math.isclose(p + brown.ALPHA / 10 ** model.denominators[k], 1, rel_tol=1e-9)


def test_gains_are_those_of_exchange():
    rng = np.random.default_rng(3)
    m = rng.integers(0, 4, (30, 30)).astype(float)
    m[5], m[:, 5] = 0, 0
    m[9], m[:, 9] = 0, 0
    m[9, 9] = 3
    of = rng.integers(0, 5, 30)

    def near(u):
        own = lambda c: np.arange(30)[(of == c) & (np.arange(30) != u)]
        return np.array([m[u, own(c)].sum() for c in range(5)] + [m[own(c), u].sum() for c in range(5)] + [m[u, u]])

    def likelihood(u, c):
        one = np.eye(5)[np.where(np.arange(30) == u, c, of)]
        g = one.T @ m @ one
        return brown._xlogx(g).sum() - brown._xlogx(g.sum(0)).sum() - brown._xlogx(g.sum(1)).sum()

    one = np.eye(5)[of]
    table = np.array([near(u) for u in range(30)])
    table[5, 10] = 0
    word, slot = np.nonzero(table)
    found = brown._moved(one.T @ m @ one, of, word, slot, table[word, slot])
    for u in range(30):
        best = [likelihood(u, c) for c in range(5)]
        assert math.isclose(best[found[u]], max(best), rel_tol=1e-9)


def test_sorted_codes_are_summed_across_batches():
    rng = np.random.default_rng(4)
    codes = np.sort(rng.integers(0, 60, 400))
    n = rng.integers(1, 5, 400)
    cuts = [0, 0, 3, 5, 180, 181, 399, 400]
    batches = [pa.RecordBatch.from_arrays([pa.array(codes[i:j]), pa.array(n[i:j])], ["code", "n"]) for i, j in zip(cuts, cuts[1:])]
    parts = list(brown._summed(iter(batches), 7))
    assert {int(c): int(k) for cs, ks in parts for c, k in zip(cs, ks)} == {int(c): int(n[codes == c].sum()) for c in np.unique(codes)}
    heads = [set((cs // 7).tolist()) for cs, _ in parts]
    assert sum(map(len, heads)) == len(set.union(*heads))
    assert list(brown._summed(iter(batches[:1]), 7)) == []


def test_further_words_get_classes_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(brown, "UNITS", 11)
    rng = np.random.default_rng(4)
    tail = {kind: [f"{kind}{i}xx" for i in range(20)] for kind in "ab"}
    texts = []
    for i in range(400):
        kinds = rng.integers(0, 2, 12)
        texts.append(" ".join(f"{'pq'[k]} {tail['ab'[k]][rng.integers(3 if rng.random() < 0.5 else 20)]} {'uv'[k]}" for k in kinds))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = _common.stage_table(brown.word_counts(docs), "t")
    model, _ = brown.train(docs, counts, 6)
    units = brown._Units(model.frequent, model.suffixes, model.further)
    a, b = ({int(model.of[units[w.encode()]]) for w in tail[kind]} for kind in "ab")
    assert len(model.further) == 34 and not a & b
    assert np.allclose((10**model.transitions).sum(1), 1)
    held = collections.Counter()
    for w, (_, log) in model.kept.items():
        held[int(model.of[units[w]])] += 10 ** (log - model.denominators[model.of[units[w]]])
    for k, p in held.items():
        assert math.isclose(p + brown.ALPHA / 10 ** model.denominators[k], 1, rel_tol=1e-9)


def test_brown_score_is_that_of_a_plain_class_bigram_model(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"{'abcd'[k]}{rng.integers(30)}" for k in rng.integers(0, 4, rng.integers(0, 40))) for _ in range(300)] + [None, "new words Only here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    model, _ = brown.train(docs, _common.stage_table(brown.word_counts(docs), "t"), 5)
    units = brown._Units(model.frequent, model.suffixes, model.further)
    cls = lambda w: int(model.of[units[w]])
    tokens = {i: [w.lower().encode() for w in (x or "").split()] + [b""] for i, x in enumerate(texts)}
    counts, pairs = collections.Counter(), collections.Counter()
    for i, ws in tokens.items():
        if zlib.crc32(str(i).encode()) % 10:
            counts.update(ws)
            pairs.update((cls(a), cls(b)) for a, b in zip([b"", *ws], ws))
    classes, total = len(model.transitions), sum(pairs.values())
    single = [(sum(n for (_, d), n in pairs.items() if d == c) + brown.ALPHA) / (total + brown.ALPHA * classes) for c in range(classes)]

    def p(a, b):
        follows = {d: n for (c, d), n in pairs.items() if c == a}
        kinds = max(len(follows), 1)
        return (follows.get(b, 0) + kinds * single[b]) / (sum(follows.values()) + kinds)

    room = [brown.ALPHA + sum(counts[w] + brown.ALPHA for w in counts if cls(w) == c) for c in range(classes)]
    for r in brown.score(docs, 5).collect():
        ws = tokens[r.doc_id]
        plain = sum(math.log10(p(cls(a), cls(b)) * (counts[b] + brown.ALPHA) / room[cls(b)]) for a, b in zip([b"", *ws], ws))
        assert math.isclose(r.score, plain, rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r.perplexity, 10 ** (-plain / len(ws)), rel_tol=1e-9)


def test_words_beyond_those_kept_get_classes_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(brown, "UNITS", 11)
    monkeypatch.setattr(brown, "KEPT", 15)
    monkeypatch.setattr(brown, "MOST_FURTHER", 5, raising=False)
    rng = np.random.default_rng(6)
    ids = {out: [i for i in range(5000) if brown.held_out(i) == out] for out in (False, True)}
    tail = {kind: [f"{kind}{i}xx" for i in range(40)] for kind in "ab"}
    texts, times = [], collections.Counter()
    for _ in range(200):
        kinds = rng.integers(0, 2, 6)
        chosen = [tail["ab"[k]][rng.integers(3) if rng.random() < 0.5 else min(3 + int(rng.exponential(7)), 39)] for k in kinds]
        times.update(chosen)
        texts.append(" ".join(f"{'pq'[k]} {w} {'uv'[k]}" for k, w in zip(kinds, chosen)))
    probes = [f"{'pq'[k]} {w} {'uv'[k]}" for w in times for k in (0, 1)]
    docs = spark.createDataFrame([*zip(ids[False], texts), *zip(ids[True], probes)], "doc_id long, text string").repartition(3)
    of = dict(zip(ids[True], probes))
    # beyond the counts of words: how well each stands between p and u, less how well between q and v
    fits = {of[r.doc_id]: r.score - r.base_score for r in brown.score(docs, 6).collect() if r.held_out}
    better = {w: fits[f"p {w} u"] - fits[f"q {w} v"] for w in times}
    assert min(times.values()) == 1 and len(times) > 50
    assert min(x for w, x in better.items() if w[0] == "a") > max(x for w, x in better.items() if w[0] == "b")


def test_rare_words_go_where_the_likelihood_is_greatest(spark):
    rng = np.random.default_rng(11)
    texts = [" ".join(f"w{min(int(rng.exponential(9)), 60)}" for _ in range(rng.integers(0, 25))) for _ in range(90)] + ["z z z w1 z z", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept, first, classes = [b"", b"w0", b"w1", b"w2"], 3, 5
    units = brown._Units(kept[:first], brown.SUFFIXES)
    of_kept, of = np.array([units[w] for w in kept]), rng.integers(0, classes, first + brown.SUFFIXES)
    tokens = [[b"", *(x or "").encode().split(), b""] for i, x in enumerate(texts) if not brown.held_out(i)]
    pairs = collections.Counter((a, b) for ws in tokens for a, b in zip(ws, ws[1:]))

    def bigrams(word=None, c=None):
        g = np.zeros((classes, classes))
        for (a, b), n in pairs.items():
            g[c if a == word else of[units[a]], c if b == word else of[units[b]]] += n
        return g

    def likelihood(g):
        return brown._xlogx(g).sum() - brown._xlogx(g.sum(0)).sum() - brown._xlogx(g.sum(1)).sum()

    placed = {bytes(r.word): (r.c, r["class"]) for r in brown.place_rare(brown.encode(docs, kept), of_kept, first, of, bigrams()).collect()}
    counts = collections.Counter(w for ws in tokens for w in ws[1:])
    assert {w: c for w, (c, _) in placed.items()} == {w: c for w, c in counts.items() if w not in kept}
    for w, (_, c) in placed.items():
        assert math.isclose(likelihood(bigrams(w, c)), max(likelihood(bigrams(w, k)) for k in range(classes)), rel_tol=1e-9)


def test_brown_score_with_words_beyond_those_kept_is_that_of_a_plain_model(spark, monkeypatch):
    monkeypatch.setattr(brown, "UNITS", 9)
    monkeypatch.setattr(brown, "KEPT", 30)
    rng = np.random.default_rng(9)
    texts = [" ".join(f"{'abcd'[k]}{min(int(rng.exponential(12)), 99)}" for k in rng.integers(0, 4, rng.integers(0, 40))) for _ in range(200)] + [None, "new words Only here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    model, _ = brown.train(docs, _common.stage_table(brown.word_counts(docs), "t"), 5)
    units = brown._Units(model.frequent, model.suffixes, model.further)
    placed = {bytes(r.word): r["class"] for r in model.placed.collect()}
    cls = lambda w: placed[w] if w in placed else int(model.of[units[w]])
    tokens = {i: [w.lower().encode() for w in (x or "").split()] + [b""] for i, x in enumerate(texts)}
    counts, pairs = collections.Counter(), collections.Counter()
    for i, ws in tokens.items():
        if not brown.held_out(i):
            counts.update(ws)
            pairs.update((cls(a), cls(b)) for a, b in zip([b"", *ws], ws))
    assert len(placed) > 50 and set(placed) | set(model.kept) == set(counts)
    g = np.zeros(model.transitions.shape)
    for (a, b), n in pairs.items():
        g[a, b] = n
    single = (g.sum(0) + brown.ALPHA) / (g.sum() + brown.ALPHA * len(g))
    kinds = np.maximum((g > 0).sum(1, keepdims=True), 1)
    p = (g + kinds * single) / (g.sum(1, keepdims=True) + kinds)
    room = [brown.ALPHA + sum(counts[w] + brown.ALPHA for w in counts if cls(w) == c) for c in range(len(g))]
    n, v = sum(counts.values()), len(counts)
    for r in brown.score(docs, 5).collect():
        ws = tokens[r.doc_id]
        plain = sum(math.log10(p[cls(a), cls(b)] * (counts[b] + brown.ALPHA) / room[cls(b)]) for a, b in zip([b"", *ws], ws))
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert math.isclose(r.score, plain, rel_tol=1e-9, abs_tol=1e-9) and math.isclose(r.base_score, base, rel_tol=1e-9)
        assert (r.n_tokens, r.n_known) == (len(ws), sum(counts[w] > 0 for w in ws))


def test_rows_of_a_word_stay_together_across_batches():
    rng = np.random.default_rng(5)
    words = sorted(f"w{i}".encode() for i in rng.integers(0, 40, 300))
    cuts = [0, 0, 1, 2, 150, 151, 152, 299, 300]
    batches = [pa.RecordBatch.from_arrays([pa.array(words[i:j], pa.binary()), pa.array(np.arange(i, j))], ["word", "seen"]) for i, j in zip(cuts, cuts[1:])]
    parts = [(d.to_pylist(), of, v) for d, of, v in brown._whole_words(iter(batches))]
    assert [(d[k], int(x)) for d, of, v in parts for k, x in zip(of, v, strict=True)] == list(zip(words, range(300)))
    assert sum(len(d) for d, _, _ in parts) == len(set(words)) and list(brown._whole_words(iter(batches[:1]))) == []


def test_quality(spark, sf_dir, texts):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    right = []
    for r in queries.op4_divergence_quality(spark, sf_dir).collect():
        x = texts[r.doc_id]
        ws = words(x)
        seen = collections.defaultdict(list)
        for i in range(len(ws) - 7):
            seen[tuple(ws[i : i + 8])].append(i)
        again = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
        lines = [s for s in x.split("\n") if words(s)]
        failed = len(ws) < 20 or 100 * len(again) > 30 * len(ws)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(again), failed)
        assert not (failed and r.kept)
        if r.doc_id in labels and not failed:
            right.append(r.kept == bool(labels[r.doc_id]))
    assert sum(right) >= 0.95 * len(right)


def test_distances_are_those_of_a_plain_version(spark, sf_dir, texts):
    def distance(p, q):
        part = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b, strict=True) if x > 0)
        return math.sqrt(max(0.0, (part(p, q) + part(q, p)) / 2))

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 400")
    langs = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    known = quality.COMMON_WORDS
    for r in quality.judge(docs).collect():
        x, ws = texts[r.doc_id], words(texts[r.doc_id])
        lower = [w.lower() for w in ws]
        lang = langs[r.doc_id] if langs[r.doc_id] in known else max((sum(w in known[k] for w in lower), k) for k in known)[1]
        counts = [len(re.findall(c, x)) for c in ("[A-Z]", "[0-9]", r"[\x20\x09-\x0D]", quality.STOPS, quality.SYMBOLS)] + [len(x.encode()) - len(x)]
        every = [max(len(x) - sum(counts), 0), *counts]
        shares = [v / sum(quality.CHAR_SHARES[lang]) for v in quality.CHAR_SHARES[lang]]
        expected = distance([c / sum(every) for c in every], shares) if sum(every) else 0.0
        assert math.isclose(r.char_distance, expected, rel_tol=1e-9, abs_tol=1e-7), r.doc_id
        if ws:
            listed = [lower.count(w) for w in known[lang]]
            q = [v / 1000 for v in known[lang].values()]
            expected = distance([c / len(ws) for c in (*listed, len(ws) - sum(listed))], [*q, 1 - sum(q)])
            assert math.isclose(r.word_distance, expected, rel_tol=1e-9, abs_tol=1e-7), r.doc_id


def test_references_are_built_from_a_corpus(spark):
    docs = spark.createDataFrame([(1, "The cat. the dog 12", "en"), (2, "le chat é", "fr"), (3, None, "fr"), (4, "x", None)], "doc_id long, text string, lang string")
    common, shares = quality.references(docs, most=2)
    assert list(common["en"].items()) == [("the", 400.0), ("12", 200.0)] and set(common) == set(shares) == {"en", "fr"}
    assert shares["en"] == pytest.approx([1000 * n / 19 for n in (11, 1, 2, 4, 1, 0, 0)]) and shares["fr"][6] == pytest.approx(1000 / 9)
    assert {r.doc_id for r in quality.judge(docs, common_words=common, char_shares=shares).collect()} == {1, 2, 3, 4}


def test_divergence(spark):
    row = spark.createDataFrame([(0.5, 0.5), (1.0, 0.0), (0.0, 1.0), (0.25, 0.75)], "p double, q double").select((quality.term(F.col("p"), F.col("q")) / 2).alias("t")).collect()
    assert [round(r.t, 6) for r in row][0] == 0.0 and row[1].t == row[2].t == 0.5


EMAIL, IP = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD, PHONE = r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"


def base_spans(x):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for kind, p in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)):
        for m in re.finditer(p, x):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(v) <= 255 for v in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii(spark, sf_dir, texts):
    for r in queries.op5_bootstrapped_pii(spark, sf_dir).collect():
        found = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest() and r.spans.startswith(",".join(found))


def test_pii_on_hard_texts(spark):
    hard = ["a@b.c_d@e.f.g x@y@z.w 1.2.3.4.5.6.7.8 300.1.1.1", "1" * 3000, "4111 1111 1111 1111-4111-1111-1111-1111", "+1 (2) 3.4-5 6789 +12+345678901234567 é +49 30 1234567.", "a" * 20_000 + "@b.c", "1.1.1.1 " * 1500, ".".join(["7"] * 900), "é@x.y ü1.2.3.4"]
    df = spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string")
    for r in pii.report(df, []).collect():
        assert r.spans.split(",id:")[0] == ",".join(base_spans(hard[r.doc_id])), hard[r.doc_id][:50]


def test_redacted_texts_are_those_with_the_spans_replaced(spark, sf_dir, texts):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    patterns = pii.learn(docs)
    clean = {r.doc_id: r.text for r in pii.redact(docs, patterns).collect()}
    held = 0
    for r in pii.report(docs, patterns).collect():
        spans = sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in r.spans.split(",") if x))
        if any(a[1] > b[0] for a, b in zip(spans, spans[1:])):
            continue  # base kinds may overlap one another: what is left of the second is not redacted
        x, at, parts = texts[r.doc_id], 0, []
        for s, e, k in spans:
            parts += [x[at:s], f"<{k}>"]
            at, held = e, held + 1
        if r.text is not None:
            assert clean[r.doc_id] == "".join(parts) + x[at:], r.doc_id
    assert held > 20


def test_bootstrap_discovers_by_context(spark):
    known = [(i, f"please mail contact: user{i}@site.example.com today") for i in range(8)] + [(20 + i, f'the token = "{i:04x}9c3ab17e{i:08x}" is set') for i in range(6)]
    new = [(90, "please mail contact: user77-at-site today"), (91, 'a token = "zz81-new" here'), (92, "note: 1995 was fine and it was so"), (93, "note: twenty of them")]
    df = spark.createDataFrame(known + new, "doc_id long, text string")
    patterns = pii.learn(df)
    assert set(patterns) == {"contact: ", 'token = "'}
    got = {r.doc_id: r.spans for r in pii.report(df, patterns).collect()}
    assert got[90] == "id:21:35" and got[91] == "id:11:19" and got[92] == "" and got[93] == ""
    clean = {r.doc_id: r.text for r in pii.redact(df, patterns).collect()}
    assert clean[0] == "please mail contact: <email> today" and clean[90] == "please mail contact: <id> today" and clean[91] == 'a token = "<id>" here' and clean[92] == new[2][1]


def test_long_secrets_are_found_whole(spark):
    secret, key = "Zx9-" * 250, "0a" * 200
    texts = {1: f'the token = "{secret}" is set', 2: f"see {key} here", 3: f"so token = {secret}?!", 4: f"see {'7' * 400} {'a' * 400} {key}g"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    patterns = ['token = "', "token = "]
    got = {r.doc_id: r.spans for r in pii.report(df, patterns).collect()}
    assert got == {1: "id:13:1013", 2: "id:4:404", 3: "id:11:1011", 4: ""}
    clean = {r.doc_id: r.text for r in pii.redact(df, patterns).collect()}
    assert clean == {1: 'the token = "<id>" is set', 2: "see <id> here", 3: "so token = <id>?!", 4: texts[4]}
    taught = spark.createDataFrame([(i, f"a secret={i:04x}{key} b") for i in range(4)], "doc_id long, text string")
    assert pii.learn(taught) == ["secret="]


def test_url_model_on_urls_held_out(spark):
    weights = urls.train(urls.labelled_urls(spark))
    bad = "https://www.bestcasinos.net/play http://online-poker.co/win https://cheapviagra.info/ https://pornvideos.tv/watch/1 http://torrentz.to/film https://sexchat.site/ http://getpills.biz/buy https://liveroulette.com/table https://spammers.biz/x http://malware-host.ru/a.exe".split()
    good = "https://www.citylibrary.org/hours http://sciencedaily.info/new https://gardenworld.com/tips https://schooltimes.net/ http://weatherstation.eu/today https://historymuseum.org/visit https://bakery-recipes.com/bread http://universitypress.org/books https://photogallery.net/a https://climbingnews.com/alps".split()
    got = urls.filter_urls(spark.createDataFrame([(u, True) for u in bad] + [(u, False) for u in good], "url string, bad boolean"), weights, rules=()).collect()
    assert sum((r.verdict == "block") == r.bad for r in got) >= 17


def test_urls_against_a_plain_version(spark, sf_dir):
    import xxhash

    weights = urls.train(urls.labelled_urls(spark))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    odd = ["no scheme", None, "HTTP://EX.Example.NET/en/x?y#z", "a://b://c/d", "x://", "https://example.com?de/", "ftp://sub.example.com/de/a#b", "http://ÄExample.org/fr/ü", "http://notexample.net", "s://net/", "q://a.net"]
    extra = spark.createDataFrame([(-i - 1, u) for i, u in enumerate(odd)], "page_id long, url string")
    for r in urls.filter_urls(pages.unionByName(extra), weights).collect():
        u = r.url or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [(len(h + b), h + b, what) for what, h, b in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(b)]
        rule = max(fits)[1] if fits else None
        assert (r.host, r.path, r.rule) == (host, path, rule), u
        marked = re.sub("[0-9]", "0", f"^{host}$") + re.sub("[0-9]", "0", path.lower()) if host or path else ""
        ids = set()
        for n in urls.GRAMS:
            for i in range(len(marked) - n + 1):
                h = 42
                for c in marked[i : i + n]:
                    h = xxhash.xxh64_intdigest(c.encode(), seed=h)
                ids.add((h - (1 << 64) * (h >> 63)) % urls.DIM)
        assert math.isclose(r.url_score, sum(weights[i] for i in ids) + weights[-1], rel_tol=1e-9, abs_tol=1e-9), u
        assert r.verdict == (max(fits)[2] if fits else "block" if r.url_score > 0 else "allow")


def test_pareto_sample_is_that_of_a_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    u = {r.doc_id: r.u for r in docs.select("doc_id", _common.uniform(F.col("doc_id"), F.coalesce("source", F.lit("")), F.xxhash64("text"), seed=mixing.SEED).alias("u")).collect()}
    by = collections.defaultdict(list)
    for r in mixing.mix(docs).collect():
        by[r.source].append(r)
    for rows in by.values():
        expected = min(3.0, rows[0].target / rows[0].source_size)
        sure, p = math.floor(expected), expected - math.floor(expected)
        wanted, before = rows[0].target - sure * rows[0].source_size, 0
        odds = lambda x: x / (1 - x)
        for r in sorted(rows, key=lambda r: (odds(u[r.doc_id]) / odds(p) if p else 0, r.doc_id)):
            more = int(p > 0 and before + r.size / 2 <= wanted)
            before += r.size
            assert r.size == 0 or r.copies == sure + more, r.doc_id


def test_mixing_carries_rows_repeated_under_one_id(spark):
    rows = [(i % 100, f"text {i} " * 20, "abc"[i % 3]) for i in range(300)]
    df = spark.createDataFrame(rows + rows[:30], "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(df, carry=["doc_id", "text", "source"]).collect()
    assert len(got) == 330 and sorted((r.row.doc_id, r.row.text) for r in got) == sorted((a, b) for a, b, _ in rows + rows[:30])
    for (target,), own in ((k, [r for r in got if (r.target,) == k]) for k in {(r.target,) for r in got}):
        assert abs(sum(r.taken for r in own) - target) <= max(r.size for r in own)


def test_the_slot_map_is_stored_and_edited(spark, tmp_path):
    path = f"file://{tmp_path}/map"
    docs = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(3000)], "doc_id long, text string")
    first = {r.doc_id: (r.shard, r.map_version) for r in sharding.shard(docs, 4, 256, path).collect()}
    version, before = sharding.stored_map(spark, path)
    again = {r.doc_id: (r.shard, r.map_version) for r in sharding.shard(docs, 4, 256, path).collect()}
    assert again == first and sharding.stored_map(spark, path) == (version, before)
    grown = {r.doc_id: r.shard for r in sharding.shard(docs, 5, 256, path).collect()}
    later, after = sharding.stored_map(spark, path)
    assert later == version + 1 and set(after) == set(range(5)) and sum(a != b for a, b in zip(before, after)) < 256 * 0.35
    assert sum(grown[i] != first[i][0] for i in grown) < 3000 * 0.35


def test_mixing(spark, sf_dir):
    rows = queries.op7_pareto_mixing(spark, sf_dir).collect()
    assert all(r.taken == r.copies * r.size and r.copies <= 3 for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source_size, r.target].append(r)
    total = sum(r.size for r in rows)
    assert math.isclose(sum(t for _, t in by), total, rel_tol=1e-9)
    for (size, target), own in by.items():
        assert target <= 3 * size + 1e-6 and abs(sum(r.taken for r in own) - target) <= max(r.size for r in own)


def test_targets_stop_at_their_caps(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 30)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    left = 2040 - 30 - 90
    assert got == pytest.approx({"a": 30, "b": left * 2 / 3, "c": left / 3, None: 90})


def test_pareto_inclusion_follows_importance(spark):
    rows = [(i, "word " * 10, "ab"[i % 2], float(1 + i % 4)) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, weight double")
    got = mixing.mix(df, weights=(3.0, 1.0), importance="weight").join(df.select("doc_id", "weight"), "doc_id").where("source = 'b'").groupBy("weight").agg(F.avg("copies").alias("c")).collect()
    rate = {r.weight: r.c for r in got}
    assert rate[4.0] == pytest.approx(2 * rate[2.0], rel=0.15)


def shingles(x):
    ws = words("".join(c.lower() if c.isascii() else c for c in x))
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()


def test_jaccard_on_hot_groups(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, seed = text(14), text(90)
    rows = [" ".join(passage + text(rng.randint(6, 60))) for _ in range(150)]
    for _ in range(120):
        copy = list(seed)
        copy[rng.randrange(90)] = rng.choice(vocabulary)
        rows.append(" ".join(copy))
    rows += [" ".join(seed)] * 80
    for n in (5, 6, 9, 14, 19, 24, 30):
        a = text(n)
        rows += [" ".join(a), " ".join(a + text(1)), " ".join(a[1:]), " ".join(a + text(3))]
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    sets = [shingles(x) for x in rows]
    up = list(range(len(rows)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in range(len(rows))}


def test_boundary_follows_cost():
    assert jaccard.choose_boundary({10: 100}, scan_cost=100.0) >= 10
    assert jaccard.choose_boundary({40: 100, 45: 10}, scan_cost=0.0) < 40


def test_packing(spark, sf_dir, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = queries.op9_residual_packing(spark, sf_dir).collect()
    got = {(r.doc_id, r.piece): r for r in rows}
    n = 0
    for i, x in texts.items():
        ids = np.array([*tokenizer.encode(x, add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            part, r = ids[at : at + 2048], got[i, k]
            assert (r.start, r.length, r.ids_crc32) == (at, len(part), zlib.crc32(part.tobytes()))
            n += 1
    assert n == len(rows)
    check_places(rows, 2048)
    assert len({r.sequence_id for r in rows}) <= 1.02 * math.ceil(sum(r.length for r in rows) / 2048) + 1


def check_places(rows, width):
    at = collections.Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert max(at.values()) <= width


def test_packing_in_a_tree(spark):
    rng = random.Random(9)
    rows = [(i, 0, 0, rng.choice((rng.randint(1, 100), rng.randint(40, 70), 100)), 0) for i in range(3000)]
    packed = packing.pack(spark.createDataFrame(rows, packing.PIECES), width=100, slack=2, group_items=100, fan=3).collect()
    check_places(packed, 100)
    assert sorted(r.doc_id for r in packed) == list(range(3000))
    assert len({r.sequence_id for r in packed}) <= 1.1 * sum(r[3] for r in rows) / 100
    same = [(i, 0, 0, 60, 0) for i in range(500)]  # no two fit together: nothing may be lost
    packed = packing.pack(spark.createDataFrame(same, packing.PIECES), width=100, group_items=50).collect()
    assert len({r.sequence_id for r in packed}) == 500


def test_ids_do_not_depend_on_neighbours():
    chunks = packing._Chunks(public_tokenizers.path("word_bpe_49k.json"))
    for x in ("a<|endoftext|>b c", "Don't. stop. x", "é. é, ... x", "3.14, 5. \n6,\n", "A b. c\x85d", "<|STARTOFTEXT|> x", "’s it's.", "I.\u0301 x", " .5, ,. ,", " ẞ. İ, x", "\x01 a\x01b c", "", " \n"):
        assert np.frombuffer(chunks.ids(x.encode()), "<u4").tolist() == chunks.tokenizer.encode(x, add_special_tokens=False).ids


def test_archive_reader_pushes_down(spark, sf_dir, tmp_path):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = f"file://{tmp_path}/a"
    warc.write_pages(pages.unionByName(pages.withColumn("page_id", F.col("page_id") + 10_000)), path)
    read = spark.read.format("warc").option("payload", "false").load(path)
    assert read.count() == 2 * pages.count() and read.where("payload is not null").count() == 0
    assert read.where("record_type = 'revisit'").count() == pages.count()
    one = spark.read.format("warc").load(path).where("record_id = 'urn:x-page:7'")
    assert one.first().payload.decode() == pages.where("page_id = 7").first().html
    assert "PushedFilters" in one._jdf.queryExecution().toString() or one.count() == 1


def test_other_archives_are_read():
    """Plain files, one gzip member for a record without a length, and several blocks."""
    rows = [{"record_type": "response", "record_id": f"r{i}", "target_uri": "u", "payload": b"x" * (i * 50_000)} for i in range(4)]
    plain = b"".join(warc.record_bytes(r) for r in rows)
    gz = b"".join((c := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(warc.record_bytes(r)) + c.flush() for r in rows)
    for data, packed in ((plain, False), (gz, True), (b"".join(warc.member(warc.record_bytes(r), 1) for r in rows), True)):
        found = list(warc.read_records(io.BytesIO(data), packed, lambda r: r["record_id"] != "r2", True))
        assert [(r["record_id"], len(r["payload"])) for r in found] == [("r0", 0), ("r1", 50_000), ("r3", 150_000)]
