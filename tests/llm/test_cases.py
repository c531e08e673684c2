"""Every operator on awkward tables: nulls, empty and long texts, ties, repeated rows, clashing columns, nothing at all."""

import pytest
from pyspark.sql import functions as F

import public_tokenizers
from sylva.llm import brown, embeddings, jaccard, mixing, packing, pii, quality, sharding, urls, warc

PATH = public_tokenizers.path("word_bpe_49k.json")
LONG = "word another thing here now " * 60_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, k string, size int, head int, v int, shard int, copies int, kept int, _t int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "One plain text, to be read by all of them and kept in the end.", "en", "a"), (1, "One plain text, to be read by all of them and kept in the end.", "en", "a"),
        (2, None, None, None), (None, "a text without an id", "xx", "b"), (None, None, None, None), (3, "", "en", "b"), (4, " \t\n ", "fr", "b"),
        (5, LONG, "en", "a"), (6, "x" * 200_000, None, "c"), (7, "one two", "de", "c"), (8, "one two", "de", "c"), (9, "\x85 \u00a0 é.\u2028 ü\r\nß", "de", None),
    ]
    return spark.createDataFrame([(*r, 0, *[1] * 1, "k", *[1] * 7) for r in rows], SCHEMA).repartition(3)


def plain(df):
    return [r.asDict() for r in df.collect()]


OPERATORS = {
    "shard": lambda d: sharding.shard(d, 4, 64),
    "brown": lambda d: brown.score(d, 4),
    "quality": quality.judge,
    "kept": quality.kept,
    "pii": lambda d: pii.report(d, pii.learn(d)),
    "redact": lambda d: pii.redact(d, ["password="]),
    "mix": mixing.mix,
    "jaccard": jaccard.near_duplicates,
    "keep_one": jaccard.keep_one,
    "pack": lambda d: packing.pack_documents(d, PATH),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(name, docs):
    rows = plain(OPERATORS[name](docs))
    if name == "pack":
        assert {r["doc_id"] for r in rows} == {None, *range(1, 10)}
    elif name == "kept":
        assert {r["doc_id"] for r in rows} <= {1, 5} and all(r["n"] == 1 for r in rows)
    elif name == "keep_one":
        assert sorted(r["doc_id"] for r in rows if r["doc_id"]) == [1, 2, 3, 4, 5, 6, 7, 9]
    else:
        assert len(rows) == docs.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(name, docs):
    assert plain(OPERATORS[name](docs.limit(0))) == []


def test_shards_of_awkward_rows(docs):
    rows = plain(sharding.shard(docs, 4, 64))
    for s in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert {r["size"] for r in rows if r["doc_id"] == 2} == {16} and {r["text_crc32"] for r in rows if r["doc_id"] == 2} == {0}


def test_jaccard_of_awkward_rows(docs):
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in plain(jaccard.near_duplicates(docs))}
    assert got[8, 1] == 7 and got[7, 1] == 7 and got[2, 0] == 2 and got[3, 0] == 3 and got[4, 0] == 4 and got[5, 5] == 5


def test_scores_of_awkward_rows(docs):
    rows = {(r["doc_id"], r["n_tokens"]) for r in plain(brown.score(docs, 4))}
    assert {(2, 1), (3, 1), (4, 1), (5, 300_001), (6, 2), (7, 3)} <= rows


def test_redaction_of_awkward_rows(docs):
    rows = plain(pii.redact(docs, []))
    assert sorted(str(r["text"]) for r in rows) == sorted(str(r["text"]) for r in plain(docs)) and list(rows[0]) == docs.columns


def test_vectors(spark):
    e = [1.0] + [0.0] * 7
    near = [0.999, 0.0447] + [0.0] * 6
    nan, inf = float("nan"), float("inf")
    rows = [(5, e), (3, e), (4, near), (6, None), (7, [0.0] * 8), (8, [nan] + e[1:]), (9, [inf] + e[1:]), (10, [None] + e[1:]), (11, []), (12, [2.0] + e[1:]), (13, e[:4]), (None, e), (14, [-1.0] + e[1:]), (3, e)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"rep": F.lit(1), "v": F.lit(2), "component": F.lit(3)})
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()]
    assert len(got) == len(rows)
    # 3 (twice), 5, the nameless one and 12 point the same way; 4 is within 0.95 of them.
    assert {g for g in got if g[0] in (3, 4, 5, 12)} == {(3, 5, 3, True), (5, 5, 3, False), (12, 5, 3, False), (4, 5, 3, False)}
    assert all(g[1] == 0 and g[2] == g[0] and g[3] for g in got if g[0] in (6, 7, 8, 9, 10, 11, 13, 14))
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://"), (4, "HTTPS://WWW.Example.NET/en/x?y#z"), (5, "http://a.fr/fr/"), (6, "http://x.org/fr/"), (7, "http://example.com/de/1#a"), (8, "http://" + "a" * 50_000), (9, "http://b.net"), (10, "x://net/")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in urls.filter_urls(df, [0.0] * urls.DIM + [-1.0]).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("", "", None, "allow") == (got[2].host, got[2].path, got[2].rule, got[2].verdict)
    assert (got[4].host, got[4].path, got[4].rule, got[4].verdict) == ("www.example.net", "/en/x", "example.net/en/", "allow")
    assert (got[6].rule, got[7].rule, got[7].verdict, got[9].rule, got[10].rule) == ("org/fr/", "example.com/de/", "block", None, "net/")
    assert urls.filter_urls(df.limit(0), [0.0] * 9).count() == 0


def test_archives(spark):
    same = "<p>" + "x" * 200
    rows = [(3, "http://a/\r\nb", same), (2, "u", same), (2, "u", same), (4, None, None), (5, "u", ""), (None, "u", same), (6, "u", "short"), (7, "u", "short"), (8, "ü", "é" * 60), (9, "u", "<p>" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("first", F.lit(1))
    got = sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(df).collect())
    assert got == sorted([(3, "revisit", 2, 203), (2, "response", None, 203), (2, "response", None, 203), (4, "response", None, 0), (5, "response", None, 0), (0, "revisit", 2, 203), (6, "response", None, 5), (7, "response", None, 5), (8, "response", None, 120), (9, "response", None, 900_000)])
    assert warc.round_trip(df.limit(0)).count() == 0
