"""Lexical and dense retrieval over documents, benchmark questions and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylva.catalog import query, table
from sylva.functions import vectors as V
from sylva.operators import bm25, dense
from sylva.stages import stage_path

QUESTION = "the thing of reed and the ined station"

TOKENS = """t AS (SELECT doc_id AS id, string_split_regex(trim(lower(text)), '\\s+') AS ws FROM documents),
p AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(ws) AS term FROM t) GROUP BY id, term),
l AS (SELECT id, len(ws) AS dl FROM t),
c AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
d AS (SELECT term, count(*) AS df, ln(((SELECT n FROM c) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM p GROUP BY term)"""


@query(
    "bm25_topk",
    f"""WITH {TOKENS},
q AS (SELECT term, count(*) AS qtf FROM (SELECT unnest(string_split('{QUESTION}', ' ')) AS term) GROUP BY term),
s AS (SELECT p.id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
      FROM p JOIN q USING (term) JOIN d USING (term) JOIN l ON l.id = p.id CROSS JOIN c GROUP BY p.id)
SELECT l.id, coalesce(round(score, 6), 0.0) AS score FROM l LEFT JOIN s ON s.id = l.id ORDER BY score DESC, l.id LIMIT 20""",
)
def bm25_topk(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    asked = spark.createDataFrame([(0, QUESTION)], "query_id int, text string")
    found = bm25.search_docs(docs, "doc_id", "text", asked, 20)
    return bm25.filled(found, asked, docs.select(F.col("doc_id").alias("id")), 20).select("id", "score")


@query("term_stats", f"WITH {TOKENS} SELECT term, df, round(idf, 6) AS idf FROM d")
def term_stats(spark, sf_dir):
    index = bm25.build(table(spark, sf_dir, "documents"), "doc_id", "text")
    return index.terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query("corpus_averages", f"WITH {TOKENS} SELECT n, round(avgdl, 6) AS avgdl FROM c")
def corpus_averages(spark, sf_dir):
    index = bm25.build(table(spark, sf_dir, "documents"), "doc_id", "text")
    return index.corpus.select("n", F.round("avgdl", 6).alias("avgdl"))


QUERIES_BATCH = f"""WITH {TOKENS},
q AS (SELECT query_id, term, count(*) AS qtf FROM (
  SELECT item_id AS query_id, unnest(string_split_regex(trim(lower(text)), '\\s+')) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT query_id, p.id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
      FROM p JOIN q USING (term) JOIN d USING (term) JOIN l ON l.id = p.id CROSS JOIN c GROUP BY query_id, p.id)
SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10"""


@query("batch_bm25", QUERIES_BATCH)
def batch_bm25(spark, sf_dir):
    return bm25.search_docs(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), 10, "item_id", "text")


def _queries(spark, sf_dir):
    """Every vector whose id is divisible by 20: the stated query set."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))


DENSE = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.e, v.e), 6) AS similarity
      FROM v AS q JOIN v ON q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s)"""


@query("batch_dense_topk", f"WITH {DENSE} SELECT query_id, id, similarity, rank FROM r WHERE rank <= 5")
def batch_dense_topk(spark, sf_dir):
    return dense.batch_search(table(spark, sf_dir, "embeddings"), _queries(spark, sf_dir), 5)


@query(
    "dense_topk",
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT v.vec_id AS id, round(list_cosine_similarity(q.e, v.e), 6) AS similarity,
  round(1 - round(list_cosine_similarity(q.e, v.e), 6), 6) AS distance
FROM v JOIN v AS q ON q.vec_id = 0 ORDER BY similarity DESC, id LIMIT 10""",
)
def dense_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    return dense.batch_search(vectors, asked, 10).select("id", "similarity", F.round(V.cosine_distance(F.col("similarity")), 6).alias("distance"))


@query(
    "label_centroid_topk",
    """WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
m AS (SELECT label, pos, avg(x) AS x FROM x GROUP BY ALL), c AS (SELECT label, list(x ORDER BY pos) AS v FROM m GROUP BY label),
s AS (SELECT c.label AS query_id, e.vec_id AS id, round(list_cosine_similarity(c.v, CAST(e.embedding AS DOUBLE[])), 6) AS similarity FROM c, embeddings e)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s) WHERE rank <= 3""",
)
def label_centroid_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    centres = dense.centroids(vectors, "label", "embedding").select(F.col("label").cast("long").alias("query_id"), "v")
    return dense.batch_search(vectors, centres, 3)


@query(
    "cosine_by_label",
    """WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
m AS (SELECT label, pos, avg(x) AS x FROM x GROUP BY ALL), c AS (SELECT label, list(x ORDER BY pos) AS v FROM m GROUP BY label)
SELECT e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.v), 6) AS similarity,
  round((list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.v) + 1) / 2, 6) AS score FROM embeddings e JOIN c USING (label)""",
)
def cosine_by_label(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    joined = vectors.join(F.broadcast(dense.centroids(vectors, "label", "embedding")), "label")  # a row for each of the ten labels
    s = V.cosine(F.col("embedding"), F.col("v"))
    return joined.select("vec_id", F.round(s, 6).alias("similarity"), F.round(V.cosine_score(s), 6).alias("score"))


@query(
    "l2_normalized",
    """SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm,
  round(CAST(embedding[1] AS DOUBLE) / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS first FROM embeddings""",
)
def l2_normalized(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").withColumn("u", V.l2_normalize(F.col("embedding")))
    return v.select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.round(F.get("u", F.lit(0)), 6).alias("first"))


@query(
    "hybrid_union_topk",
    f"""WITH {TOKENS},
q AS (SELECT term, count(*) AS qtf FROM (SELECT unnest(string_split('{QUESTION}', ' ')) AS term) GROUP BY term),
s AS (SELECT p.id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
      FROM p JOIN q USING (term) JOIN d USING (term) JOIN l ON l.id = p.id CROSS JOIN c GROUP BY p.id),
b AS (SELECT id FROM s ORDER BY score DESC, id LIMIT 10),
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT v.vec_id AS id FROM v JOIN v AS q0 ON q0.vec_id = 0 ORDER BY round(list_cosine_similarity(q0.e, v.e), 6) DESC, id LIMIT 5)
SELECT id FROM b UNION SELECT id FROM n""",
)
def hybrid_union_topk(spark, sf_dir):
    return bm25_topk(spark, sf_dir).orderBy(F.desc("score"), "id").limit(10).select("id").union(dense_topk(spark, sf_dir).orderBy(F.desc("similarity"), "id").limit(5).select("id")).distinct()


@query("collection_without_label", "SELECT vec_id, label FROM embeddings WHERE label NOT IN (SELECT DISTINCT label FROM embeddings WHERE vec_id < 3)")
def collection_without_label(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return dense.delete(vectors, vectors.where("vec_id < 3").select("label").distinct(), "label")


@query("saved_index_search", QUERIES_BATCH)
def saved_index_search(spark, sf_dir):
    """An index saved once and searched after loading."""
    path = stage_path(spark, "bm25-index")
    bm25.build(table(spark, sf_dir, "documents"), "doc_id", "text").save(path)
    return bm25.search(bm25.load(spark, path), table(spark, sf_dir, "benchmark"), 10, "item_id", "text")


@query("filled_bm25", f"""WITH {TOKENS},
q AS (SELECT term, count(*) AS qtf FROM (SELECT unnest(['copyright', 'zzzz']) AS term) GROUP BY term),
s AS (SELECT p.id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
      FROM p JOIN q USING (term) JOIN d USING (term) JOIN l ON l.id = p.id CROSS JOIN c GROUP BY p.id)
SELECT 7 AS query_id, l.id, coalesce(score, 0.0) AS score, row_number() OVER (ORDER BY coalesce(score, 0.0) DESC, l.id) AS rank FROM l LEFT JOIN s ON s.id = l.id ORDER BY rank LIMIT 50""")
def filled_bm25(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    asked = spark.createDataFrame([(7, "copyright zzzz")], "query_id int, text string")
    return bm25.filled(bm25.search_docs(docs, "doc_id", "text", asked, 50), asked, docs.select(F.col("doc_id").alias("id")), 50)
