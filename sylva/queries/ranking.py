"""Score merging, skylines, cuts, dedup, splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylva.catalog import query, table
from sylva.operators import rank

SALES = "SELECT l_partkey AS id, round(sum(l_extendedprice * (1 - l_discount)), 4) AS score FROM lineitem GROUP BY l_partkey"


def _scores(spark, sf_dir):
    text = table(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score"))
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 20")
    graph = lines.groupBy(F.col("l_partkey").alias("id")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("score"))
    return rank.merge_scores([text, graph], "id")


MERGED = """m AS (SELECT coalesce(a.id, b.id) AS id, coalesce(a.score, 0.0) AS score_0, coalesce(b.score, 0.0) AS score_1
  FROM (SELECT p_partkey AS id, p_retailprice AS score FROM part WHERE p_size > 5) a
  FULL JOIN (SELECT l_partkey AS id, round(sum(l_extendedprice * (1 - l_discount)), 4) AS score FROM lineitem WHERE l_quantity > 20 GROUP BY l_partkey) b ON a.id = b.id)"""
FRONT = "f AS (SELECT id FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.score_0 >= a.score_0 AND b.score_1 >= a.score_1 AND (b.score_0 > a.score_0 OR b.score_1 > a.score_1)))"


@query("ranker_merge", f"WITH {MERGED} SELECT * FROM m")
def ranker_merge(spark, sf_dir):
    return _scores(spark, sf_dir)


@query("skyline_2d", f"WITH {MERGED}, {FRONT} SELECT m.* FROM m JOIN f USING (id)")
def skyline_2d(spark, sf_dir):
    return rank.skyline_2d(_scores(spark, sf_dir), "score_0", "score_1")


@query("skyline_3d", "SELECT p_partkey FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size >= a.p_size AND b.p_retailprice >= a.p_retailprice AND b.p_partkey % 97 >= a.p_partkey % 97 AND (b.p_size > a.p_size OR b.p_retailprice > a.p_retailprice OR b.p_partkey % 97 > a.p_partkey % 97))")
def skyline_3d(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("luck", F.col("p_partkey") % 97)
    return rank.skyline(part, ["p_size", "p_retailprice", "luck"]).select("p_partkey")


@query("skyline_fallback", f"WITH {MERGED}, {FRONT} SELECT id FROM f UNION SELECT id FROM (SELECT id FROM m ORDER BY score_0 DESC, id LIMIT 5) UNION SELECT id FROM (SELECT id FROM m ORDER BY score_1 DESC, id LIMIT 5)")
def skyline_fallback(spark, sf_dir):
    return rank.skyline_filter(_scores(spark, sf_dir), "id", topk=100)


@query("skyline_without_graph", f"WITH {MERGED} SELECT id FROM m ORDER BY score_0 DESC, id LIMIT 10")
def skyline_without_graph(spark, sf_dir):
    return rank.skyline_filter(_scores(spark, sf_dir), "id", topk=10, variant="wo_graph")


@query("skyline_without_text", f"WITH {MERGED} SELECT id FROM m ORDER BY score_1 DESC, id LIMIT 10")
def skyline_without_text(spark, sf_dir):
    return rank.skyline_filter(_scores(spark, sf_dir), "id", topk=10, variant="wo_text")


@query("gradient_cut", """WITH r AS (SELECT p_brand, p_partkey, p_retailprice, row_number() OVER w AS rn, lag(p_retailprice) OVER w AS before FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)),
s AS (SELECT *, max(CASE WHEN rn > 1 AND p_retailprice < 0.999 * before THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand ORDER BY rn) AS stopped FROM r)
SELECT p_brand, p_partkey, p_retailprice FROM s WHERE stopped = 0""")
def gradient_cut(spark, sf_dir):
    return rank.gradient_cut(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice"), "p_brand", "p_retailprice", "p_partkey", 0.999)


@query("contiguous_split", "SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY source, doc_id) - 1) / ceil((SELECT count(*) FROM documents) / 7.0)) AS INT) AS part FROM documents")
def contiguous_split(spark, sf_dir):
    return rank.contiguous_split(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source", "doc_id"], 7).select("doc_id", "part")


@query("dedup_keep_first", "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def dedup_keep_first(spark, sf_dir):
    keyed = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return rank.keep_first(keyed, "h", "doc_id").select("doc_id")


@query("seeded_sample", "SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 50")
def seeded_sample(spark, sf_dir):
    return rank.seeded_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 50, 42)


@query("group_by_document", "SELECT source, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, max(n_chars) AS longest FROM documents GROUP BY source, lang")
def group_by_document(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))


@query("value_counts", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def value_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("first_and_last", """WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS z FROM orders)
SELECT o_custkey, o_orderkey FROM r WHERE a <= 3 OR z <= 5""")
def first_and_last(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey")
    a = F.row_number().over(w.orderBy("o_orderdate", "o_orderkey"))
    z = F.row_number().over(w.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return table(spark, sf_dir, "orders").withColumn("a", a).withColumn("z", z).where("a <= 3 or z <= 5").select("o_custkey", "o_orderkey")


@query("neighbour_titles", "SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER w AS previous, lead(o_orderkey) OVER w AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def neighbour_titles(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.lag("o_orderkey").over(w).alias("previous"), F.lead("o_orderkey").over(w).alias("next"))
