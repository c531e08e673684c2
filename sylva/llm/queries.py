"""The queries of the corpus operators: each applies its operator to its whole table and returns the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_virtual_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sylva.llm.sharding import shard

    return shard(_table(spark, sf_dir, "documents"), n_shards=40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version"
    )


def op2_sorted_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sylva.llm.embeddings import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sylva.llm.brown import score

    return score(_table(spark, sf_dir, "documents"))


def op4_divergence_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sylva.llm.quality import judge

    return judge(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance"
    )


def op5_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sylva.llm.pii import learn, report

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return report(docs, learn(docs)).drop("text")


def op6_url_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sylva.llm.urls import filter_urls, labelled_urls, train

    judged = filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), train(labelled_urls(spark)))
    return judged.select("page_id", "host", "path", "rule", "verdict", "url_score")


def op7_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sylva.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op8_heavy_light_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sylva.llm.jaccard import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh
  FROM w
), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
k AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, m.c AS component_id
FROM s JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) m ON m.id = s.doc_id
"""


def op9_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from sylva.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sylva.llm.warc import round_trip

    return round_trip(_table(spark, sf_dir, "pages"))


OP10_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages
), d AS (
  SELECT page_id, payload_bytes, sha256(html) AS payload_digest,
         min(page_id) OVER (PARTITION BY sha256(html)) AS first_id
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM d
"""


def queries() -> dict:
    return {
        "op1_virtual_slot_sharding": op1_virtual_slot_sharding,
        "op2_sorted_projections": op2_sorted_projections,
        "op3_brown_classes": op3_brown_classes,
        "op4_divergence_quality": op4_divergence_quality,
        "op5_bootstrapped_pii": op5_bootstrapped_pii,
        "op6_url_regression": op6_url_regression,
        "op7_pareto_mixing": op7_pareto_mixing,
        "op8_heavy_light_jaccard": op8_heavy_light_jaccard,
        "op9_residual_packing": op9_residual_packing,
        "op10_warc_round_trip": op10_warc_round_trip,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_heavy_light_jaccard": OP8_SQL, "op10_warc_round_trip": OP10_SQL}
