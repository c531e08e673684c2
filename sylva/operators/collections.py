"""Stored collections of vectors and chunks, and what goes into them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.functions import text as T
from sylva.operators import bm25
from sylva.plans.providers import Embedder, embed


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def open_collection(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a collection; one that is not there yet is made, empty."""
    if not _exists(spark, path):
        spark.createDataFrame([], schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def reset_collection(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An empty collection in place of what was there."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)


def add_to_collection(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def indexable(nodes: DataFrame) -> DataFrame:
    """(node_id, text, image): what of a node is indexed; nodes without either are left out.

    An image by caption and footnote, and by its file if there is one (img_path); a table by content and body; titles, texts
    and equations by content.
    """
    kind = F.col("type")
    text = F.when(kind == "image", F.concat_ws(" ", "caption", "footnote")).when(kind == "table", F.concat_ws(" ", "content", "table_body")).otherwise(F.col("content"))
    text, image = F.nullif(F.trim(text), F.lit("")), F.when(kind == "image", F.nullif(F.trim("img_path"), F.lit("")))
    return nodes.select("node_id", text.alias("text"), image.alias("image")).where("text is not null or image is not null")


def split_evidence(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Retrieved nodes as texts (node_id, page, text) and images (node_id, page, img_path); pages count from 1."""
    page = (F.col("page_idx") + 1).alias("page")
    return nodes.where("type <> 'image'").select("node_id", page, "text"), nodes.where("type = 'image'").select("node_id", page, "img_path")


def first_images(images: DataFrame, group: str, order: str, n: int = 1) -> DataFrame:
    """The first n images of each group that have a path."""
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(order)
    return images.where(F.coalesce(F.trim("img_path"), F.lit("")) != "").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def pretty_rows(rows: DataFrame, group: str, columns: list[str], order: str) -> DataFrame:
    """(group, json): the chosen columns of each group's rows, in order, as a JSON list."""
    held = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*columns).alias("row")))), lambda x: x["row"])
    return rows.groupBy(group).agg(F.to_json(held).alias("json"))


def chunk_rows(docs: DataFrame, key: str, text: str, budget: int = 500) -> DataFrame:
    """(chunk_id, key, chunk, text): every text in chunks of at most `budget` words; a chunk's id is a hash of its place."""
    cut = docs.select(key, F.posexplode(T.chunks(F.coalesce(text, F.lit("")), budget)).alias("chunk", "text"))
    return cut.select(F.xxhash64(F.col(key).cast("string"), "chunk").alias("chunk_id"), key, "chunk", "text")


def chunk_index(docs: DataFrame, key: str, text: str, kind: str, embedder: Embedder | None = None, budget: int = 500):
    """The index of a corpus's chunks: kind bm25 gives a bm25.Index, vanilla a collection (node_id, text, v)."""
    rows = chunk_rows(docs, key, text, budget)
    if kind == "bm25":
        return bm25.build(rows, "chunk_id", "text")
    if kind == "vanilla" and embedder is not None:
        return embed(rows.select(F.col("chunk_id").alias("node_id"), "text"), "text", "v", embedder)
    raise ValueError(f"no chunk index of kind {kind}, or no embedder for it")


def room_left(prompt_words: int, total: int, reserved: int = 200) -> int:
    """Words that an answer may take where a prompt has taken some of `total`; none below 0."""
    return max(0, total - prompt_words - reserved)


def entity_pages(mentions: DataFrame, doc: str, page: str, n: int = 10) -> DataFrame:
    """(doc, pages): of each document the first n pages that mention any entity, in order."""
    return mentions.groupBy(doc).agg(F.slice(F.array_sort(F.collect_set(page)), 1, n).alias("pages"))


def save_traces(found: DataFrame, path: str, query: str = "query_id", order: str = "score") -> None:
    """What each query retrieved, best first, as one JSON line for each query."""
    held = F.sort_array(F.collect_list(F.struct(F.col(order), *[c for c in found.columns if c not in (query, order)])), asc=False)
    found.groupBy(query).agg(held.alias("retrieved")).write.mode("overwrite").json(path)
