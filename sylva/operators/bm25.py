"""BM25 as tables: postings, document lengths and term statistics are DataFrames, a search is a join on terms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylva.catalog import bounded
from sylva.stages import short_shuffles, stage_table

K1, B = 1.5, 0.75


def tokens(text: Column) -> Column:
    """Lower-case words between white space of any kind; none in null or blank text."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)^\s+|\s+$", "")
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"(?U)\s+"))


#: Distinct terms of queries that are looked for in texts directly; more go through an index.
MAX_TERMS = 20_000


@dataclass
class Index:
    """postings (id, term, tf), lengths (id, dl), terms (term, df, idf) and the corpus averages as one row (n, avgdl)."""

    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame
    corpus: DataFrame

    def save(self, path: str) -> None:
        """The four tables under path, replaced; postings are sorted by term, so a search reads few of their row groups."""
        self.postings.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        for name in ("lengths", "terms", "corpus"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> Index:
    """The index saved under path."""
    return Index(*[spark.read.parquet(f"{path}/{name}") for name in ("postings", "lengths", "terms", "corpus")])


def build(docs: DataFrame, id_col: str, text_col: str) -> Index:
    """The index of docs. Texts are split once: postings and lengths are stage tables that all later reads share."""
    words = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("ws"))
    lengths = stage_table(words.select("id", F.size("ws").cast("long").alias("dl")), "bm25-lengths")
    postings = stage_table(words.select("id", F.explode("ws").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf")), "bm25-postings")
    corpus = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    return Index(postings, lengths, with_idf(df, corpus), corpus)


def with_idf(df: DataFrame, corpus: DataFrame) -> DataFrame:
    """Terms with ln((N - df + 1/2) / (df + 1/2) + 1); N comes from a one-row subquery."""
    n = corpus.select("n").scalar()
    return df.withColumn("idf", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))


def _part(avgdl: Column) -> Column:
    """What a term adds to a score."""
    return F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / avgdl))


def scores(index: Index, queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """(query_id, id, score) of all documents that share a term with a query; a term repeated in a query counts again.

    Only postings of queried terms are read on: the terms of the queries are broadcast if few.
    """
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    known = index.terms.join(bounded(asked.select("term").distinct()), "term", "left_semi")
    avgdl = index.corpus.select("avgdl").scalar()
    weighted = (
        index.postings.join(bounded(asked), "term").join(known, "term").join(index.lengths, "id").withColumn("part", _part(avgdl))
    )
    return weighted.groupBy("query_id", "id").agg(F.sum("part").alias("score"))


def search(index: Index, queries: DataFrame, k: int, query_id: str = "query_id", text: str = "text") -> DataFrame:
    """The k best documents of each query by score, then by id; documents that share no term are not listed."""
    ranked = scores(index, queries, query_id, text).withColumn("score", F.round("score", 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_one(index: Index, spark, text: str, k: int) -> DataFrame:
    """The k best documents of one query; documents of score 0 fill up, in order of id."""
    found = scores(index, spark.createDataFrame([(0, text)], "query_id int, text string"), "query_id", "text").select("id", F.round("score", 6).alias("score"))
    return index.lengths.select("id").join(found, "id", "left").withColumn("score", F.coalesce("score", F.lit(0.0))).orderBy(F.desc("score"), "id").limit(k)


def search_docs(docs: DataFrame, id_col: str, text_col: str, queries: DataFrame, k: int, query_id: str = "query_id", text: str = "text", most: int = MAX_TERMS) -> DataFrame:
    """(query_id, id, score, rank) as search() gives, from the texts themselves, without an index.

    One pass splits the texts and keeps of each its length and the words that queries ask for; all further steps see
    only these. Queries of more than `most` distinct terms go through build().
    """
    with short_shuffles(docs.sparkSession):
        asked = stage_table(queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf")), "bm25-asked")
        terms = [r.term for r in asked.select("term").distinct().limit(most + 1).collect()]
        if len(terms) > most:
            return search(build(docs, id_col, text_col), queries, k, query_id, text)
        words = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("ws"))
        hits = F.filter("ws", lambda w: w.isin(*terms)) if terms else F.array().cast("array<string>")
        rows = stage_table(words.select("id", F.size("ws").cast("long").alias("dl"), hits.alias("hits")), "bm25-hits")
        corpus = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
        postings = stage_table(rows.select("id", "dl", F.explode("hits").alias("term")).groupBy("id", "dl", "term").agg(F.count("*").alias("tf")), "bm25-postings")
        known = with_idf(postings.groupBy("term").agg(F.count("*").alias("df")), corpus)
        parts = postings.join(bounded(asked), "term").join(bounded(known), "term").withColumn("part", _part(corpus.select("avgdl").scalar()))
        ranked = parts.groupBy("query_id", "id").agg(F.round(F.sum("part"), 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def filled(found: DataFrame, queries: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """found (query_id, id, score, rank), with documents of score 0, in order of id, where a query (query_id) has fewer than k.

    Only the k smallest ids can be needed: those of them that a query has not found follow in its list.
    """
    first = [r.id for r in ids.select("id").orderBy("id").limit(k).collect()]
    have = found.groupBy("query_id").agg(F.count("*").alias("n"), F.collect_set("id").alias("has"))
    short = queries.select("query_id").distinct().join(have, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).where(F.col("n") < k)
    kind = ids.schema["id"].dataType
    rest = F.array_except(F.array(*[F.lit(i).cast(kind) for i in first]) if first else F.array().cast(f"array<{kind.simpleString()}>"), F.coalesce("has", F.array().cast(f"array<{kind.simpleString()}>")))
    more = short.select("query_id", "n", F.posexplode(rest).alias("at", "id")).select("query_id", "id", F.lit(0.0).alias("score"), (F.col("n") + F.col("at") + 1).cast("int").alias("rank"))
    return found.select("query_id", "id", "score", "rank").unionByName(more.where(F.col("rank") <= k))
