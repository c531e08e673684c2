"""The corpus pipeline: quality rules, near duplicates, personal data, mixing, packing.

Every stage is a function of (spark, docs, sf_dir) over all that the stage before it kept; all but the last return
the columns of documents. run() writes each stage's result as Parquet to the shared folder and reads it for the next.

ORACLE_SQL is None: the Pareto ranks, the bootstrap and the packing are not expressible in SQL; tests hold each stage
against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm import jaccard, mixing, packing, pii, quality
from sylva.llm._common import stage_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie near their language's references.

    Null, empty and blank texts fail the base rules and go; repeated rows are judged alike; no documents give none.
    """
    return quality.kept(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest doc_id; of repeated rows one.

    Texts without words have no duplicates but rows repeated under one doc_id; rows without a doc_id come after those with one.
    """
    return jaccard.keep_one(docs.select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with identifiers replaced by their kind and n_chars counted anew.

    A null text stays null and its n_chars is null; repeated rows are redacted alike; without seeds the base patterns alone count.
    """
    patterns = pii.learn(docs.select("doc_id", "text"))
    return pii.redact(docs.select(*COLUMNS), patterns).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, which may be never: sum(copies) rows in all.

    Rows repeated under one doc_id have copies of their own; texts without words have size 0 and the copies that their
    source's share gives; a null source is a source.
    """
    mixed = mixing.mix(docs.select(*COLUMNS), carry=COLUMNS).where("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences of 2048 tokens; a null or blank text is its closing id alone."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("bootstrapped_pii", personal_data),
    ("pareto_mixing", mix_sources),
    ("residual_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
