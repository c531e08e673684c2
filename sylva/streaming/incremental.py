"""Incremental work: file streams that extend an index, and windows over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.operators import bm25


def extend_postings(spark: SparkSession, source: str, index: str, checkpoint: str, schema: str = "doc_id long, text string"):
    """A query that appends postings and lengths of new documents (JSON lines under source) to Parquet tables under index.

    A batch that is repeated after a failure writes to the same folder as before, so nothing is counted twice.
    """
    stream = spark.readStream.schema(schema).json(source)

    def append(batch: DataFrame, batch_id: int) -> None:
        made = bm25.build(batch, "doc_id", "text")
        made.postings.write.mode("overwrite").parquet(f"{index}/postings/batch={batch_id}")
        made.lengths.write.mode("overwrite").parquet(f"{index}/lengths/batch={batch_id}")

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_index(spark: SparkSession, index: str) -> bm25.Index:
    """The index as it stands; document frequencies are counted over all batches."""
    postings, lengths = (spark.read.parquet(f"{index}/{name}").drop("batch") for name in ("postings", "lengths"))
    corpus = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    return bm25.Index(postings, lengths, bm25.with_idf(postings.groupBy("term").agg(F.count("*").alias("df")), corpus), corpus)


def windows(events: DataFrame, time: str, length: str, keys: list[str], value: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts and sums in tumbling or sliding windows; on a stream, `late` is the watermark."""
    rows = events.withWatermark(time, late) if late else events
    slot = F.window(time, length, slide) if slide else F.window(time, length)
    return rows.groupBy(slot.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    rows = events.withWatermark(time, late) if late else events
    return rows.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")
