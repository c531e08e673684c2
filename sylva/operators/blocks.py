"""Content blocks of parsed documents: page-break repair and the joins that find what to repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.functions import text as T


def zip_layout(blocks: DataFrame, layout: DataFrame, doc: str, content: str = "content", boxes: str = "boxes") -> DataFrame:
    """Content items and layout boxes of a document (arrays) joined by place; documents whose lengths differ raise an error."""
    both = blocks.join(layout, doc)
    checked = F.when(F.size(content) == F.size(boxes), F.arrays_zip(content, boxes)).otherwise(F.raise_error(F.concat(F.lit("lengths differ in "), F.col(doc).cast("string"))))
    return both.select(doc, F.posexplode(checked).alias("position", "_z")).select(doc, "position", f"_z.{content}", f"_z.{boxes}")


def refine(blocks: DataFrame, doc: str = "doc_id", order: str = "position") -> DataFrame:
    """Text blocks with dashes mended and noise cut; blocks left empty go, and the rest are numbered from 1."""
    is_text = F.col("type") == "text"
    mended = blocks.withColumn("text", F.when(is_text, T.cut_ocr_noise(T.fix_dashes(F.col("text")))).otherwise(F.col("text")))
    kept = mended.where(~is_text | (F.trim(F.coalesce("text", F.lit(""))) != ""))
    return kept.withColumn("pdf_id", F.row_number().over(Window.partitionBy(doc).orderBy(order)))


def continuations(blocks: DataFrame, doc: str = "doc_id", at: str = "pdf_id", max_gap: int = 2) -> DataFrame:
    """(doc, pdf_id, candidate_id): for each paragraph that seems cut off, the blocks that may continue it.

    Candidates follow within max_gap pages. Titles, tables, images and texts of under 3 characters are passed over;
    equations, texts that begin in lower case and acronyms are candidates; a text that begins with a capital is one
    only if it is the first candidate, and a second such text, or anything else, ends the search.
    """
    body = blocks.where(~F.col("type").isin("table", "image") & F.col("text_level").isNull())
    text = F.trim(F.coalesce("text", F.lit("")))
    usable = body.where((F.col("type") == "equation") | (F.length(text) >= 3))
    easy = (F.col("type") == "equation") | text.rlike(r"^\p{Ll}") | T.begins_with_acronym(F.col("text"))
    kind = F.when(easy, "easy").when(text.rlike(r"^\p{Lu}"), "capital").otherwise("other")
    follow = usable.select(F.col(doc).alias("_d"), F.col(at).alias("candidate_id"), F.col("page_idx").alias("_page"), kind.alias("kind"))
    cut = blocks.where((F.col("type") == "text") & F.col("text_level").isNull() & T.is_incomplete_paragraph(F.col("text")))
    pairs = cut.join(follow, (F.col(doc) == F.col("_d")) & (F.col("candidate_id") > F.col(at)) & (F.col("_page") <= F.col("page_idx") + max_gap))
    after = Window.partitionBy(doc, at).orderBy("candidate_id")
    first = F.row_number().over(after) == 1
    stop = (F.col("kind") == "other") | ((F.col("kind") == "capital") & ~first)
    stopped = F.sum(stop.cast("int")).over(after.rowsBetween(Window.unboundedPreceding, 0))
    return pairs.withColumn("_stop", stopped).where("_stop = 0").select(doc, at, "candidate_id")


def stitch(blocks: DataFrame, accepted: DataFrame, doc: str = "doc_id", at: str = "pdf_id") -> DataFrame:
    """blocks with accepted continuations (doc, pdf_id, candidate_id) joined into their paragraph and marked invalid there."""
    parts = accepted.join(blocks.select(doc, F.col(at).alias("candidate_id"), F.col("text").alias("_part"), F.col("type").alias("_kind")), [doc, "candidate_id"])
    tails = parts.groupBy(doc, at).agg(F.transform(F.array_sort(F.collect_list(F.struct("candidate_id", "_part"))), lambda x: x["_part"]).alias("_tail"))
    gone = parts.where("_kind <> 'equation'").select(doc, F.col("candidate_id").alias(at)).distinct().withColumn("_gone", F.lit(True))
    joined = blocks.join(tails, [doc, at], "left").join(gone, [doc, at], "left")
    whole = F.when(F.col("_tail").isNotNull(), T.join_hyphenated(F.concat(F.array("text"), "_tail"))).otherwise(F.col("text"))
    return joined.withColumn("text", whole).withColumn("invalid", F.coalesce("_gone", F.lit(False))).drop("_tail", "_gone")
