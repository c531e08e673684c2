"""Reading question sets, corpora and results, and writing results so that a run can be resumed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTION_FIELDS = ("question", "answer", "doc_uuid", "doc_path")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of questions; further fields stay columns. Raises if a required field is missing."""
    rows = spark.read.json(path, multiLine=True)
    if missing := [c for c in QUESTION_FIELDS if c not in rows.columns]:
        raise ValueError(f"the question set has no {', '.join(missing)}")
    return rows


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def read_nested(spark: SparkSession, path: str, drop: tuple[str, ...] = ()) -> DataFrame:
    return spark.read.parquet(path).drop(*drop)


def unnest(rows: DataFrame, struct: str, fields: tuple[str, ...]) -> DataFrame:
    """A struct of parallel arrays as one row for each place."""
    return rows.withColumn("_z", F.explode(F.arrays_zip(*[F.col(f"{struct}.{f}").alias(f) for f in fields]))).select("*", *[F.col(f"_z.{f}").alias(f) for f in fields]).drop("_z", struct)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row for each file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_block_lists(spark: SparkSession, path: str) -> DataFrame:
    """JSON files of content blocks, with the file each row came from."""
    return spark.read.json(path, multiLine=True).withColumn("path", F.input_file_name())


def pending_files(spark: SparkSession, path: str, done: DataFrame, pattern: str = "*.pdf") -> DataFrame:
    """(path, modificationTime, length, content) of files that are not in done (path); content is read only where it is used."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).join(done.select("path"), "path", "left_anti")


def first_answer(rows: DataFrame) -> DataFrame:
    """rows with a single answer and a single document, as columns answer and doc_id."""
    one = (F.size("answers") == 1) & (F.size("supporting_context") == 1)
    return rows.where(one).withColumn("answer", F.get("answers", F.lit(0))["answer"]).withColumn("doc_id", F.get("supporting_context", F.lit(0))["doc_id"])


def save_tree(nodes: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").partitionBy("doc_id").parquet(path)


def tree_summary(nodes: DataFrame) -> DataFrame:
    """Nodes as JSON lines."""
    return nodes.select(F.to_json(F.struct("*")).alias("json"))


def save_graph(entities: DataFrame, edges: DataFrame, path: str, variant: str) -> None:
    """Both tables under path, a folder for each variant; only the variant written is replaced."""
    for name, df in (("entities", entities), ("edges", edges)):
        df.write.mode("overwrite").parquet(f"{path}/{name}/variant={variant}")


def load_graph(spark: SparkSession, path: str, variant: str) -> tuple[DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{name}").where(F.col("variant") == variant).drop("variant") for name in ("entities", "edges"))


def to_do(questions: DataFrame, results: DataFrame, key: str | list[str]) -> DataFrame:
    """Questions without a stored result that has an output; results that could not be read, and questions without text, count as
    not there."""
    valid = results.where(F.coalesce(F.trim("output") != "", F.lit(False)))
    if "_corrupt_record" in results.columns:
        valid = valid.where("_corrupt_record is null")
    return questions.where("question is not null").join(valid, key, "left_anti")


def all_results(stored: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """New results and the stored ones that they do not replace."""
    return new.unionByName(stored.join(new, key, "left_anti"), allowMissingColumns=True)


def add_costs(stored: DataFrame, new: DataFrame, key: str = "name", value: str = "tokens") -> DataFrame:
    """Sums by key of stored and new costs."""
    return stored.unionByName(new).groupBy(key).agg(F.sum(value).alias(value))


def merge_stats(stored: DataFrame, new: DataFrame, key: str, times: list[str], tokens: list[str]) -> DataFrame:
    """Index statistics: the first time written stays; a token count is replaced by a new one that is not 0."""
    old = stored.select(key, *[F.col(c).alias(f"_{c}") for c in times + tokens])
    both = new.join(old, key, "full_outer")
    kept = [F.coalesce(f"_{c}", c).alias(c) for c in times]
    replaced = [F.when(F.coalesce(F.col(c), F.lit(0)) != 0, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in tokens]
    return both.select(key, *kept, *replaced)


def number_or_null(column: Column) -> Column:
    """A cost that may be a number, text or a struct's field."""
    return column.try_cast("double")


def stage_deltas(ledger: DataFrame, group: str, order: str, total: str) -> DataFrame:
    """ledger with what each stage added to a running total."""
    from pyspark.sql import Window

    return ledger.withColumn("delta", F.col(total) - F.coalesce(F.lag(total).over(Window.partitionBy(group).orderBy(order)), F.lit(0)))


def looks_like_slides(pages: DataFrame, doc: str, words: str, width: str, height: str) -> DataFrame:
    """(doc, slides): wide pages, or more than two pages of fewer than 200 words on average."""
    means = pages.groupBy(doc).agg(F.count("*").alias("n"), F.avg(words).alias("w"), F.avg(F.col(width) / F.col(height)).alias("r"))
    return means.select(doc, ((F.col("r") > 1.1) | ((F.col("w") < 200) & (F.col("n") > 2))).alias("slides"))


def json_or_null(text: Column, schema: str) -> Column:
    """A JSON object, also from within a fence or after other words, trailing commas dropped; null if there is none."""
    body = F.regexp_extract(text, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.from_json(F.when(body != "", F.regexp_replace(body, r",\s*([}\]])", "$1")), schema)
