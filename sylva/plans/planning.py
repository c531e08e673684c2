"""Question plans: classify, split, filter, check, and carry out on nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylva.functions import text as T

TYPES = ("simple", "complex", "global")
OPERATIONS = ("COUNT", "LIST", "SUMMARIZE", "ANALYZE")


def classify(question: Column) -> Column:
    """global if a question counts or lists over a document, complex if it has parts or compares, else simple."""
    q = F.lower(question)
    return F.when(q.rlike(r"\b(how many|number of|list all|count|every|all the)\b"), "global").when(q.rlike(r"\b(compare|difference|both|versus|and then)\b|\?.*\?"), "complex").otherwise("simple")


def operation(question: Column) -> Column:
    q = F.lower(question)
    return F.when(q.rlike(r"\b(how many|number of|count)\b"), "COUNT").when(q.rlike(r"\blist\b"), "LIST").when(q.rlike(r"\b(summari[sz]e|summary)\b"), "SUMMARIZE").otherwise("ANALYZE")


def filters(question: Column) -> Column:
    """Filters named in a question: figures, tables, pages, a section in quotes."""
    q = F.lower(question)
    pages = F.regexp_extract(q, r"\bpages? (\d+(?:\s*-\s*\d+)?)", 1)
    section = F.regexp_extract(question, "(?i)section [\"']([^\"']+)[\"']", 1)
    made = lambda kind, value: F.struct(F.lit(kind).alias("filter_type"), value.alias("filter_value"))
    none = F.lit(None).cast("string")
    found = F.array(
        F.when(q.rlike(r"\b(figures?|images?|pictures?)\b"), made("image", none)), F.when(q.rlike(r"\btables?\b"), made("table", none)),
        F.when(pages != "", made("page", F.regexp_replace(pages, r"\s", ""))), F.when(section != "", made("section", section)),
    )
    return F.filter(found, lambda f: f.isNotNull())


def parts(question: Column) -> Column:
    """Sub-questions of a complex question, each to be looked up, and one to put them together."""
    cut = F.filter(F.transform(F.split(question, r"(?i)\?\s*|\band then\b"), T.strip), lambda x: x != "")
    asked = F.transform(cut, lambda x: F.struct(x.alias("question"), F.lit("retrieval").alias("type")))
    return F.concat(asked, F.array(F.struct(question.alias("question"), F.lit("synthesis").alias("type"))))


def plan(rows: DataFrame, question: str = "question") -> DataFrame:
    """rows with query_type, sub_questions, filters and operation, each only where the type has it."""
    q = F.col(question)
    kind = rows.withColumn("query_type", classify(q))
    return kind.withColumns({
        "sub_questions": F.when(F.col("query_type") == "complex", parts(q)),
        "filters": F.when(F.col("query_type") == "global", filters(q)),
        "operation": F.when(F.col("query_type") == "global", operation(q)),
    })


def check(plans: DataFrame) -> DataFrame:
    """plans; a row whose fields do not suit its type fails the job with a message that says so."""
    t = F.col("query_type")
    bad = F.when(~t.isin(*TYPES), "unknown type").when((t == "complex") & F.coalesce(F.size("sub_questions") < 1, F.lit(True)), "complex without sub-questions")
    bad = bad.when((t == "global") & F.coalesce(~F.col("operation").isin(*OPERATIONS), F.lit(True)), "global without operation").when((t == "global") & F.col("filters").isNull(), "global without filters")
    valued = F.exists("filters", lambda f: f["filter_type"].isin("image", "table") & f["filter_value"].isNotNull())
    bad = bad.when((t == "global") & F.coalesce(valued, F.lit(False)), "a figure or table filter has a value")
    return plans.withColumn("query_type", F.when(bad.isNull(), t).otherwise(F.raise_error(F.coalesce(bad, F.lit("")))))


def count_answers(nodes: DataFrame, plans: DataFrame, plan_id: str) -> DataFrame:
    """(plan_id, n): nodes that pass the filters of each global COUNT plan; nodes: type, page_idx, path_titles.

    Plans are few next to nodes: they are matched by broadcast if their number is checked to be small.
    """
    from sylva.catalog import bounded

    asked = plans.where("query_type = 'global' and operation = 'COUNT'").select(plan_id, "filters")
    value = lambda f: f["filter_value"]
    page = lambda f: F.when(value(f).rlike(r"^\d+(-\d+)?$"), (F.col("page_idx") + 1).between(F.element_at(F.split(value(f), "-"), 1).cast("int"), F.element_at(F.split(value(f), "-"), -1).cast("int"))).otherwise(True)
    section = lambda f: F.coalesce(F.contains(F.lower(F.array_join("path_titles", "")), F.lower(value(f))), F.lit(True))
    passes = F.forall("filters", lambda f: F.when(f["filter_type"].isin("image", "table"), F.col("type") == f["filter_type"]).when(f["filter_type"] == "page", page(f)).otherwise(section(f)))
    kinds = nodes.groupBy("type", "page_idx", "path_titles").agg(F.count("*").alias("_n"))  # plans see only what filters see
    hits = kinds.join(bounded(asked, 10_000), passes).groupBy(plan_id).agg(F.sum("_n").alias("n"))
    return asked.select(plan_id).join(hits, plan_id, "left").select(plan_id, F.coalesce("n", F.lit(0)).alias("n"))


def pack_evidence(evidence: DataFrame, question: str, order: str, text: str, budget: int) -> DataFrame:
    """(question, prompt_no, evidence): the evidence of each question, in order, in prompts of at most budget words."""
    rows = evidence.withColumn("_n", T.n_tokens(F.col(text)))
    held = rows.groupBy(question).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_n").alias("n"), F.col(text).alias("t")))).alias("_e"))
    bins = held.withColumn("_b", T.pack_in_order(F.transform("_e", lambda e: e["n"]), budget)).select(question, F.explode(F.arrays_zip("_e", "_b")).alias("_x"))
    return bins.groupBy(question, F.col("_x._b").alias("prompt_no")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_x._e")), lambda e: e["t"]), "\n").alias("evidence"))


def reduce_answers(partial: DataFrame, question: str, order: str, answer: str, nothing: str = "No relevant information was found.") -> DataFrame:
    """(question, answer): a fixed text for no partial answer, the answer itself for one, a numbered list for more."""
    said = partial.where(F.coalesce(F.trim(answer) != "", F.lit(False))).groupBy(question).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(answer).alias("a")))), lambda x: x["a"]).alias("_a"))
    numbered = F.array_join(F.transform("_a", lambda a, i: F.concat((i + 1).cast("string"), F.lit(". "), a)), "\n")
    out = F.when(F.size("_a") == 1, F.get("_a", F.lit(0))).when(F.size("_a") > 1, numbered).otherwise(nothing)
    return partial.select(question).distinct().join(said, question, "left").select(question, F.coalesce(out, F.lit(nothing)).alias("answer"))


def first_prompt(evidence: DataFrame, question: str, order: str, text: str, budget: int) -> DataFrame:
    """The single-prompt variant: evidence in order until the first that would exceed the budget."""
    upto = Window.partitionBy(question).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = evidence.withColumn("_sum", F.sum(T.n_tokens(F.col(text))).over(upto)).where(F.col("_sum") <= budget)
    return rows.groupBy(question).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), "\n").alias("evidence"))
