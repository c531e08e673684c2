"""Plans, prompts, answers, strategies, ledgers and resumption over conversations, documents and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylva.catalog import query, table
from sylva.functions import text as T
from sylva.plans import planning as P
from sylva.plans import strategies as S
from sylva.sources import corpus as C
from sylva.stages import stage_table
from sylva.streaming import incremental as I


def questions(spark, sf_dir):
    """User turns as questions, and a few fixed ones on orders."""
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("question"))
    fixed = [(-1, "How many tables are on pages 3-10?"), (-2, "How many figures are in section 'urgent'?"), (-3, "Compare the first and the last order"), (-4, "List all sections")]
    return asked.union(spark.createDataFrame(fixed, "query_id long, question string"))


FIXED = "f AS (SELECT * FROM (VALUES (-1, 'How many tables are on pages 3-10?'), (-2, 'How many figures are in section ''urgent''?'), (-3, 'Compare the first and the last order'), (-4, 'List all sections')) v(query_id, question))"
ASKED = f"{FIXED}, q AS (SELECT conv_id * 1000 + turn AS query_id, text AS question FROM conversations WHERE role = 'user' UNION ALL SELECT * FROM f), l AS (SELECT *, lower(question) AS s FROM q)"


@query("plan_rules", rf"""WITH {ASKED}, t AS (SELECT *, CASE WHEN regexp_matches(s, '\b(how many|number of|list all|count|every|all the)\b') THEN 'global' WHEN regexp_matches(s, '\b(compare|difference|both|versus|and then)\b|\?[^\n]*\?') THEN 'complex' ELSE 'simple' END AS query_type FROM l)
SELECT query_id, query_type, CASE WHEN query_type = 'global' THEN CASE WHEN regexp_matches(s, '\b(how many|number of|count)\b') THEN 'COUNT' WHEN regexp_matches(s, '\blist\b') THEN 'LIST' WHEN regexp_matches(s, '\b(summari[sz]e|summary)\b') THEN 'SUMMARIZE' ELSE 'ANALYZE' END END AS operation FROM t""")
def plan_rules(spark, sf_dir):
    return P.check(P.plan(questions(spark, sf_dir))).select("query_id", "query_type", "operation")


@query("plan_filters", f"WITH {FIXED} SELECT query_id, CASE query_id WHEN -1 THEN 'table=,page=3-10' WHEN -2 THEN 'image=,section=urgent' ELSE '' END AS filters FROM f WHERE query_id IN (-1, -2, -4)")
def plan_filters(spark, sf_dir):
    plans = P.plan(questions(spark, sf_dir)).where("query_id < 0 and query_type = 'global'")
    return plans.select("query_id", F.array_join(F.transform("filters", lambda f: F.concat(f["filter_type"], F.lit("="), F.coalesce(f["filter_value"], F.lit("")))), ",").alias("filters"))


@query("plan_counts", "SELECT -1 AS query_id, count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND month(o_orderdate) BETWEEN 3 AND 10 UNION ALL SELECT -2, count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O') AND o_orderpriority LIKE '%URGENT%'")
def plan_counts(spark, sf_dir):
    from sylva.queries.trees import order_nodes

    return P.count_answers(order_nodes(spark, sf_dir), P.plan(questions(spark, sf_dir)).where("query_id < 0"), "query_id")


@query("prompt_packing")
def prompt_packing(spark, sf_dir):
    packed = P.pack_evidence(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 300)
    return packed.select("conv_id", "prompt_no", T.n_tokens(F.col("evidence")).alias("n"), F.md5("evidence").alias("h"))


@query("answer_map_reduce", """WITH s AS (SELECT conv_id, turn, string_split(text, '. ')[1] AS a FROM conversations WHERE role = 'assistant'), n AS (SELECT conv_id, turn, trim(a) AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, count(*) OVER (PARTITION BY conv_id) AS c FROM s)
SELECT conv_id, md5(CASE WHEN max(c) = 1 THEN min(a) ELSE string_agg(r || '. ' || a, chr(10) ORDER BY r) END) AS h FROM n GROUP BY conv_id""")
def answer_map_reduce(spark, sf_dir):
    from sylva.plans.providers import FirstSentence, complete

    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.concat(F.lit("Question\n\n"), F.replace(F.col("text"), F.lit("\n\n"), F.lit("\n"))).alias("prompt"))
    partial = complete(turns, "prompt", "partial", FirstSentence())
    return P.reduce_answers(partial, "conv_id", "turn", "partial").select("conv_id", F.md5("answer").alias("h"))


def _inputs(spark, sf_dir, graph: bool = False) -> S.Inputs:
    """Documents as nodes, their capitalised words as entities, and entities that follow each other as edges."""
    from pyspark.sql import Window

    from sylva.operators.entities import mentions

    docs = table(spark, sf_dir, "documents")
    named = mentions(docs)
    if graph:  # what many steps read is found once
        named = stage_table(named, "mentions")
    after = named.withColumn("next", F.lead("name").over(Window.partitionBy("doc_id").orderBy("position"))).where("next is not null and next <> name")
    edges = after.groupBy(F.least("name", "next").alias("src"), F.greatest("name", "next").alias("dst")).agg(F.count("*").cast("double").alias("weight"))
    if graph:
        edges = stage_table(edges, "edges")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    chapter = F.concat_ws(" ", "source", (F.col("doc_id") % 64).cast("string"))  # documents hang on chapters of their source
    section = (-1 - F.pmod(F.xxhash64(chapter), F.lit(1 << 40))).alias("node_id")
    texts = docs.select(F.col("doc_id").alias("node_id"), section.alias("parent_id"), "text", F.lit("text").alias("type"), (F.col("doc_id") % 10).cast("int").alias("page_idx"), F.array("source").alias("path_titles"))
    heads = docs.select(section, F.lit(None).cast("long").alias("parent_id"), chapter.alias("text"), F.lit("title").alias("type"), F.lit(0).alias("page_idx"), F.array("source").alias("path_titles")).distinct()
    names = named.select("name").distinct()
    aliases = names.where("name like '%s'").select(F.col("name").alias("old"), F.expr("left(name, length(name) - 1)").alias("new")).join(names.select(F.col("name").alias("new")), "new", "left_semi")
    return S.Inputs(asked, texts.unionByName(heads), named.select(F.col("doc_id").alias("node_id"), F.col("name").alias("node")).distinct(), edges, aliases=aliases)


def _strategy_query(name, variant="standard", sql=None, **options):
    @query(f"strategy_{name}" + ("" if variant == "standard" else f"_{variant}"), sql)
    def run(spark, sf_dir):
        return S.retrieve(name, _inputs(spark, sf_dir, name in ("graph", "tree_entity", "planned")), variant, **options).select("query_id", "node_id", F.round("score", 6).alias("score"))

    return run


def _strategies():
    for name in ("vanilla", "bm25", "graph", "tree_entity", "mmr"):
        _strategy_query(name)
    for variant in S.VARIANTS:
        if variant != "wo_map":
            _strategy_query("planned", variant, select_depth=0)


_strategies()


@query("strategy_answers")
def strategy_answers(spark, sf_dir):
    return S.answer("bm25", _inputs(spark, sf_dir))


@query("strategy_answers_wo_map")
def strategy_answers_wo_map(spark, sf_dir):
    return S.answer("bm25", _inputs(spark, sf_dir), "wo_map")


@query("resume_anti_join", "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND conv_id * 1000 + turn NOT IN (SELECT conv_id * 1000 + turn FROM conversations WHERE role = 'user' AND turn % 4 = 0)")
def resume_anti_join(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    stored = asked.select("conv_id", "turn", F.when(F.col("turn") % 4 == 0, "done").otherwise(" ").alias("output"))
    return C.to_do(asked, stored, ["conv_id", "turn"]).select("conv_id", "turn")


@query("cost_rollup", "SELECT role AS name, CAST(sum(n) AS BIGINT) AS tokens FROM (SELECT role, len(string_split_regex(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+')) AS n FROM conversations) GROUP BY role")
def cost_rollup(spark, sf_dir):
    used = table(spark, sf_dir, "conversations").select(F.col("role").alias("name"), T.n_tokens(F.col("text")).cast("long").alias("tokens"), "turn")
    return C.add_costs(used.where("turn < 3").drop("turn"), used.where("turn >= 3").drop("turn"))


@query("stage_delta", "SELECT event_id, round(total - coalesce(lag(total) OVER (PARTITION BY user_id ORDER BY event_id), 0), 4) AS delta FROM (SELECT event_id, user_id, sum(value) OVER (PARTITION BY user_id ORDER BY event_id) AS total FROM events)")
def stage_delta(spark, sf_dir):
    from pyspark.sql import Window

    ledger = table(spark, sf_dir, "events").withColumn("total", F.sum("value").over(Window.partitionBy("user_id").orderBy("event_id")))
    return C.stage_deltas(ledger, "user_id", "event_id", "total").select("event_id", F.round("delta", 4).alias("delta"))


@query("index_stats_merge", "SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(o.t, n.t) AS t, CASE WHEN coalesce(n.k, 0) <> 0 THEN n.k ELSE o.k END AS k FROM (SELECT user_id, max(event_id) AS t, count(*) FILTER (WHERE event_type = 'error') AS k FROM events WHERE event_id % 2 = 0 GROUP BY user_id) n FULL JOIN (SELECT user_id, min(event_id) AS t, count(*) AS k FROM events WHERE event_id % 3 = 0 GROUP BY user_id) o ON o.user_id = n.user_id")
def index_stats_merge(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    new = events.where("event_id % 2 = 0").groupBy("user_id").agg(F.max("event_id").alias("t"), F.sum((F.col("event_type") == "error").cast("long")).alias("k"))
    old = events.where("event_id % 3 = 0").groupBy("user_id").agg(F.min("event_id").alias("t"), F.count("*").alias("k"))
    return C.merge_stats(old, new, "user_id", ["t"], ["k"])


@query("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return I.windows(table(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"], "value").withColumn("total", F.round("total", 4))


@query("event_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, sf_dir):
    return I.sessions(table(spark, sf_dir, "events"), "ts", "30 minutes", ["user_id"])


@query("json_properties", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def json_properties(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", C.json_or_null(F.concat(F.lit("Here it is: "), "props"), "k int")["k"].alias("k"))


@query("slide_detection", "SELECT conv_id, avg(CASE WHEN role = 'user' THEN 1.2 ELSE 1.0 END) > 1.1 OR (avg(len(string_split(text, ' '))) < 200 AND count(*) > 2) AS slides FROM conversations GROUP BY conv_id")
def slide_detection(spark, sf_dir):
    pages = table(spark, sf_dir, "conversations").select("conv_id", F.size(F.split("text", " ")).alias("w"), F.when(F.col("role") == "user", 1.2).otherwise(1.0).alias("x"), F.lit(1.0).alias("y"))
    return C.looks_like_slides(pages, "conv_id", "w", "x", "y")
