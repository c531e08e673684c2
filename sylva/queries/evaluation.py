"""Answer scores over pairs of texts from parts, orders, documents and benchmark items."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylva.catalog import bounded, query, table
from sylva.functions import scores as S

ANLS = "CASE WHEN 1 - levenshtein(g, p) / greatest(length(g), length(p)) <= 0.5 THEN 0.0 ELSE 1 - levenshtein(g, p) / greatest(length(g), length(p)) END"
PAIRS = "x AS (SELECT a.p_partkey AS id, a.p_name AS g, b.p_name AS p FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)"
NORM = "array_to_string(list_filter(string_split_regex(regexp_replace(lower({c}), '[!\"#$%&''()*+,\\-./:;<=>?@\\[\\\\\\]^_`{{|}}~]', '', 'g'), '\\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"


def _pairs(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("g")).join(part.select((F.col("p_partkey") - 1).alias("id"), F.col("p_name").alias("p")), "id")


@query("anls_scores", f"WITH {PAIRS} SELECT id, round({ANLS}, 6) AS anls FROM x")
def anls_scores(spark, sf_dir):
    return _pairs(spark, sf_dir).select("id", F.round(S.anls(F.col("g"), F.col("p")), 6).alias("anls"))


@query("edit_distance", f"WITH {PAIRS} SELECT id, levenshtein(g, p) AS distance, round(1 - levenshtein(g, p) / greatest(length(g), length(p)), 6) AS similarity FROM x")
def edit_distance(spark, sf_dir):
    longest = F.greatest(F.length("g"), F.length("p"))
    return _pairs(spark, sf_dir).select("id", F.levenshtein("g", "p").cast("long").alias("distance"), F.round(1 - F.levenshtein("g", "p") / longest, 6).alias("similarity"))


@query("normalized_answer", f"SELECT item_id, {NORM.format(c='text')} AS answer FROM benchmark")
def normalized_answer(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", S.normalize_answer(F.col("text")).alias("answer"))


@query("token_f1", f"""WITH d AS (SELECT doc_id, string_split({NORM.format(c='text')}, ' ') AS p FROM documents), b AS (SELECT item_id, string_split({NORM.format(c='text')}, ' ') AS g FROM benchmark),
x AS (SELECT doc_id, len(p) AS np, len(g) AS ng, list_sum(list_transform(list_distinct(g), lambda w: least(len(list_filter(g, lambda y: y = w)), len(list_filter(p, lambda y: y = w))))) AS c FROM d JOIN b ON item_id = doc_id % (SELECT count(*) FROM benchmark))
SELECT doc_id, round(CASE WHEN c = 0 THEN 0.0 ELSE 2.0 * c / (np + ng) END, 6) AS f1 FROM x""")
def token_f1(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("k"), F.col("text").alias("gold"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % items.count()).alias("k")).join(bounded(items), "k")
    return docs.select("doc_id", F.round(S.token_f1(F.col("text"), F.col("gold")), 6).alias("f1"))


@query("paragraph_f1", """WITH d AS (SELECT doc_id, list_distinct(string_split(text, chr(10))) AS p FROM documents),
x AS (SELECT a.doc_id, len(a.p) AS np, len(b.p) AS ng, len(list_intersect(a.p, b.p)) AS c FROM d a JOIN d b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, round(CASE WHEN c = 0 THEN 0.0 ELSE 2.0 * c / (np + ng) END, 6) AS f1 FROM x""")
def paragraph_f1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.split("text", "\n")).alias("p"))
    pairs = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("p").alias("g")), "doc_id")
    return pairs.select("doc_id", F.round(S.paragraph_f1(F.col("p"), F.col("g")), 6).alias("f1"))


@query("typed_eval_score", f"""WITH x AS (SELECT a.p_partkey AS id, CAST(a.p_size AS VARCHAR) AS gi, CAST(b.p_size AS VARCHAR) AS pi, a.p_name AS g, b.p_name AS p FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)
SELECT id, round(CASE WHEN id % 2 = 0 THEN (gi = pi)::INT::DOUBLE ELSE {ANLS} END, 6) AS score FROM x""")
def typed_eval_score(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    a = part.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("string").alias("gi"), F.col("p_name").alias("g"))
    b = part.select((F.col("p_partkey") - 1).alias("id"), F.col("p_size").cast("string").alias("pi"), F.col("p_name").alias("p"))
    whole = F.col("id") % 2 == 0
    x = a.join(b, "id").select("id", F.when(whole, F.col("gi")).otherwise(F.col("g")).alias("gold"), F.when(whole, F.col("pi")).otherwise(F.col("p")).alias("pred"), F.when(whole, "Int").otherwise("Str").alias("kind"))
    return x.select("id", F.round(S.typed_score(F.col("gold"), F.col("pred"), F.col("kind")), 6).alias("score"))


@query("float_equality", "SELECT o_orderkey, abs(o_totalprice / 100 - t) <= 0.01 * greatest(abs(o_totalprice / 100), abs(t)) OR abs(o_totalprice - t) <= 0.01 * greatest(abs(o_totalprice), abs(t)) OR abs(o_totalprice * 100 - t) <= 0.01 * greatest(abs(o_totalprice * 100), abs(t)) AS equal FROM (SELECT o_orderkey, o_totalprice, o_totalprice * (1 + (o_orderkey % 5) / 200) AS t FROM orders)")
def float_equality(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("t", F.col("o_totalprice") * (1 + (F.col("o_orderkey") % 5) / 200))
    return orders.select("o_orderkey", S.numbers_equal(F.col("o_totalprice"), F.col("t"), percent=True, close=True).alias("equal"))


@query("exact_match_required", r"SELECT page_id, url LIKE '%https://%' OR url LIKE '%.py' OR url LIKE '%ipynb' OR url LIKE 'page%' AS exact FROM pages")
def exact_match_required(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.needs_exact_match(F.col("url")).alias("exact"))


@query("acc_and_f1", """WITH x AS (SELECT quality AS gold, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS pred FROM labels JOIN documents USING (doc_id)),
s AS (SELECT avg((gold = pred)::INT) AS acc, sum(CASE WHEN gold = 1 THEN (gold = pred)::INT END) AS hit, count(*) FILTER (WHERE gold = 1) AS ng, count(*) FILTER (WHERE pred = 1) AS np FROM x)
SELECT round(acc, 6) AS accuracy, round(hit / ng, 6) AS recall, round(hit / np, 6) AS precision, round(2 * (hit / ng) * (hit / np) / (hit / ng + hit / np), 6) AS f1 FROM s""")
def acc_and_f1(spark, sf_dir):
    from sylva.operators.evaluate import accuracy_and_f1

    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 1000).cast("int").alias("pred"))
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id").withColumn("score", (F.col("quality") == F.col("pred")).cast("double"))
    return accuracy_and_f1(rows, F.col("quality") == 1, F.col("pred") == 1)


@query("containment_accuracy", f"SELECT doc_id, contains({NORM.format(c='d.text')}, {NORM.format(c='b.text')})::INT AS acc FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)")
def containment_accuracy(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("k"), F.array("text").alias("golds"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % items.count()).alias("k")).join(bounded(items), "k")
    return docs.select("doc_id", S.contains_answer(F.col("text"), F.col("golds")).alias("acc"))


@query("list_answers")
def list_answers(spark, sf_dir):
    lists = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_name")).alias("names"))
    pairs = lists.select(F.col("p_brand").alias("a"), F.col("names").alias("g")).withColumn("b", F.concat(F.lit("Brand#"), (F.regexp_extract("a", "([0-9]+)", 1).cast("int") + 1).cast("string"))).join(lists.select(F.col("p_brand").alias("b"), F.col("names").alias("p")), "b")
    bags = lambda c: F.transform(c, S.bag)
    scored = pairs.select("a", "b", S.list_em(F.col("p"), F.col("g")).alias("em"), S.f1_matrix(bags(F.col("p")), bags(F.col("g"))).alias("m"))
    return S.with_list_f1(scored, "m", "f1")


@query("dataset_means", """SELECT source, count(*) AS n, round(avg(quality), 6) AS quality, round(avg(CASE WHEN toxic = 0 THEN quality END), 6) AS clean_quality FROM labels JOIN documents USING (doc_id) GROUP BY source""")
def dataset_means(spark, sf_dir):
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return joined.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg(F.when(F.col("toxic") == 0, F.col("quality"))), 6).alias("clean_quality"))


@query("two_class_probability", "SELECT p_partkey, round(1 / (1 + exp((p_size - 25) / 10.0 - p_retailprice / 1000)), 6) AS yes FROM part")
def two_class_probability(spark, sf_dir):
    from sylva.functions.vectors import yes_probability

    return table(spark, sf_dir, "part").select("p_partkey", F.round(yes_probability(F.col("p_retailprice") / 1000, (F.col("p_size") - 25) / 10.0), 6).alias("yes"))
