"""Extraction, repair, collections and outlines joined with titles, on documents, parts and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylva.catalog import query, table
from sylva.operators import collections as C
from sylva.operators import extract as X
from sylva.operators import tree


def _nodes(spark, sf_dir):
    """Parts as nodes of four kinds."""
    part = table(spark, sf_dir, "part")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("image", "table", "text", "title")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return part.select(
        F.col("p_partkey").alias("node_id"), kind.alias("type"), F.col("p_name").alias("content"), F.col("p_name").alias("text"), F.when(F.col("p_size") > 25, F.col("p_brand")).alias("caption"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("footnote"), F.col("p_type").alias("table_body"), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("img/"), F.col("p_partkey").cast("string"))).alias("img_path"),
        (F.col("p_size") - 1).cast("int").alias("page_idx"), F.col("p_brand").alias("brand"),
    )


NODES = """n AS (SELECT p_partkey AS node_id, (['image', 'table', 'text', 'title'])[p_partkey % 4 + 1] AS type, p_name AS content, CASE WHEN p_size > 25 THEN p_brand END AS caption,
  CASE WHEN p_size % 2 = 0 THEN p_type END AS footnote, p_type AS table_body, CASE WHEN p_size % 3 = 0 THEN 'img/' || p_partkey END AS img_path, p_size AS page, p_brand AS brand FROM part)"""


@query("indexable_nodes", f"""WITH {NODES}, x AS (SELECT node_id, nullif(trim(CASE type WHEN 'image' THEN concat_ws(' ', caption, footnote) WHEN 'table' THEN concat_ws(' ', content, table_body) ELSE content END), '') AS text,
  CASE WHEN type = 'image' THEN img_path END AS image FROM n) SELECT * FROM x WHERE text IS NOT NULL OR image IS NOT NULL""")
def indexable_nodes(spark, sf_dir):
    return C.indexable(_nodes(spark, sf_dir))


@query("evidence_split", f"WITH {NODES} SELECT node_id, page, CASE WHEN type = 'image' THEN img_path ELSE content END AS shown, type = 'image' AS picture FROM n")
def evidence_split(spark, sf_dir):
    texts, images = C.split_evidence(_nodes(spark, sf_dir))
    return texts.select("node_id", "page", F.col("text").alias("shown"), F.lit(False).alias("picture")).unionByName(images.select("node_id", "page", F.col("img_path").alias("shown"), F.lit(True).alias("picture")))


@query("first_images", f"WITH {NODES} SELECT brand, node_id, img_path FROM n WHERE type = 'image' AND img_path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY brand ORDER BY node_id) <= 2")
def first_images(spark, sf_dir):
    return C.first_images(_nodes(spark, sf_dir).where("type = 'image'"), "brand", "node_id", 2).select("brand", "node_id", "img_path")


@query("rows_to_json", """SELECT p_brand, '[' || string_agg('{"p_partkey":' || p_partkey || ',"p_size":' || p_size || '}', ',' ORDER BY p_partkey) || ']' AS json FROM part GROUP BY p_brand""")
def rows_to_json(spark, sf_dir):
    return C.pretty_rows(table(spark, sf_dir, "part"), "p_brand", ["p_partkey", "p_size"], "p_partkey")


@query("entity_pages", "SELECT o_custkey, string_agg(p, ',' ORDER BY p) AS pages FROM (SELECT o_custkey, p FROM (SELECT DISTINCT o_custkey, o_orderkey % 97 AS p FROM orders) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY p) <= 10) GROUP BY o_custkey")
def entity_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 97).alias("p"))
    return C.entity_pages(pages, "o_custkey", "p").select("o_custkey", F.array_join("pages", ",").alias("pages"))


@query("row_batches", """WITH RECURSIVE l AS (SELECT p_brand AS k, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i, p_partkey AS o, len(string_split_regex(trim(p_name || ' ' || p_type), '\\s+')) AS n FROM part),
r AS (SELECT k, i, o, n AS held, 0 AS batch FROM l WHERE i = 1 UNION ALL SELECT l.k, l.i, l.o, CASE WHEN held + l.n > 40 THEN l.n ELSE held + l.n END, CASE WHEN held + l.n > 40 THEN batch + 1 ELSE batch END FROM r JOIN l ON l.k = r.k AND l.i = r.i + 1)
SELECT k AS p_brand, batch, count(*) AS lines FROM r GROUP BY k, batch""")
def row_batches(spark, sf_dir):
    lines = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("line"))
    return X.row_batches(lines, "p_brand", "p_partkey", "line", 40).select("p_brand", "batch", (F.size(F.split("text", "\n"))).cast("long").alias("lines"))


WORDS = r"""m AS (SELECT doc_id, i AS pos, w AS name FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '\b[A-Z][a-z]{3,}\b'), lambda x, i: {'w': x, 'i': i}), recursive := true) FROM documents)),
f AS (SELECT doc_id, lower(name) AS name, row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) AS i FROM m GROUP BY doc_id, m.name)"""


def _extracted(spark, sf_dir):
    from sylva.operators import entities as E
    from sylva.stages import stage_table

    # Chunks as long as any document: a document is one prompt.
    answers = X.from_texts(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), F.regexp_replace("text", r"\n\n+", "\n").alias("text")), X.CapitalisedRecords(), budget=1_000_000, gleanings=0)
    records = stage_table(E.parse_records(answers), "records")
    return E.entities_of(records), E.relations_of(records)


@query("extracted_entities", f"WITH {WORDS} SELECT doc_id AS node_id, count(*) AS n, min(name) AS low FROM f GROUP BY doc_id")
def extracted_entities(spark, sf_dir):
    found, _ = _extracted(spark, sf_dir)
    return found.groupBy("node_id").agg(F.count("*").alias("n"), F.min("name").alias("low"))


@query("extracted_relations", f"WITH {WORDS} SELECT a.doc_id AS node_id, count(*) AS n, min(a.name || '-' || b.name) AS low FROM f a JOIN f b ON b.doc_id = a.doc_id AND b.i = a.i + 1 GROUP BY a.doc_id")
def extracted_relations(spark, sf_dir):
    _, relations = _extracted(spark, sf_dir)
    return relations.groupBy("node_id").agg(F.count("*").alias("n"), F.min(F.concat_ws("-", "src", "dst")).alias("low"))


@query("table_star", """SELECT p_brand AS node_id, count(*) AS n, round(sum(9.0), 1) AS weight FROM (SELECT DISTINCT p_brand, lower(w) AS w FROM (SELECT p_brand, unnest(regexp_extract_all(upper(left(p_name, 1)) || lower(substr(split_part(p_name, ' ', 1), 2)), '\\b[A-Z][a-z]{3,}\\b')) AS w FROM part)) GROUP BY p_brand""")
def table_star(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    first = F.split("p_name", " ")[0]
    lines = part.select(F.col("p_brand").alias("node_id"), F.col("p_partkey").alias("row"), F.initcap(first).alias("line"))
    tables = part.select(F.col("p_brand").alias("node_id")).distinct().withColumn("caption", F.concat(F.lit("caption of "), F.lower("node_id"))).withColumn("headers", F.array(F.lit("name")))
    _, star = X.from_tables(tables, lines, X.CapitalisedRecords(), 50)
    return star.groupBy("node_id").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 1).alias("weight"))


@query("title_context", """WITH t AS (SELECT 'r' || r_regionkey AS node_id, NULL AS parent_id, r_name AS text FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation),
w AS (SELECT *, lag(text) OVER (PARTITION BY parent_id ORDER BY node_id) AS before, lead(text) OVER (PARTITION BY parent_id ORDER BY node_id) AS behind FROM t)
SELECT w.node_id, concat_ws(chr(10), 'Path: ' || p.text, 'Before: ' || before, 'Title: ' || w.text, 'Behind: ' || behind) AS context FROM w LEFT JOIN t p ON p.node_id = w.parent_id""")
def title_context(spark, sf_dir):
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    titles = r.select(key("r", "r_regionkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("text")).union(n.select(key("n", "n_nationkey"), key("r", "n_regionkey"), "n_name"))
    return X.title_context(titles)


@query("assembled_tree", """WITH b AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pdf_id, o_orderkey % 4 = 0 AS head, o_orderkey FROM orders),
t AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY pdf_id) AS k, max(CASE WHEN head THEN pdf_id END) OVER (PARTITION BY doc_id ORDER BY pdf_id) AS last FROM b),
s AS (SELECT * FROM t WHERE k > 0)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pdf_id) AS index_id, pdf_id, CASE WHEN NOT head THEN last WHEN o_orderkey % 8 = 0 THEN 0 END AS parent_pdf_id, head AS is_title FROM s""")
def assembled_tree(spark, sf_dir):
    from pyspark.sql import Window

    blocks = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("pdf_id"), "o_orderkey")
    # Titles: every fourth order; those of level 1 name a parent that is not there and stay detached.
    titles = blocks.where("o_orderkey % 4 = 0").select("doc_id", "pdf_id", F.when(F.col("o_orderkey") % 8 == 0, 0).otherwise(1).alias("level"), F.lit(-5).cast("long").alias("parent"))
    return tree.assemble(blocks, titles).select("doc_id", "index_id", "pdf_id", "parent_pdf_id", "is_title")


@query("bottom_up_summaries", """WITH p AS (SELECT n_regionkey, string_agg(n_name, chr(10) ORDER BY 'n' || n_nationkey) AS kids FROM nation GROUP BY n_regionkey)
SELECT 'r' || r_regionkey AS node_id, r_name || chr(10) || kids AS summary FROM region JOIN p ON n_regionkey = r_regionkey UNION ALL SELECT 'n' || n_nationkey, n_name FROM nation""")
def bottom_up_summaries(spark, sf_dir):
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    nodes = r.select(key("r", "r_regionkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("content")).union(n.select(key("n", "n_nationkey"), key("r", "n_regionkey"), "n_name"))
    return tree.summarise(nodes, _Echo())


@query("outline_titles", "SELECT n_nationkey AS pdf_id, n_name AS title FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 6)")
def outline_titles(spark, sf_dir):
    """New ids of an outline, with the titles that stand at them."""
    n = table(spark, sf_dir, "nation")
    outline, known = n.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("pdf_id")), n.where("n_nationkey < 6").select(F.col("n_nationkey").alias("pdf_id"))
    return outline.join(known, "pdf_id", "left_anti").join(n.select(F.col("n_nationkey").alias("pdf_id"), F.col("n_name").alias("title")), "pdf_id")


class _Echo(X.TextProvider):
    def complete(self, prompts):
        return list(prompts)
