"""Tree operators on region -> nation -> customer -> order -> line, and outlines of orders with lines as blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylva.catalog import query, table
from sylva.operators import filters, tree

NODES = """nodes AS (
  SELECT 'r' || r_regionkey AS node_id, NULL AS parent_id, r_name AS title, 0.0 AS value FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, 0.0 FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name, c_acctbal FROM customer
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, o_orderpriority, o_totalprice FROM orders
  UNION ALL SELECT 'l' || l_orderkey || '-' || l_linenumber, 'o' || l_orderkey, max(l_returnflag), sum(l_extendedprice) FROM lineitem GROUP BY l_orderkey, l_linenumber),
closure AS (
  SELECT node_id, node_id AS ancestor_id, parent_id AS up, 0 AS dist FROM nodes
  UNION ALL SELECT c.node_id, n.node_id, n.parent_id, c.dist + 1 FROM closure c JOIN nodes n ON n.node_id = c.up)"""
REC = f"WITH RECURSIVE {NODES}"
DEPTH = None


def nodes(spark, sf_dir):
    """Five levels as one table of nodes."""
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    parts = [
        table(spark, sf_dir, "region").select(key("r", "r_regionkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("title"), F.lit(0.0).alias("value")),
        table(spark, sf_dir, "nation").select(key("n", "n_nationkey"), key("r", "n_regionkey"), "n_name", F.lit(0.0)),
        table(spark, sf_dir, "customer").select(key("c", "c_custkey"), key("n", "c_nationkey"), "c_name", "c_acctbal"),
        table(spark, sf_dir, "orders").select(key("o", "o_orderkey"), key("c", "o_custkey"), "o_orderpriority", "o_totalprice"),
        # Lines share numbers within an order: a number is a node.
        table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("title"), F.sum("l_extendedprice").alias("value"))
        .select(F.concat(F.lit("l"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")), key("o", "l_orderkey"), "title", "value"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


@query("tree_closure", f"{REC} SELECT node_id, ancestor_id, dist FROM closure")
def tree_closure(spark, sf_dir):
    return tree.closure(nodes(spark, sf_dir), DEPTH)


@query("path_from_root", f"{REC} SELECT node_id, string_agg(ancestor_id, '/' ORDER BY dist DESC) AS path FROM closure WHERE ancestor_id NOT LIKE 'r%' GROUP BY node_id")
def path_from_root(spark, sf_dir):
    return tree.paths(nodes(spark, sf_dir), DEPTH).select("node_id", F.array_join("path", "/").alias("path"))


@query("siblings", f"{REC} SELECT a.node_id, b.node_id AS sibling_id FROM nodes a JOIN nodes b ON a.parent_id = b.parent_id AND a.node_id <> b.node_id")
def siblings(spark, sf_dir):
    return tree.siblings(nodes(spark, sf_dir))


@query("subtree_nodes", f"{REC} SELECT DISTINCT node_id FROM closure WHERE ancestor_id IN ('r1', 'n3', 'c7')")
def subtree_nodes(spark, sf_dir):
    roots = spark.createDataFrame([("r1",), ("n3",), ("c7",)], "node_id string")
    return tree.subtree(nodes(spark, sf_dir).select("node_id", "parent_id"), roots).select("node_id")


@query("preorder_rank", f"""{REC}, p AS (SELECT node_id, string_agg(ancestor_id, '/' ORDER BY dist DESC) AS path FROM closure GROUP BY node_id)
SELECT node_id, split_part(path, '/', 1) AS root, row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY string_split(path, '/')) AS rank FROM p""")
def preorder_rank(spark, sf_dir):
    return tree.preorder(nodes(spark, sf_dir))


@query("ancestor_at_depth", f"{REC}, d AS (SELECT node_id, max(dist) AS depth FROM closure GROUP BY node_id) SELECT c.node_id, c.ancestor_id FROM closure c JOIN d ON d.node_id = c.ancestor_id WHERE d.depth = 1")
def ancestor_at_depth(spark, sf_dir):
    return tree.ancestor_at(nodes(spark, sf_dir), 1)


@query("max_depth", f"{REC} SELECT max(dist) AS max_depth FROM closure")
def max_depth(spark, sf_dir):
    return tree.closure(nodes(spark, sf_dir), DEPTH).agg(F.max("dist").alias("max_depth"))


@query("nodes_at_depth", f"{REC} SELECT node_id, max(dist) AS depth FROM closure GROUP BY node_id HAVING max(dist) = 2")
def nodes_at_depth(spark, sf_dir):
    return tree.with_depth(nodes(spark, sf_dir).select("node_id", "parent_id"), DEPTH).where("depth = 2").select("node_id", "depth")


@query("outline_list", f"{REC} SELECT node_id, max(dist) || chr(9) || any_value(title) || chr(9) || node_id AS line FROM closure JOIN nodes USING (node_id) GROUP BY node_id")
def outline_list(spark, sf_dir):
    return tree.outline(nodes(spark, sf_dir).select("node_id", "parent_id", "title"), "title", DEPTH)


@query("level_rollup", f"{REC} SELECT ancestor_id AS node_id, round(sum(value), 2) AS total FROM closure JOIN nodes USING (node_id) GROUP BY ancestor_id")
def level_rollup(spark, sf_dir):
    return tree.roll_up(nodes(spark, sf_dir), "value").select("node_id", F.round("total", 2).alias("total"))


@query("child_summaries", f"""{REC}, k AS (SELECT parent_id, string_agg(title, chr(10) ORDER BY node_id) AS kids FROM nodes WHERE title IS NOT NULL GROUP BY parent_id)
SELECT n.node_id, concat_ws(chr(10), n.title, k.kids) AS digest FROM nodes n LEFT JOIN k ON k.parent_id = n.node_id""")
def child_summaries(spark, sf_dir):
    return tree.child_summaries(nodes(spark, sf_dir), "title", "node_id")


@query("guided_descent", f"""{REC}, best AS (SELECT parent_id, node_id FROM nodes WHERE parent_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY parent_id ORDER BY value DESC, node_id) = 1),
walk AS (SELECT node_id AS start_id, 0 AS step, node_id FROM nodes WHERE parent_id IS NULL UNION ALL SELECT w.start_id, w.step + 1, b.node_id FROM walk w JOIN best b ON b.parent_id = w.node_id)
SELECT start_id, step, node_id FROM walk""")
def guided_descent(spark, sf_dir):
    all_nodes = nodes(spark, sf_dir)
    return tree.descend(all_nodes, all_nodes.where("parent_id is null"), "value", max_depth=DEPTH)


@query("section_link", f"{REC}, d AS (SELECT node_id, max(dist) AS depth FROM closure GROUP BY node_id) SELECT c.ancestor_id AS section, count(DISTINCT o.title) AS entities, count(*) AS n FROM closure c JOIN d ON d.node_id = c.ancestor_id AND d.depth = 2 JOIN nodes o ON o.node_id = c.node_id WHERE o.node_id LIKE 'o%' GROUP BY c.ancestor_id")
def section_link(spark, sf_dir):
    of = tree.with_ancestor(nodes(spark, sf_dir).select("node_id", "parent_id", "title"), 2).withColumnRenamed("ancestor_id", "section")
    return of.where("node_id like 'o%'").groupBy("section").agg(F.countDistinct("title").alias("entities"), F.count("*").alias("n"))


# Orders as documents, their lines as blocks; a line's level is its number modulo 4.
LINES = "t AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS pos, l_linenumber % 4 AS level FROM lineitem)"


def lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("pos"), (F.col("l_linenumber") % 4).alias("level")).distinct()


@query("section_parent_nearest_smaller", f"WITH {LINES} SELECT doc, pos, level, coalesce((SELECT max(b.pos) FROM t b WHERE b.doc = t.doc AND b.pos < t.pos AND b.level < t.level), 0) AS naive_parent FROM t")
def section_parent_nearest_smaller(spark, sf_dir):
    return tree.nearest_smaller(lines(spark, sf_dir), "doc", "pos", "level", 3)


@query("outline_repair", f"""WITH {LINES}, p AS (SELECT doc, pos, level, coalesce((SELECT max(b.pos) FROM t b WHERE b.doc = t.doc AND b.pos < t.pos AND b.level < t.level), 0) AS parent FROM t),
q AS (SELECT *, CASE WHEN NOT bool_or(level = 0) OVER (PARTITION BY doc) AND pos = min(pos) OVER (PARTITION BY doc) THEN 0 ELSE level END AS l2 FROM p),
z AS (SELECT *, min(CASE WHEN l2 = 0 THEN pos END) OVER (PARTITION BY doc) AS top FROM q)
SELECT doc, pos, l2 AS level, CASE WHEN l2 = 0 THEN 0 WHEN parent = 0 THEN top ELSE parent END AS parent FROM z""")
def outline_repair(spark, sf_dir):
    naive = tree.nearest_smaller(lines(spark, sf_dir), "doc", "pos", "level", 3).withColumnRenamed("naive_parent", "parent")
    return tree.repair_outline(naive, "doc", "pos", "level", "parent")


@query("section_extent", f"WITH {LINES}, n AS (SELECT doc, max(pos) AS n FROM t GROUP BY doc) SELECT doc, pos, coalesce(lead(pos) OVER (PARTITION BY doc ORDER BY pos), n + 1) AS end_id FROM t JOIN n USING (doc) WHERE level < 2")
def section_extent(spark, sf_dir):
    from pyspark.sql import Window

    blocks = lines(spark, sf_dir).withColumn("n", F.max("pos").over(Window.partitionBy("doc")))
    return tree.extents(blocks.where("level < 2"), "doc", "pos", "n").select("doc", "pos", "end_id")


@query("section_blocks", f"WITH {LINES} SELECT doc, pos, (SELECT max(b.pos) FROM t b WHERE b.doc = t.doc AND b.pos < t.pos AND b.level < 2) AS section_id FROM t WHERE level >= 2 AND EXISTS (SELECT 1 FROM t b WHERE b.doc = t.doc AND b.pos < t.pos AND b.level < 2)")
def section_blocks(spark, sf_dir):
    return tree.section_of(lines(spark, sf_dir), "doc", "pos", F.col("level") < 2).where("level >= 2 and section_id is not null").select("doc", "pos", "section_id")


@query("dropped_blocks", f"WITH {LINES} SELECT doc, pos FROM t WHERE level >= 2 AND NOT EXISTS (SELECT 1 FROM t b WHERE b.doc = t.doc AND b.pos < t.pos AND b.level < 2)")
def dropped_blocks(spark, sf_dir):
    return tree.section_of(lines(spark, sf_dir), "doc", "pos", F.col("level") < 2).where("level >= 2 and section_id is null").select("doc", "pos")


@query("effective_height", """WITH b AS (SELECT p_partkey, CAST(length(p_name) AS DOUBLE) AS chars, CAST(p_size AS DOUBLE) * 3 AS w, p_retailprice / 50 AS h FROM part),
l AS (SELECT *, CASE WHEN w / h > 15 THEN 1.0 ELSE greatest(1.0, round_even(sqrt(0.5 * chars * h / w), 0)) END AS n FROM b)
SELECT p_partkey, round(CASE WHEN w <= 0 OR h <= 0 OR chars = 0 THEN greatest(h, 0.0) ELSE h / n END, 6) AS height FROM l""")
def effective_height(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", F.round(tree.effective_height(F.length("p_name").cast("double"), F.col("p_size").cast("double") * 3, F.col("p_retailprice") / 50), 6).alias("height"))


# Orders as nodes: page is the month from 0, kind the priority class, titles the way to the customer.
@query("structural_filter_count", "SELECT count(*) AS n FROM orders WHERE month(o_orderdate) = 5 AND o_orderpriority LIKE '%URGENT%'")
def structural_filter_count(spark, sf_dir):
    return filters.structural(order_nodes(spark, sf_dir), [("page", "5"), ("section", "urgent")]).agg(F.count("*").alias("n"))


@query("structural_filter_range", "SELECT o_orderkey FROM orders WHERE month(o_orderdate) BETWEEN 3 AND 10 AND o_orderstatus = 'F'")
def structural_filter_range(spark, sf_dir):
    return filters.structural(order_nodes(spark, sf_dir), [("page", "3-10"), ("table", None)]).select("o_orderkey")


@query("filter_null_noop", "SELECT count(*) AS n, sum(o_totalprice) IS NOT NULL AS any_price FROM orders")
def filter_null_noop(spark, sf_dir):
    return filters.structural(order_nodes(spark, sf_dir), [("section", None), ("page", "soon")]).agg(F.count("*").alias("n"), F.sum("o_totalprice").isNotNull().alias("any_price"))


def order_nodes(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "F", "table").when(F.col("o_orderstatus") == "O", "text").otherwise("image")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", (F.month("o_orderdate") - 1).alias("page_idx"), kind.alias("type"), F.array(F.lit("Orders "), "o_orderpriority").alias("path_titles"))


@query("point_lookup", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (7, 3, 100)")
def point_lookup(spark, sf_dir):
    return filters.lookup(table(spark, sf_dir, "orders"), [7, 3, 10**15, 100], "o_orderkey").select("o_orderkey", "o_orderstatus")


@query("renumbered_blocks", "SELECT l_orderkey, pos, row_number() OVER (PARTITION BY l_orderkey ORDER BY pos) AS pdf_id FROM (SELECT DISTINCT l_orderkey, l_linenumber AS pos FROM lineitem WHERE l_linenumber % 3 <> 0)")
def renumbered_blocks(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("pos")).distinct().withColumn("invalid", F.col("pos") % 3 == 0)
    return filters.renumber(rows, "l_orderkey", "pos", "invalid").drop("invalid")


@query("type_route", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'fused' WHEN o_orderstatus = 'O' THEN 'text' ELSE 'image' END AS route FROM orders")
def type_route(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    rows = orders.withColumn("t", F.when(F.col("o_orderstatus").isin("F", "O"), "x")).withColumn("i", F.when(F.col("o_orderstatus") != "O", "y"))
    return filters.route(rows, "t", "i").select("o_orderkey", "route")
