"""Pages, tables and content blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylva.catalog import query, table
from sylva.operators import blocks as B
from sylva.operators import tables as T


@query("html_headings", "SELECT page_id, CAST(i - 1 AS INT) AS position, hs[i] AS heading FROM (SELECT page_id, regexp_extract_all(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS hs FROM pages), range(1, 100) r(i) WHERE i <= len(hs)")
def html_headings(spark, sf_dir):
    return T.html_headings(table(spark, sf_dir, "pages"), "page_id", "html")


@query("html_blocks")
def html_blocks(spark, sf_dir):
    return T.html_blocks(table(spark, sf_dir, "pages"), "page_id", "html")


def nation_tables(spark, sf_dir):
    """One HTML table for each region: a header over its nations and their keys."""
    nation = table(spark, sf_dir, "nation")
    row = F.concat(F.lit("<tr><td>"), "n_name", F.lit("</td><td>"), F.col("n_nationkey").cast("string"), F.lit("</td></tr>"))
    rows = nation.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("r")))), lambda x: x["r"]), "").alias("rows"))
    head = "<table><tr><th colspan=2>Nations</th></tr><tr><th>Name</th><th>Key</th></tr>"
    return rows.select(F.col("n_regionkey").cast("long").alias("t"), F.concat(F.lit(head), "rows", F.lit("</table>")).alias("html"), F.lit("Nations by region").alias("caption"), F.lit("").alias("footnote"))


CELLS = """c AS (SELECT n_regionkey::BIGINT AS t, 0 AS row, unnest([0, 1]) AS col, 'Nations' AS text FROM (SELECT DISTINCT n_regionkey FROM nation)
UNION ALL SELECT n_regionkey, 1, unnest([0, 1]), unnest(['Name', 'Key']) FROM (SELECT DISTINCT n_regionkey FROM nation)
UNION ALL SELECT n_regionkey, 1 + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), 0, n_name FROM nation
UNION ALL SELECT n_regionkey, 1 + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), 1, n_nationkey::VARCHAR FROM nation)"""


@query("table_grid", f"WITH {CELLS} SELECT t, row, col, text FROM c")
def table_grid(spark, sf_dir):
    return T.cells(nation_tables(spark, sf_dir), "t", "html")


@query("table_headers", "SELECT DISTINCT n_regionkey::BIGINT AS t, 2 AS header_rows, 'Nations > Key, Nations > Name' AS headers FROM nation")
def table_headers(spark, sf_dir):
    cell = T.cells(nation_tables(spark, sf_dir), "t", "html")
    counts = T.header_rows(cell, "t")
    return counts.join(T.column_headers(cell, counts, "t"), "t").select("t", "header_rows", F.array_join("headers", ", ").alias("headers"))


@query("table_columns", f"WITH {CELLS} SELECT t, max(col) + 1 AS n_cols FROM c GROUP BY t")
def table_columns(spark, sf_dir):
    return T.column_counts(T.cells(nation_tables(spark, sf_dir), "t", "html"), "t")


@query("table_to_text", """SELECT n_regionkey::BIGINT AS t, 'Caption: Nations by region' || chr(10) || 'This table contains the following columns:' || chr(10) || ' - Nations > Key' || chr(10) || ' - Nations > Name' || chr(10) || chr(10) || 'Table Body:' || chr(10) || 'Nations | Nations' || chr(10) || 'Name | Key' || chr(10) || string_agg(n_name || ' | ' || n_nationkey, chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY n_regionkey""")
def table_to_text(spark, sf_dir):
    return T.to_text(nation_tables(spark, sf_dir), "t", "html", "caption", "footnote")


@query("table_linearised")
def table_linearised(spark, sf_dir):
    return T.linearise(T.cells(nation_tables(spark, sf_dir), "t", "html"), "t")


def document_blocks(spark, sf_dir):
    """Lines of documents as blocks: ten lines a page; lines of under 4 words are titles."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "text"))
    return lines.select("doc_id", (F.col("position") + 1).alias("pdf_id"), F.expr("position div 10").alias("page_idx"), F.lit("text").alias("type"), "text", F.when(F.size(F.split("text", " ")) < 4, 1).alias("text_level"))


@query("paragraph_continuations")
def paragraph_continuations(spark, sf_dir):
    return B.continuations(document_blocks(spark, sf_dir))


@query("stitched_paragraphs")
def stitched_paragraphs(spark, sf_dir):
    blocks = document_blocks(spark, sf_dir)
    nearest = B.continuations(blocks).groupBy("doc_id", "pdf_id").agg(F.min("candidate_id").alias("candidate_id"))
    return B.stitch(blocks, nearest).select("doc_id", "pdf_id", F.md5("text").alias("h"), "invalid")


@query("refined_blocks")
def refined_blocks(spark, sf_dir):
    return B.refine(document_blocks(spark, sf_dir).withColumnRenamed("pdf_id", "position")).select("doc_id", "pdf_id", F.md5("text").alias("h"))


@query("table_continuations", """WITH b AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS pdf_id FROM lineitem), x AS (SELECT *, pdf_id // 2 AS page_idx, CASE WHEN pdf_id % 3 = 0 THEN 'text' ELSE 'table' END AS type, pdf_id % 2 AS n_cols, pdf_id % 5 = 0 AS has_caption FROM b)
SELECT a.doc_id, a.pdf_id, p.pdf_id AS previous_id FROM x a JOIN x p ON p.doc_id = a.doc_id AND p.pdf_id = (SELECT max(q.pdf_id) FROM x q WHERE q.doc_id = a.doc_id AND q.pdf_id < a.pdf_id AND q.type = 'table')
WHERE a.type = 'table' AND NOT a.has_caption AND a.page_idx - p.page_idx BETWEEN 0 AND 1 AND a.n_cols = p.n_cols""")
def table_continuations(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pdf_id")).distinct()
    n = F.col("pdf_id")
    return T.continuations(rows.select("doc_id", "pdf_id", F.expr("pdf_id div 2").alias("page_idx"), F.when(n % 3 == 0, "text").otherwise("table").alias("type"), (n % 2).alias("n_cols"), (n % 5 == 0).alias("has_caption")))


@query("layout_zip", "SELECT doc_id, CAST(i - 1 AS INT) AS position, ls[i] AS content, length(ls[i]) AS boxes FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), range(1, 3000) r(i) WHERE i <= len(ls)")
def layout_zip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("content"))
    return B.zip_layout(docs, docs.select("doc_id", F.transform("content", lambda x: F.length(x)).alias("boxes")), "doc_id")
