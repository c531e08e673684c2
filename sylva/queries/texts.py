"""Text predicates, repairs and chunks over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylva.catalog import query, table
from sylva.functions import text as T

CONNECTORS = ", ".join(f"'{w}'" for w in T.CONNECTORS)
BARE = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"


@query("incomplete_paragraphs", f"""WITH p AS (SELECT doc_id, line, {BARE.replace('text', 'line')} AS b FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
q AS (SELECT *, regexp_replace(b, '[''"]+$', '') AS u FROM p)
SELECT doc_id, count(*) AS n FROM q WHERE len(string_split_regex(b, '\\s+')) >= 5 AND length(b) >= 25
  AND (b LIKE '%-' OR regexp_matches(u, '[,:;]$') OR NOT regexp_matches(u, '[.!?]$')
       OR lower(regexp_extract(u, '([\\p{{L}}\\p{{N}}_]+)[^\\p{{L}}\\p{{N}}_]*$', 1)) IN ({CONNECTORS}))
GROUP BY doc_id""")
def incomplete_paragraphs(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(T.is_incomplete_paragraph(F.col("line"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("acronym_lines", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, string_split_regex(regexp_replace(unnest(string_split(text, chr(10))), '^\\s+|\\s+$', '', 'g'), '\\s+')[1] AS w FROM documents) WHERE length(w) > 1 AND regexp_matches(w, '\\p{Lu}') AND NOT regexp_matches(w, '\\p{Ll}') GROUP BY doc_id")
def acronym_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(T.begins_with_acronym(F.col("line"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("dash_refine", "SELECT doc_id, md5(regexp_replace(text, '-\\s+', '-', 'g')) AS h FROM documents")
def dash_refine(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.fix_dashes(F.col("text"))).alias("h"))


@query("ocr_truncate", """WITH w AS (SELECT doc_id, text, string_split_regex(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+') AS ws FROM documents),
f AS (SELECT *, list_transform(ws, lambda x: CASE WHEN length(x) = 1 THEN 1 ELSE 0 END) AS ones FROM w),
c AS (SELECT doc_id, text, ws, CASE WHEN len(ws) >= 15 THEN list_min(list_filter(range(0, len(ws) - 14), lambda i: list_sum(ones[i+1:i+15]) >= 14)) END AS cut FROM f)
SELECT doc_id, md5(CASE WHEN cut IS NULL THEN text ELSE array_to_string(ws[1:cut], ' ') END) AS h, cut IS NOT NULL AS truncated FROM c""")
def ocr_truncate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("cut", T.cut_ocr_noise(F.col("text")))
    return docs.select("doc_id", F.md5("cut").alias("h"), (F.col("cut") != F.col("text")).alias("truncated"))


@query("sentence_count", """SELECT doc_id, len(list_filter(string_split(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) AS n FROM documents""")
def sentence_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n"))


@query("chunk_documents")
def chunk_documents(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.chunks(F.col("text"), 200)).alias("chunk_id", "chunk"))
    return chunks.select("doc_id", "chunk_id", T.n_tokens(F.col("chunk")).alias("n_tokens"), F.md5("chunk").alias("h"))


@query("packed_turns")
def packed_turns(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.n_tokens(F.col("text")).alias("n"))
    packed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "n"))).alias("ts")).withColumn("bins", T.pack_in_order(F.transform("ts", lambda t: t["n"]), 300))
    return packed.select("conv_id", F.explode(F.arrays_zip(F.col("ts.turn").alias("turn"), "bins")).alias("x")).select("conv_id", F.col("x.turn").alias("turn"), F.col("x.bins").alias("bin"))


@query("prefix_fill", """WITH s AS (SELECT conv_id, turn, sum(len(string_split_regex(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+'))) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM conversations)
SELECT conv_id, count(*) FILTER (WHERE upto <= 400) AS n FROM s GROUP BY conv_id""")
def prefix_fill(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.n_tokens(F.col("text")).alias("n"))
    held = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "n"))).alias("ts"))
    return held.select("conv_id", F.size(T.prefix_within(F.col("ts"), F.transform("ts", lambda t: t["n"]), 400)).cast("long").alias("n"))


@query("dehyphen_join", """WITH p AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '' AND x <> '-') AS ls FROM documents)
SELECT doc_id, md5(array_to_string(list_transform(ls, lambda x, i: CASE WHEN i = len(ls) THEN x WHEN x LIKE '%-' THEN left(x, length(x) - 1) ELSE x || ' ' END), '')) AS h FROM p""")
def dehyphen_join(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("ls"))
    return lines.select("doc_id", F.md5(T.join_hyphenated(F.col("ls"))).alias("h"))


@query("first_words", "SELECT doc_id, md5(CASE WHEN len(ws) > 100 THEN array_to_string(ws[1:100], ' ') ELSE text END) AS h FROM (SELECT doc_id, text, string_split_regex(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+') AS ws FROM documents)")
def first_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.first_words(F.col("text"))).alias("h"))


@query("marker_split", "SELECT doc_id, len(list_filter(list_transform(string_split_regex(text, '\\*\\*\\*|\\||\\. '), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')) AS n FROM documents")
def marker_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.split_at(F.col("text"), ["***", "|", ". "])).cast("long").alias("n"))


@query("symbol_split", "SELECT doc_id, len(list_filter(string_split_regex(text, '[^\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+'), lambda x: x <> '')) AS n FROM documents")
def symbol_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.split_symbols(F.col("text"))).cast("long").alias("n"))


@query("clean_strings", "SELECT page_id, trim(regexp_replace(lower(regexp_replace(url, '[\\x00-\\x1f\\x7f-\\x9f]', '', 'g')), '[^A-Za-z0-9 ]', ' ', 'g')) AS cleaned FROM pages")
def clean_strings(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.clean(F.col("url")).alias("cleaned"))


@query("clean_names", "SELECT p_partkey, regexp_replace(trim(lower(p_name)), '\\s+', ' ', 'g') AS name, replace(upper(trim(p_type)), ' ', '_') AS kind FROM part")
def clean_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.clean_name(F.col("p_name")).alias("name"), T.clean_type(F.col("p_type")).alias("kind"))


@query("number_tests", """SELECT v, regexp_matches(v, '^[-+]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][-+]?[0-9]+)?$') AS is_number, regexp_matches(v, '^[-+]?[0-9]*\\.?[0-9]+$') AS plain, regexp_matches(v, '[a-zA-Z]') AS letters
FROM (SELECT DISTINCT CAST(o_orderpriority AS VARCHAR) AS v FROM orders UNION SELECT CAST(p_size AS VARCHAR) FROM part UNION SELECT p_brand FROM part)""")
def number_tests(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    v = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("v")).union(part.select(F.col("p_size").cast("string"))).union(part.select("p_brand")).distinct()
    return v.select("v", T.is_number(F.col("v")).alias("is_number"), T.is_plain_float(F.col("v")).alias("plain"), T.has_letters(F.col("v")).alias("letters"))


@query("uuid5_key", """WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('doc-' || doc_id)) AS h FROM documents)
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::INT & 3) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM h""")
def uuid5_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.uuid5(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))).alias("uuid"))
