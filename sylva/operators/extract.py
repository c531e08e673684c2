"""Entities and relations out of nodes by a text provider: prompts by kind of node, records, repair, synthesis.

Every function is a plan around complete(): prompts are columns, answers are records for entities.parse_records().

Cases: nodes without text give no prompt; an answer that holds no record gives no row; a provider's error gives none either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylva.functions import text as T
from sylva.operators import entities as E
from sylva.operators import tree
from sylva.plans.providers import TextProvider, complete
from sylva.stages import stage_table

#: The weight of a relation between a table and what stands in it.
TABLE_WEIGHT = 9.0
UNKNOWN = "UNKNOWN"


class CapitalisedRecords(TextProvider):
    """Records of the capitalised words behind the last blank line of a prompt, and of those that follow each other."""

    def complete(self, prompts):
        import re

        out = []
        for p in prompts:
            names = list(dict.fromkeys(re.findall(r"\b[A-Z][a-z]{3,}\b", p.rsplit("\n\n", 1)[-1], re.ASCII)))
            records = [f'("entity"<|>"{n}"<|>"term"<|>"{n}")' for n in names]
            records += [f'("relationship"<|>"{a}"<|>"{b}"<|>"next to"<|>1)' for a, b in zip(names, names[1:])]
            out.append("##".join(records))
        return out


def _prompt(task: str, *parts: Column) -> Column:
    return F.concat_ws("\n\n", F.lit(task), *parts)


def from_texts(nodes: DataFrame, model: TextProvider, budget: int = 500, gleanings: int = 1) -> DataFrame:
    """(node_id, chunk, record_text): answers for each chunk of `budget` words, and for up to `gleanings` requests for what was missed.

    A chunk is asked again as long as the answer before held a record.
    """
    cut = nodes.where(F.coalesce(F.trim("text"), F.lit("")) != "").select("node_id", F.posexplode(T.chunks(F.col("text"), budget)).alias("chunk", "text"))
    asked = stage_table(complete(cut.withColumn("prompt", _prompt("List entities and relationships.", F.col("text"))), "prompt", "record_text", model), "extracted")
    out, last = asked.select("node_id", "chunk", "record_text"), asked
    for _ in range(gleanings):
        more = last.where(F.contains("record_text", F.lit("(")))
        more = more.withColumn("prompt", _prompt("Some were missed. List only those.", F.col("record_text"), F.col("text"))).drop("record_text")
        last = stage_table(complete(more, "prompt", "record_text", model), "gleaned")
        out = out.unionByName(last.select("node_id", "chunk", "record_text"))
    return out


def row_batches(lines: DataFrame, key: str, order: str, line: str, budget: int) -> DataFrame:
    """(key, batch, text): a table's lines in their order, as many in a batch as fit into `budget` words.

    A table's lines run through one task in their order, which holds a count and no lines, however many there are.
    """
    import pyarrow as pa

    count = F.greatest(F.coalesce(T.n_tokens(F.col(line)), F.lit(0)), F.lit(0))
    rows = lines.select(key, F.col(order).alias("_o"), F.col(line).alias("_t"), count.alias("_n"))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def place(batches):
        at, held, batch = object(), 0, 0
        for x in batches:
            placed = []
            for k, n in zip(x.column(0).to_pylist(), x.column(3).to_pylist()):
                if k != at:
                    at, held, batch = k, n, 0
                elif held + n > budget:
                    held, batch = n, batch + 1
                else:
                    held += n
                placed.append(batch)
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(placed, pa.int32())], names=[*x.schema.names, "batch"])

    placed = rows.repartition(F.col(key)).sortWithinPartitions(key, "_o", "_t").mapInArrow(place, f"{shape}, batch int")
    return placed.groupBy(key, "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_t"))), lambda x: x["_t"]), "\n").alias("text"))


def from_tables(tables: DataFrame, lines: DataFrame, model: TextProvider, budget: int = 500) -> tuple[DataFrame, DataFrame]:
    """Entities (node_id, name, type, description) and relations (node_id, src, dst, relation, weight) of tables.

    tables: node_id, caption, headers. First the caption and the headers are asked for, then the rows (lines: node_id, row,
    line) in batches; a name counts as it is found first. The table itself is an entity, and each entity in it hangs on it.
    """
    head = tables.select("node_id", F.lit(-1).alias("batch"), F.concat_ws("\n", "caption", F.array_join("headers", ", ")).alias("text"))
    body = row_batches(lines, "node_id", "row", "line", budget).select("node_id", "batch", "text")
    asked = head.unionByName(body).where(F.trim("text") != "").withColumn("prompt", _prompt("List entities of this table.", F.col("text")))
    answers = stage_table(complete(asked, "prompt", "record_text", model).select("node_id", "batch", "record_text"), "table-records")
    found = E.entities_of(E.parse_records(answers))
    order = Window.partitionBy("node_id", "name").orderBy("batch", "type", "description")
    first = found.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("node_id", "name", "type", "description")
    own = tables.select("node_id", T.clean_name(F.coalesce("caption", F.concat(F.lit("table "), F.col("node_id").cast("string")))).alias("name"), F.lit("TABLE").alias("type"), F.col("caption").alias("description"))
    star = first.join(own.select("node_id", F.col("name").alias("src")), "node_id").where("name <> src").select("node_id", "src", F.col("name").alias("dst"), F.lit("contains").alias("relation"), F.lit(TABLE_WEIGHT).alias("weight"))
    return first.unionByName(own), star


def from_pictures(nodes: DataFrame, model: TextProvider, kind: str, fallback: Column) -> DataFrame:
    """(node_id, name, type, description): entities of images or equations from their text; where an answer has none, the node itself, named by fallback."""
    asked = nodes.withColumn("prompt", _prompt(f"List entities of this {kind}.", F.coalesce("text", F.lit(""))))
    answers = stage_table(complete(asked.select("node_id", "prompt"), "prompt", "record_text", model), f"{kind}-records")
    found = E.entities_of(E.parse_records(answers)).select("node_id", "name", "type", "description")
    none = nodes.join(found.select("node_id").distinct(), "node_id", "left_anti")
    return found.unionByName(none.select("node_id", T.clean_name(fallback).alias("name"), F.lit(kind.upper()).alias("type"), F.col("text").alias("description")))


def title_context(nodes: DataFrame) -> DataFrame:
    """(node_id, context): of each title the titles above it, from the root on, and the ones before and behind it among its siblings."""
    up = tree.closure(nodes.select("node_id", "parent_id")).where("dist > 0").join(nodes.select(F.col("node_id").alias("ancestor_id"), "text"), "ancestor_id")
    path = up.groupBy("node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("dist")).alias("o"), "text"))), lambda x: x["text"]), " > ").alias("path"))
    order = Window.partitionBy("parent_id").orderBy("node_id")
    near = nodes.withColumn("before", F.lag("text").over(order)).withColumn("behind", F.lead("text").over(order))
    return near.join(path, "node_id", "left").select("node_id", F.concat_ws("\n", F.concat(F.lit("Path: "), "path"), F.concat(F.lit("Before: "), "before"), F.concat(F.lit("Title: "), "text"), F.concat(F.lit("Behind: "), "behind")).alias("context"))


def from_titles(nodes: DataFrame, model: TextProvider) -> DataFrame:
    """(node_id, record_text): answers for titles (node_id, parent_id, text) in their context."""
    return complete(title_context(nodes).select("node_id", _prompt("List entities of this title.", F.col("context")).alias("prompt")), "prompt", "record_text", model).select("node_id", "record_text")


def repair(found: DataFrame, relations: DataFrame, source: str = "node_id", least: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """Entities merged by name and type, and relations whose ends are entities of the same source.

    An end that is no entity's name becomes the nearest name of its source, if that is `least` alike, else an entity of
    type UNKNOWN. Of relations that are then equal the first stays.
    """
    merged = E.merge(found, source, source)
    names = found.select(source, "name").distinct()
    ends = relations.select(source, F.explode(F.array("src", "dst")).alias("asked")).distinct()
    nearest = stage_table(E.closest_names(ends, names, source, least).select(source, "asked", "name"), "nearest-names")
    for end in ("src", "dst"):
        relations = relations.join(nearest.select(source, F.col("asked").alias(end), F.col("name").alias("_n")), [source, end], "left").withColumn(end, F.coalesce("_n", end)).drop("_n")
    missing = ends.join(nearest, [source, "asked"], "left_anti").groupBy(F.col("asked").alias("name")).agg(F.array_sort(F.collect_set(source)).alias("source_ids"))
    unknown = missing.select("name", F.lit(UNKNOWN).alias("type"), F.lit("").alias("description"), "source_ids")
    return merged.unionByName(unknown), E.dedup_relations(relations.where("src <> dst"), source)


def chosen(options: DataFrame, model: TextProvider) -> DataFrame:
    """(entity, other): the candidate (options: entity, other, score) that a provider picks by number, from 1 in falling order of score.

    -1, a number out of range, no number and an error pick none.
    """
    order = Window.partitionBy("entity").orderBy(F.desc("score"), "other")
    listed = options.withColumn("n", F.row_number().over(order)).groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("n", "other"))).alias("os"))
    lines = F.array_join(F.transform("os", lambda o: F.concat(o["n"].cast("string"), F.lit(". "), o["other"].cast("string"))), "\n")
    asked = complete(listed.withColumn("prompt", _prompt("Which of these is the same as the first line? Give its number, or -1.", F.col("entity").cast("string"), lines)), "prompt", "answer", model)
    n = F.regexp_extract("answer", r"^\s*(-?\d+)\s*$", 1).try_cast("int")
    return asked.withColumn("n", n).where((F.col("n") >= 1) & (F.col("n") <= F.size("os"))).select("entity", F.get("os", F.col("n") - 1)["other"].alias("other"))


def resolve_with(found: DataFrame, similar: DataFrame, model: TextProvider) -> DataFrame:
    """(entity, canonical): entities (entity, type) resolved by candidates of similar (entity, other, distance, score) and a provider's choice.

    Those of type UNKNOWN join known ones, never the other way round. The order in which entities came does not matter.
    """
    known = similar.join(found.where(F.col("type") != UNKNOWN).select(F.col("entity").alias("other")), "other", "left_semi")
    pairs = chosen(E.candidates(known.select("entity", "other", "distance", "score")).select("entity", "other", "score"), model)
    return E.resolve(found, pairs)


def synthesised(merged: DataFrame, model: TextProvider, separator: str = E.SEPARATOR) -> DataFrame:
    """merged with descriptions of several parts replaced by a provider's one; the others stay."""
    several = F.contains("description", F.lit(separator))
    asked = complete(merged.where(several).withColumn("_p", _prompt("Put these descriptions together.", F.replace(F.col("description"), F.lit(separator), F.lit(". ")))), "_p", "_said", model)
    kept = merged.where(~several | F.col("description").isNull())
    return kept.unionByName(asked.withColumn("description", F.col("_said")).drop("_p", "_said"))
