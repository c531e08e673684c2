"""Entities and relations extracted from documents: repair, merging, aliases and resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.functions import text as T
from sylva.operators.graph import components
from sylva.stages import free, short_shuffles, stage_table

SEPARATOR = "<SEP>"


def parse_records(rows: DataFrame, text: str = "record_text", field: str = "<|>", record: str = "##") -> DataFrame:
    """rows with records ("entity"<|>name<|>type<|>description)##... as kind and fields; broken records are dropped."""
    cut = F.filter(F.transform(F.split(text, rf"\Q{record}\E"), T.strip), lambda r: r.rlike(r"^\(.*\)$"))
    fields = F.transform(F.split(F.regexp_replace(F.col("_r"), r"^\(|\)$", ""), rf"\Q{field}\E"), lambda f: F.regexp_replace(T.strip(f), '^"|"$', ""))
    return rows.withColumn("_r", F.explode(cut)).withColumn("fields", fields).withColumn("kind", F.lower(F.get("fields", F.lit(0)))).drop("_r").where("size(fields) >= 4")


def entities_of(records: DataFrame) -> DataFrame:
    f = lambda i: F.get("fields", F.lit(i))
    return records.where("kind = 'entity'").withColumns({"name": T.clean_name(f(1)), "type": T.clean_type(f(2)), "description": f(3)}).drop("fields", "kind")


def relations_of(records: DataFrame) -> DataFrame:
    """Relations with a weight, 1.0 where it is missing or no number."""
    f = lambda i: F.get("fields", F.lit(i))
    return records.where("kind = 'relationship'").withColumns({"src": T.clean_name(f(1)), "dst": T.clean_name(f(2)), "relation": f(3), "weight": F.coalesce(f(4).try_cast("double"), F.lit(1.0))}).drop("fields", "kind")


def mentions(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, position, name): capitalised words as entities, what the default extractor finds."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"(?<![\p{L}\p{N}_])(\p{Lu}\p{Ll}{3,})(?![\p{L}\p{N}_])"), F.lit(1))
    return docs.select(doc, F.posexplode(found).alias("position", "name"))


def merge(rows: DataFrame, source: str, order: str, separator: str = SEPARATOR) -> DataFrame:
    """(name, type, description, source_ids): one entity for each name and type; distinct descriptions joined in order."""
    first = rows.groupBy("name", "type", "description").agg(F.min(order).alias("_o"), F.collect_set(source).alias("_s"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "description"))), lambda x: x["description"]), separator)
    return first.groupBy("name", "type").agg(joined.alias("description"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_s")))).alias("source_ids"))


def longest_description(rows: DataFrame) -> DataFrame:
    """(name, type, description): the longest description, the last in order of text among equally long ones."""
    return rows.groupBy("name", "type").agg(F.max_by("description", F.struct(F.length("description"), F.col("description"))).alias("description"))


def dedup_relations(rows: DataFrame, order: str) -> DataFrame:
    w = Window.partitionBy("src", "dst", "relation").orderBy(order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def closest_names(asked: DataFrame, known: DataFrame, block: str, least: float = 0.9) -> DataFrame:
    """(block, asked, name, similarity): for each asked name the nearest known one of its block, if at least `least` alike.

    Equal names are found by an equi-join and leave the comparison. Of two names within the distance that `least` allows
    for the longer of their lengths, the known one, cut into one segment more than that distance, has a segment whole in the
    other, moved by no more characters than the distance: names meet in an equi-join on length, distance and segment, and
    only those that meet are compared.
    """
    exact = asked.join(known.select(block, F.col("name")), [F.col("asked") == F.col("name"), asked[block] == known[block]]).select(asked[block], "asked", "name", F.lit(1.0).alias("similarity"))
    rest = asked.join(known.select(block, F.col("name").alias("asked")), [block, "asked"], "left_anti").where("asked is not null")
    longest_of = lambda n: f"cast(floor({n} / {least:.6f} + 1e-6) as int)"
    far = lambda n: f"cast(floor({1 - least:.6f} * {n} + 1e-6) as int)"
    segment = lambda i: f"named_struct('i', {i}, 'at', cast(floor({i} * n / (k + 1)) as int), 'to', cast(floor(({i} + 1) * n / (k + 1)) as int))"
    held = (
        known.select(block, "name", F.length("name").alias("n")).where("n > 0")
        .withColumn("k", F.expr(f"explode(sequence({far('n')}, {far(longest_of('n'))}))"))
        .withColumn("s", F.expr(f"explode(transform(sequence(0, k), i -> {segment('i')}))"))
        .select(block, "name", "n", "k", F.col("s.i").alias("i"), F.expr("substr(name, s.at + 1, s.to - s.at)").alias("part"))
    )
    probes = (
        rest.select(block, "asked", F.length("asked").alias("m")).where("m > 0")
        .withColumn("n", F.expr(f"explode(sequence(cast(greatest(1, ceil({least:.6f} * m - 1e-6)) as int), {longest_of('m')}))"))
        .withColumn("k", F.expr(far("greatest(m, n)")))
        .withColumn("s", F.expr(f"explode(transform(sequence(0, k), i -> {segment('i')}))"))
        .withColumn("by", F.expr("explode(sequence(-k, k))")).where("s.at + by >= 0 and s.to + by <= m")
        .select(block, "asked", "n", "k", F.col("s.i").alias("i"), F.expr("substr(asked, s.at + by + 1, s.to - s.at)").alias("part"))
    )
    met = probes.join(held, [block, "n", "k", "i", "part"]).select(block, "asked", "name").distinct()
    longest = F.greatest(F.length("asked"), F.length("name"))
    near = met.withColumn("similarity", 1 - F.levenshtein("asked", "name") / longest).where(F.col("similarity") >= least)
    best = near.groupBy(block, "asked").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "name")).alias("b")).select(block, "asked", "b.name", (-F.col("b.s")).alias("similarity"))
    return exact.unionByName(best)


def resolve_aliases(alias: DataFrame) -> DataFrame:
    """(old, new): alias chains followed to their ends; names of a cycle, and those that lead into it, end at its smallest member.

    A name has one alias (of several the smallest counts), so the names that chains connect have one end in common: the
    name that has no alias itself, or a cycle. Components find the first kind at once. For the rest, 2^k steps, by
    doubling, with 2^k no less than their number, lead every name onto the cycle and reach all of it.

    Cases: null names and names that stand for themselves have no row; nor has the end of a chain or the name a cycle ends at.
    """
    with short_shuffles(alias.sparkSession):
        steps = stage_table(alias.where("old is not null and new is not null").groupBy("old").agg(F.min("new").alias("new")).where("old <> new"), "alias")
        placed = stage_table(components(steps, "old", "new"), "alias-components")
        ends = steps.select("new").distinct().join(steps.select(F.col("old").alias("new")), "new", "left_anti")
        ended = stage_table(placed.join(ends, placed["node"] == ends["new"]).select("component", "new"), "alias-ends")
        olds = steps.select(F.col("old").alias("node")).join(placed, "node")
        found = olds.join(ended, "component").select(F.col("node").alias("old"), "new")
        to = stage_table(olds.join(ended, "component", "left_anti").select(F.col("node").alias("old"), "component").join(steps, "old"), "alias-cycles")
        n = to.count()
        for _ in range(n.bit_length()):
            ahead = to.select(F.col("old").alias("_o"), F.col("new").alias("_n"))
            further = stage_table(to.join(ahead, to["new"] == ahead["_o"]).select("old", "component", F.col("_n").alias("new")), "alias-cycles")
            free(to)
            to = further
    low = to.groupBy("component").agg(F.min("new").alias("low"))
    round_ = to.join(low, "component").where("old <> low").select("old", F.col("low").alias("new"))
    return found.unionByName(round_)


def rewrite_relations(relations: DataFrame, entity_of: DataFrame) -> DataFrame:
    """relations with ends looked up in entity_of (name, entity); those with an unknown end are dropped."""
    for end in ("src", "dst"):
        relations = relations.join(entity_of.select(F.col("name").alias(end), F.col("entity").alias("_e")), end).withColumn(end, F.col("_e")).drop("_e")
    return relations.where("src <> dst")


def candidates(similar: DataFrame, far: float = 0.2, least: float = 0.5, g: float = 0.6) -> DataFrame:
    """Of (entity, other, distance, score): candidates of entities whose nearest lies within `far` and whose best score
    reaches `least`, cut where scores fall below g times the one before."""
    from sylva.operators.rank import gradient_cut

    each = Window.partitionBy("entity")
    kept = similar.withColumn("_near", F.min("distance").over(each)).withColumn("_best", F.max("score").over(each)).where((F.col("_near") <= far) & (F.col("_best") >= least)).drop("_near", "_best")
    return gradient_cut(kept, "entity", "score", "other", g)


def resolve(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """(entity, canonical): components of accepted pairs (entity, other); the smallest member stands for all.

    The order in which entities came does not matter; an entity in no pair stands for itself.
    """
    placed = components(pairs, "entity", "other").select(F.col("node").alias("entity"), "component")
    return entities.select("entity").join(placed, "entity", "left").select("entity", F.coalesce("component", "entity").alias("canonical"))
