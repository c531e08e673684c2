"""Sharding by fixed virtual slots.

Records hash into a fixed number of virtual slots, which never changes while a corpus lives. Bytes are summed per slot,
and a small versioned table maps slots to shards. Rebalancing edits that table: slots move from full shards to empty
ones, the other slots stay, and a new version is appended. Records are never hashed anew.

The map and the slot loads have n_slots rows whatever the size of the corpus; only they reach the driver or are
broadcast. A slot is the unit of movement, so a single record repeated for a large share of all bytes stays together.

Cases: null text counts no bytes and has CRC 0; equal rows share a slot; a null key is hashed with its text like any
other; an empty table gives an empty result and an even map; extra columns of docs are not carried.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylva.llm._common import stage_path, stage_table

N_SLOTS = 16384
#: Bytes that a record takes besides its text.
OVERHEAD = 16


def virtual_slots(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot: what sharding needs of a record, without its text."""
    if not 1 <= n_slots <= 65536:
        raise ValueError("n_slots must lie between 1 and 65536: the slot map is broadcast")
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    ).withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(n_slots)).cast("int"))


def slot_loads(records: DataFrame) -> DataFrame:
    """virtual_slot, bytes, rows: at most one row for each slot."""
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def initial_map(n_slots: int, n_shards: int) -> list[int]:
    """Version 0: slots dealt round to the shards."""
    return [slot % n_shards for slot in range(n_slots)]


def rebalance(shard_of: Sequence[int], loads: Sequence[int], n_shards: int) -> list[int]:
    """The next version of the map: shard_of with as few moves as bring the shards' loads near each other.

    Time and again the fullest shard gives the emptiest the slot whose load is nearest half their difference, as long
    as that narrows it. n_shards may exceed or fall below the number in use; slots of dropped shards move first.
    """
    new = list(shard_of)
    total = [0] * n_shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(n_shards)]
    homeless = []
    for slot, shard in enumerate(new):
        if shard < n_shards:
            total[shard] += loads[slot]
            held[shard].append((loads[slot], slot))
        else:
            homeless.append((loads[slot], slot))
    for own in held:
        own.sort()
    for load, slot in sorted(homeless, reverse=True):
        to = min(range(n_shards), key=lambda s: (total[s], s))
        new[slot] = to
        total[to] += load
        insort(held[to], (load, slot))
    for _ in range(4 * len(new)):
        full = max(range(n_shards), key=lambda s: (total[s], -s))
        low = min(range(n_shards), key=lambda s: (total[s], s))
        gap = total[full] - total[low]
        own = held[full]
        at = bisect_right(own, (gap // 2, len(new)))
        best = min((i for i in (at - 1, at) if 0 <= i < len(own) and 0 < own[i][0] < gap), key=lambda i: abs(2 * own[i][0] - gap), default=None)
        if best is None:
            break
        load, slot = own.pop(best)
        new[slot] = low
        total[full] -= load
        total[low] += load
        insort(held[low], (load, slot))
    return new


MAP = "version int, virtual_slot int, shard int"


def stored_map(spark: SparkSession, path: str) -> tuple[int, list[int]] | None:
    """The newest version of the slot map in a folder and its number, or None where there is none yet."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    table = spark.read.schema(MAP).parquet(path)
    version = table.agg(F.max("version")).first()[0]
    if version is None:
        return None
    rows = table.where(F.col("version") == version).orderBy("virtual_slot").collect()  # a row for each slot
    return version, [r.shard for r in rows]


def store_map(spark: SparkSession, path: str, version: int, shard_of: Sequence[int]) -> None:
    """Append a version of the slot map; earlier ones stay as they are."""
    rows = [(version, slot, shard) for slot, shard in enumerate(shard_of)]
    spark.createDataFrame(rows, MAP).coalesce(1).write.mode("append").parquet(path)


def edited_map(spark: SparkSession, path: str, loads: Sequence[int], n_shards: int) -> tuple[int, list[int]]:
    """The newest stored map rebalanced for loads, stored as the next version if that moves a slot; its number and shards."""
    stored = stored_map(spark, path)
    if stored is None:
        store_map(spark, path, 0, initial_map(len(loads), n_shards))
        stored = 0, initial_map(len(loads), n_shards)
    version, old = stored
    if len(old) != len(loads):
        raise ValueError(f"the stored map has {len(old)} slots, not {len(loads)}")
    new = rebalance(old, loads, n_shards)
    if new != old:
        version += 1
        store_map(spark, path, version, new)
    return version, new


def shard(docs: DataFrame, n_shards: int, n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """One row for each record: doc_id, size, text_crc32, shard, slot (its place in the shard), virtual_slot, map_version.

    Shards end up with nearly equal bytes. map_path: the folder of the versioned slot map, which the call edits and adds
    to; by default one of its own in the shared folder, which begins with slots dealt round. Places are gapless from 0 in
    each shard: the driver knows how many rows precede a virtual slot, and rows are numbered within their virtual slot,
    so no task sees a whole shard. Equal texts of different records lie in slots of their own, equal rows in one slot.
    """
    spark = docs.sparkSession
    records = stage_table(virtual_slots(docs, n_slots), "records")
    loads, rows = [0] * n_slots, [0] * n_slots
    for r in slot_loads(records).collect():  # n_slots rows at most
        loads[r.virtual_slot], rows[r.virtual_slot] = r.bytes, r.rows
    version, latest = edited_map(spark, map_path or stage_path(spark, "slot-map"), loads, n_shards)
    before, filled = [], [0] * n_shards
    for slot, s in enumerate(latest):
        before.append((slot, s, version, filled[s]))
        filled[s] += rows[slot]
    placed = spark.createDataFrame(before, "virtual_slot int, shard int, version int, start long")
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        records.withColumn("_n", F.row_number().over(order))
        .join(F.broadcast(placed), "virtual_slot")
        .select(
            "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("_n") - 1).alias("slot"),
            "virtual_slot", F.col("version").alias("map_version"),
        )
    )
