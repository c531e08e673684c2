"""Hierarchical residual packing of token sequences.

Documents become token ids and one closing id each; only documents longer than a sequence are cut. Pieces that fill a
sequence are done. The others are packed in groups of bounded size by best fit in order of falling length. Nearly full
bins are emitted; underfull bins become items, the groups of FAN neighbours merge, and best fit runs over the bins
again, up a tree, to one group where the underfull bins are at most GROUP_ITEMS; where there are more, to as many groups
as hold them. So no task's items grow with the corpus, every underfull bin goes up, and no piece is dropped.

Ids of a white-space-delimited chunk do not depend on its neighbours with the given tokenizers (normalisation,
pre-tokenisation and merges stop at white space), so workers keep chunk -> ids in a bounded dictionary.

Cases: a null or blank text is its closing id alone; equal rows are packed each on its own; an empty table gives an empty
result; huge texts are tokenised in segments; extra columns are not carried.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm._bytes import segments, utf8
from sylva.llm._common import stage_table

WIDTH = 2048
CLOSING_ID = 0
GROUP_ITEMS = 32768
FAN = 8
#: A bin with no more room than this is nearly full.
SLACK = 8
#: Chunks of which a worker remembers the ids.
REMEMBERED = 600_000

MARK = "\x01"

_loaded: dict = {}
#: A full stop or comma behind a plain letter or digit, at the end of a chunk, is a token of its own in any case: parted
#: from its word it need not be learnt with it.
_STOP = re.compile(rb"(?<=[A-Za-z0-9])([.,])(?=[ \n])")

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class _Chunks:
    """A tokenizer with the ids of the chunks met of late, in two generations of at most REMEMBERED chunks."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        # A control character that is a token of its own tells chunks apart when many are encoded in one call.
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark_id = mark[0] if len(mark) == 1 else None
        self.lowers = self.tokenizer.encode("ABC", add_special_tokens=False).ids == self.tokenizer.encode("abc", add_special_tokens=False).ids

    def learn(self, chunks: set[bytes]) -> None:
        if len(self.known) + len(chunks) > REMEMBERED:
            self.old, self.known = self.known, {}
        new = []
        for c in chunks:
            if c not in self.known:
                if (ids := self.old.get(c)) is not None:
                    self.known[c] = ids
                else:
                    new.append(c)
        plain = [c for c in new if b"<|" not in c and MARK.encode() not in c] if self.mark_id is not None else []
        for i in range(0, len(plain), 4096):
            part = plain[i : i + 4096]
            text = f" {MARK} ".join([c.decode() for c in part])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = [*np.flatnonzero(ids == self.mark_id).tolist(), len(ids)]
            raw = ids.tobytes()
            if len(ends) != len(part):
                raise RuntimeError("the tokenizer lost a mark")
            at = 0
            for c, end in zip(part, ends, strict=True):
                self.known[c] = raw[4 * at : 4 * end]
                at = end + 1
        for c in new:
            if c not in self.known:
                self.known[c] = np.array(self.tokenizer.encode(c.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids(self, data: bytes) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers.

        The tokenizer lower-cases, so lower-casing first makes fewer chunks; not where it might change what a capital
        composes with, or turn other text into a special token.
        """
        if b"<|" not in data and b"\xcc" not in data and self.lowers:
            data = data.lower()
        out = []
        for part in segments(data):
            chunks = _STOP.sub(rb" \1", part).split()
            try:
                out.append(b"".join(map(self.known.__getitem__, chunks)))
            except KeyError:
                self.learn(set(chunks))
                out.append(b"".join(map(self.known.__getitem__, chunks)))
        return out[0] if len(out) == 1 else b"".join(out)


def _chunks_of(path: str) -> _Chunks:
    """The worker's own, kept between tasks. (A function nested in another travels with copies of the globals it names.)"""
    if path not in _loaded:
        _loaded[path] = _Chunks(path)
    return _loaded[path]


def pieces(docs: DataFrame, tokenizer_path: str, width: int = WIDTH, closing_id: int = CLOSING_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids, cut where they exceed width."""
    end = np.array([closing_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _chunks_of(tokenizer_path)
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for doc_id, data in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                ids = chunks.ids(data) + end
                for n, at in enumerate(range(0, len(ids), 4 * width)):
                    part = ids[at : at + 4 * width]
                    for c, v in zip(columns, (doc_id, n, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def best_fit(lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit in order of falling length: the bin and the offset of each item, and the fill of each bin.

    Bins are kept by the room they have left; a bit mask over rooms finds the least room that is enough.
    """
    bins, offsets, fill = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(width + 1)]
    mask = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if rest := mask >> n:
            room = n + (rest & -rest).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask &= ~(1 << room)
        else:
            room, b = width, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        by_room[room - n].append(b)
        mask |= 1 << (room - n)
    return bins, offsets, np.array(fill, np.int64)


def _round(items: pd.DataFrame, level: int, width: int, slack: int) -> pd.DataFrame:
    """items (with group and length) with bin, offset, fill and whether the bin goes on to the next round."""
    order = items.sort_values([c for c in ("doc_id", "piece", "start", "ids_crc32", "item") if c in items], kind="stable").reset_index(drop=True)
    bins, offsets, fill = best_fit(order["length"].to_numpy(np.int64), width)
    on = fill < width - slack
    base = (level << 56) | (int(order["group"].iloc[0]) << 24)
    return order.assign(bin=base + bins, offset=offsets, fill=fill[bins], on=on[bins])


def _at_level(level: int, width: int, slack: int):
    return lambda group: _round(group, level, width, slack)


def pack(items: DataFrame, width: int = WIDTH, slack: int = SLACK, group_items: int = GROUP_ITEMS, fan: int = FAN) -> DataFrame:
    """items (PIECES) with sequence_id and offset. Bins take items of group_items rows at a time at first."""
    whole = items.where(F.col("length") >= width).withColumn("sequence_id", (F.lit(1 << 62) + F.monotonically_increasing_id())).withColumn("offset", F.lit(0).cast("long"))
    rest = items.where(F.col("length") < width)
    groups = max(1, -(-rest.count() // group_items))
    if groups >= 1 << 31:
        raise ValueError("too many groups: raise group_items")
    first = stage_table(
        rest.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
        .groupBy("group")
        .applyInPandas(_at_level(0, width, slack), f"{PIECES}, group long, bin long, offset long, fill long, on boolean"),
        "pack-0",
    )
    # Where each bin of the first round has come to: only bins that went on have a row.
    moved = None
    up = first.where("on and offset = 0").select("bin", "fill", "group")
    level = 0
    while groups > 1:
        level += 1
        fewer = max(-(-groups // fan), -(-up.count() // group_items))
        if fewer >= groups:
            break
        bins = (
            up.select(F.col("bin").alias("item"), F.col("fill").alias("length"), F.expr(f"group * {fewer} div {groups}").alias("group"))
            .groupBy("group")
            .applyInPandas(_at_level(level, width, slack), "item long, length long, group long, bin long, offset long, fill long, on boolean")
        )
        bins = stage_table(bins, f"pack-{level}")
        to = bins.select(F.col("item"), F.col("bin").alias("to"), F.col("offset").alias("by"))
        if moved is None:
            moved = to
        else:
            later = to.select(F.col("item").alias("_item"), F.col("to").alias("_to"), F.col("by").alias("_by"))
            moved = moved.join(later, moved["to"] == later["_item"], "left").select("item", F.coalesce("_to", "to").alias("to"), (F.col("by") + F.coalesce("_by", F.lit(0))).alias("by"))
            moved = stage_table(moved, f"pack-moved-{level}")
        up = bins.where("on and offset = 0").select("bin", "fill", "group")
        groups = fewer
    if moved is not None:
        first = first.join(moved, first["bin"] == moved["item"], "left").withColumn("bin", F.coalesce("to", "bin")).withColumn("offset", F.col("offset") + F.coalesce("by", F.lit(0)))
    names = [c.split()[0] for c in PIECES.split(", ")]
    return first.withColumnRenamed("bin", "sequence_id").select(*names, "sequence_id", "offset").unionByName(whole.select(*names, "sequence_id", "offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, width: int = WIDTH) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return pack(stage_table(pieces(docs, tokenizer_path, width), "pieces"), width)
