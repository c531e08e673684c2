"""Exact top-k by cosine: queries, in blocks, against all vectors, each task keeping k per query."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.stages import short_shuffles, stage_table

#: Queries of one pass, and cells of the matrix of similarities that a worker holds at a time.
BLOCK = 8192
CELLS = 4_000_000


def _unit(column) -> np.ndarray:
    x = np.array(column.tolist(), dtype=np.float64).reshape(len(column), -1)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


def batch_search(vectors: DataFrame, queries: DataFrame, k: int, vector_id: str = "vec_id", embedding: str = "embedding", with_self: bool = True, block: int = BLOCK) -> DataFrame:
    """(query_id, id, similarity, rank) from vectors and queries (query_id, v): the k nearest of each query, ties by id.

    The queries go to the workers in blocks of `block`, one pass over the vectors for each; a worker keeps k candidates for
    each query of a block, so what is shuffled is k x queries x tasks rows whatever the number of vectors.
    """
    session = vectors.sparkSession
    n = queries.count()
    if n > block:
        parts = -(-n // block)
        dealt = stage_table(queries.select("query_id", "v").withColumn("_part", F.pmod(F.xxhash64("query_id"), F.lit(parts))), "queries")
        found = [batch_search(vectors, dealt.where(F.col("_part") == i), k, vector_id, embedding, with_self, 4 * block) for i in range(parts)]
        return reduce(DataFrame.unionByName, found)
    stated = queries.select("query_id", "v").toPandas()  # at most `block` rows, or four times as many where hashes fall unevenly
    shape = "query_id long, id long, similarity double"
    if stated.empty:
        return session.createDataFrame([], f"{shape}, rank int")
    ids, matrix = stated["query_id"].to_numpy(), session.sparkContext.broadcast(_unit(stated["v"]))

    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        step = max(1, CELLS // len(ids))
        for whole in frames:
            for at in range(0, len(whole), step):
                frame = whole.iloc[at : at + step]
                sims = np.round(matrix.value @ _unit(frame["v"]).T, 6)
                own = frame["id"].to_numpy()
                if not with_self:
                    sims[ids[:, None] == own[None, :]] = -np.inf
                many = np.broadcast_to(own, sims.shape)
                if best is not None:
                    sims, many = np.hstack([best[0], sims]), np.hstack([best[1], many])
                order = np.lexsort((many, -sims), axis=1)[:, :k]
                best = np.take_along_axis(sims, order, 1), np.take_along_axis(many, order, 1)
        if best is not None:
            sims, many = best
            out = pd.DataFrame({"query_id": np.repeat(ids, sims.shape[1]), "id": many.ravel(), "similarity": sims.ravel()})
            yield out[np.isfinite(out["similarity"])]

    found = vectors.select(F.col(vector_id).alias("id"), F.col(embedding).alias("v")).where("v is not null").mapInPandas(nearest, shape)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def pair_similarity(vectors: DataFrame, pairs: DataFrame, vector_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """pairs (src, dst) with their similarity (cosine, six places), by two equi-joins."""
    from sylva.functions.vectors import cosine

    side = lambda name, v: vectors.select(F.col(vector_id).alias(name), F.col(embedding).alias(v))
    return pairs.join(side("src", "_a"), "src").join(side("dst", "_b"), "dst").select("src", "dst", F.round(cosine(F.col("_a"), F.col("_b")), 6).alias("similarity"))


#: Vectors of one side of a tile, and rows and columns of its matrix that a worker holds at a time.
SIDE = 32_768
ROWS, COLUMNS = 512, 8192


def _tiles(vectors: DataFrame, work: Callable, shape: str, vector_id: str, embedding: str, side: int, extra: str | None = None) -> DataFrame:
    """work(same, ids, units, extras, ids, units, extras) of all pairs of blocks of vectors, each pair once, as a task's tile.

    A vector travels, packed, once for each block; work yields dicts of arrays. extra: a column of whole numbers that goes with it.
    """
    import pyarrow as pa

    held = vectors.where(F.col(embedding).isNotNull()).select(F.col(vector_id).cast("long").alias("id"), F.col(embedding).alias("v"), (F.col(extra) if extra else F.lit(0)).cast("long").alias("x"))
    n = held.count()
    blocks = max(1, -(-n // side), min(6, -(-n // 512)))

    def pack(batches):
        for x in batches:
            ids, extras, units = x.column(0).to_numpy(), x.column(2).to_numpy(), _unit(x.column(1).to_pandas())
            of = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % blocks
            some = np.unique(of)
            yield pa.RecordBatch.from_pydict({"block": some.astype(np.int32), **{name: pa.array([y[of == k].tobytes() for k in some], pa.binary()) for name, y in (("ids", ids), ("units", units), ("x", extras))}})

    packed = stage_table(held.mapInArrow(pack, "block int, ids binary, units binary, x binary"), "vector-blocks")
    dealt = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    dealt = dealt.withColumn("tile", (high * (high + 1) / 2 + low).cast("int")).withColumn("same", F.col("block") == F.col("other")).withColumn("first", F.col("block") == low)
    parts = min(blocks * (blocks + 1) // 2, 4096)
    dealt = dealt.repartitionById(parts, F.col("tile") % parts)
    if parts == 4096:
        dealt = dealt.sortWithinPartitions("tile")

    def run(batches):
        at, sides = None, ([], [])

        def tile():
            both = []
            for rows in sides:
                ids, xs = (np.frombuffer(b"".join(r[k] for r in rows), np.int64) for k in ("ids", "x"))
                both += [ids, np.frombuffer(b"".join(r["units"] for r in rows)).reshape(len(ids), -1 if len(ids) else 0), xs]
            if len(both[0]) and (same or len(both[3])):
                for out in work(same, *both[:3], *(both[:3] if same else both[3:])):
                    yield pa.RecordBatch.from_pydict(out)

        same = False
        for x in batches:
            for r in x.to_pylist():
                if r["tile"] != at and at is not None:
                    yield from tile()
                    sides = ([], [])
                at, same = r["tile"], r["same"]
                sides[0 if r["first"] else 1].append(r)
        if at is not None:
            yield from tile()

    with short_shuffles(vectors.sparkSession):
        return stage_table(dealt.select("tile", "same", "first", "ids", "units", "x").mapInArrow(run, shape), "tiles", batch=64)


def _pieces(a: np.ndarray, b: np.ndarray):
    """The matrix of similarities, six places, in pieces: rows, columns, values."""
    for i in range(0, len(a), ROWS):
        for j in range(0, len(b), COLUMNS):
            yield slice(i, i + ROWS), slice(j, j + COLUMNS), np.round(a[i : i + ROWS] @ b[j : j + COLUMNS].T, 6)


def pairs_above(vectors: DataFrame, cut: float, vector_id: str = "vec_id", embedding: str = "embedding", tile: int = SIDE) -> DataFrame:
    """(src, dst, similarity), src < dst: all pairs of vectors more similar than cut.

    Every pair is looked at: the vectors are dealt to blocks, and each pair of blocks is a task's tile of `tile` by `tile`.
    A tile's pairs are handed on piece by piece, so a worker holds few of them; that there may be many is in the nature of the job.
    """

    def work(same, ids, a, _x, others, b, _y):
        for i, j, sims in _pieces(a, b):
            x, y = np.nonzero((sims > cut) & (ids[i, None] < others[None, j] if same else ids[i, None] != others[None, j]))
            src, dst = ids[i][x], others[j][y]
            yield {"src": np.minimum(src, dst), "dst": np.maximum(src, dst), "similarity": sims[x, y]}

    return _tiles(vectors, work, "src long, dst long, similarity double", vector_id, embedding, tile)


def sums_above(vectors: DataFrame, cut: float, vector_id: str = "vec_id", embedding: str = "embedding", tile: int = SIDE) -> DataFrame:
    """(node, s, n): of each vector the sum of (similarity + 1) / 2 over the pairs of pairs_above() that it is dst of, and their number."""

    def work(same, ids, a, _x, others, b, _y):
        sums = [(np.zeros(len(k)), np.zeros(len(k), np.int64)) for k in (ids, others)]
        for i, j, sims in _pieces(a, b):
            up = ids[i, None] < others[None, j]
            for side, at, axis, some in ((1, j, 0, up), (0, i, 1, ~up)):
                if side or not same:
                    near = (sims > cut) & some
                    sums[side][0][at] += ((sims + 1) / 2 * near).sum(axis)
                    sums[side][1][at] += near.sum(axis)
        for k, (s, n) in zip((ids, others), sums):
            yield {"node": k[n > 0], "s": s[n > 0], "n": n[n > 0]}

    found = _tiles(vectors, work, "node long, s double, n long", vector_id, embedding, tile)
    return found.groupBy("node").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def nearest_above(vectors: DataFrame, cut: float, most: str, vector_id: str = "vec_id", embedding: str = "embedding", tile: int = SIDE) -> DataFrame:
    """(a, b, similarity): of the pairs of pairs_above(), each from either end, the best of each tile: as many for a as the column `most` says, ties by b."""

    class Kept:
        def __init__(self, ids, k):
            self.ids, self.k, self.least = ids, k, np.full(len(ids), np.nextafter(cut, np.inf))
            self.held: dict[int, tuple] = {}

        def add(self, i: slice, others: np.ndarray, sims: np.ndarray) -> None:
            x, y = np.nonzero((sims >= self.least[i, None]) & (self.ids[i, None] != others[None, :]))
            x, b, s = x + i.start, others[y], sims[x, y]
            if i.start in self.held:
                x, b, s = (np.concatenate(z) for z in zip(self.held[i.start], (x, b, s)))
            order = np.lexsort((b, -s, x))
            x, b, s = x[order], b[order], s[order]
            place = np.arange(len(x)) - np.searchsorted(x, x)
            full = place == self.k[x] - 1
            self.least[x[full]] = s[full]
            keep = place < self.k[x]
            self.held[i.start] = x[keep], b[keep], s[keep]

        def rows(self):
            for x, b, s in self.held.values():
                yield {"a": self.ids[x], "b": b, "similarity": s}

    def work(same, ids, a, k, others, b, m):
        for own, u, much, them, v in ((ids, a, k, others, b), *(() if same else ((others, b, m, ids, a),))):
            kept = Kept(own, much)
            for i, j, sims in _pieces(u, v):
                kept.add(i, them[j], sims)
            yield from kept.rows()

    return _tiles(vectors, work, "a long, b long, similarity double", vector_id, embedding, tile, most)


def add(collection: DataFrame, rows: DataFrame) -> DataFrame:
    return collection.unionByName(rows)


def delete(collection: DataFrame, gone: DataFrame, on: str | list[str]) -> DataFrame:
    """collection without the rows whose keys (an id or metadata columns) are in gone."""
    return collection.join(gone, on, "left_anti")


def centroids(vectors: DataFrame, label: str, embedding: str) -> DataFrame:
    """(label, v): the mean vector of each label, summed position by position."""
    at = vectors.select(label, F.posexplode(embedding).alias("pos", "x"))
    means = at.groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v"))
