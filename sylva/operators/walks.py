"""Walks of many queries over one graph: personalised PageRank by array work, and what it sums to in the nodes that mention entities.

The queries are dealt to groups. A task takes a group: it keeps the whole graph, packed, in an unnamed file of its worker,
and walks query by query, so its memory is a few numbers for each entity and one piece of the file, whatever the number
of links, queries and nodes. Only the packed graph travels, once to each group; ranks never leave the task, and of the nodes
only those that are asked for.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.stages import free, short_shuffles, stage_table

#: Links or mentions of one piece of a worker's file; rows of a packed table that go to a worker at a time.
PIECE = 2_000_000
PACKED_ROWS = 16
LINKS, SEEDS, ROWS = 0, 1, 2
PACKED = "grp int, kind int, a binary, b binary, c binary, d binary"
_SCHEMA = pa.schema([("grp", pa.int32()), ("kind", pa.int32()), *[(x, pa.binary()) for x in "abcd"]])


def packed_batch(rows: list[tuple]) -> pa.RecordBatch:
    """A batch of PACKED: (grp, kind, arrays a to d)."""
    columns = [pa.array([r[i] for r in rows], pa.int32()) for i in (0, 1)] + [pa.array([r[i].tobytes() for r in rows], pa.binary()) for i in range(2, 6)]
    return pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)


NONE = np.zeros(0, np.int32)


def numbered(names: DataFrame, column: str) -> tuple[DataFrame, int]:
    """(column, no) of distinct values, no running from 0 without gaps, and how many there are."""
    one = names.where(F.col(column).isNotNull()).select(column).distinct()
    placed = stage_table(one.select(column, F.spark_partition_id().alias("_k"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_i")), "numbers")
    counts = sorted((r["_k"], r["n"]) for r in placed.groupBy("_k").agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for k, n in counts:
        starts.append((k, total))
        total += n
    of = F.broadcast(placed.sparkSession.createDataFrame(starts, "_k int, _s long"))  # a row for each partition
    return placed.join(of, "_k").select(column, (F.col("_i") + F.col("_s")).cast("int").alias("no")), total


class _Spool:
    """Rows of arrays in an unnamed file of the worker, in pieces; each piece is read alone."""

    def __init__(self) -> None:
        self.file = tempfile.TemporaryFile()
        self.pieces: list[list[tuple[int, int, np.dtype]]] = []

    def add(self, *arrays: np.ndarray) -> None:
        piece = []
        for x in arrays:
            piece.append((self.file.tell(), x.nbytes, x.dtype))
            self.file.write(x.tobytes())
        self.pieces.append(piece)

    def read(self, piece: int, column: int, start: int = 0, count: int | None = None) -> np.ndarray:
        at, size, kind = self.pieces[piece][column]
        return np.frombuffer(os.pread(self.file.fileno(), size if count is None else count * kind.itemsize, at + start * kind.itemsize), kind)

    def done(self) -> None:
        self.file.flush()


def front(t: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Whether each point is on the skyline in t and g: the best g of its t, and more than any larger t has."""
    if not len(t):
        return np.zeros(0, bool)
    order = np.lexsort((-g, -t))
    ts, gs = t[order], g[order]
    first = np.r_[True, ts[1:] != ts[:-1]]
    top, of = gs[first], np.cumsum(first) - 1
    above = np.r_[-np.inf, np.maximum.accumulate(top)[:-1]]
    out = np.zeros(len(t), bool)
    out[order] = (gs == top[of]) & (above[of] < gs)
    return out


class Every:
    """Keeps all nodes."""

    def __init__(self) -> None:
        self.held: list[tuple] = []

    def add(self, ids, t, g) -> None:
        self.held.append((ids, t, g))

    def result(self):
        return tuple(np.concatenate(x) for x in zip(*self.held)) if self.held else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0))


class Best(Every):
    """Keeps the k nodes of the largest g, ties by id."""

    def __init__(self, k: int, above: float = -np.inf) -> None:
        super().__init__()
        self.k, self.above = k, above

    def add(self, ids, t, g) -> None:
        some = g > self.above
        super().add(ids[some], t[some], g[some])
        ids, t, g = super().result()
        keep = np.lexsort((ids, -g))[: self.k]
        self.held = [(ids[keep], t[keep], g[keep])]


class Skyline(Every):
    """Keeps what linking.skyline_each() keeps: the front, all of fewer than topk nodes, and the best of each score beside a front of fewer than topk."""

    def __init__(self, topk: int, best: int) -> None:
        super().__init__()
        self.topk, self.best, self.n = topk, best, 0

    def _bests(self, ids, t, g) -> np.ndarray:
        out = np.zeros(len(ids), bool)
        for score in (t, g):
            out[np.lexsort((ids, -score))[: self.best]] = True
        return out

    def add(self, ids, t, g) -> None:
        self.n += len(ids)
        super().add(ids, t, g)
        ids, t, g = super().result()
        keep = np.ones(len(ids), bool) if self.n < self.topk else front(t, g) | self._bests(ids, t, g)
        self.held = [(ids[keep], t[keep], g[keep])]

    def result(self):
        ids, t, g = super().result()
        if self.n < self.topk:
            return ids, t, g
        keep = front(t, g)
        if keep.sum() < self.topk:
            keep |= self._bests(ids, t, g)
        return ids[keep], t[keep], g[keep]


def pack_links(edges: DataFrame, numbers: DataFrame) -> DataFrame:
    """PACKED rows of the edges of weight above 0, without a group."""
    ends = numbers
    for end, no in (("src", "_a"), ("dst", "_b")):
        named = ends.select(*[F.col(c).alias(end) if c == "node" else F.col(c).alias(no) for c in ("node", "no")])
        edges = edges.join(named, end)
    return edges.where("weight > 0").select("_a", "_b", F.col("weight").cast("double").alias("_w")).mapInArrow(_pack_links, PACKED)


def _pack_links(batches):
    for x in batches:
        a, b, w = (c.to_numpy(zero_copy_only=False) for c in x.columns)
        yield packed_batch([(-1, LINKS, a.astype(np.int32), b.astype(np.int32), w.astype(np.float64), NONE)])


def _pack_seeds(batches):
    for x in batches:
        grp, q, no, p = (c.to_numpy(zero_copy_only=False) for c in x.columns)
        yield packed_batch([(int(k), SEEDS, q[grp == k].astype(np.int32), no[grp == k].astype(np.int32), p[grp == k].astype(np.float64), NONE) for k in np.unique(grp)])


def _pack_mentions(batches):
    """Nodes and the numbers of what they mention, for all groups."""
    for x in batches:
        ids, names = x.column(0).to_numpy(zero_copy_only=False).astype(np.int64), x.column(1)
        yield packed_batch([(-1, ROWS, ids, np.asarray(names.value_lengths().fill_null(0), np.int32), np.asarray(names.flatten(), np.int32), NONE)])


def _rank(p: np.ndarray, out: np.ndarray, links: _Spool, alpha: float, iterations: int) -> np.ndarray:
    rank, on = p, out > 0
    for _ in range(iterations):
        scaled = np.divide(rank, out, out=np.zeros(len(p)), where=on)
        new = np.zeros(len(p))
        for i in range(len(links.pieces)):
            a, b, w = (links.read(i, c) for c in range(3))
            new += np.bincount(b, w * scaled[a], len(p))
            new += np.bincount(a, w * scaled[b], len(p))
        rank = alpha * new + p * (1 - alpha + alpha * rank[~on].sum())
    return rank


def _walker(n: int, queries: int, groups: int, alpha: float, iterations: int, keep: Callable[[], Every] | None) -> Callable:
    """A task's work: the ranks of each query of its group (keep is None), or what keep holds of the nodes' sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, rows, seeds, out, held, size, group = _Spool(), _Spool(), {}, np.zeros(n), [], 0, -1

        def spool() -> None:
            nonlocal held, size
            if held:
                links.add(*(np.concatenate(x) for x in zip(*held)))
            held, size = [], 0

        for x in batches:
            for r in x.to_pylist():
                group = r["grp"]
                if r["kind"] == LINKS:
                    a, b, w = np.frombuffer(r["a"], np.int32), np.frombuffer(r["b"], np.int32), np.frombuffer(r["c"])
                    for end in (a, b):
                        out += np.bincount(end, w, n)
                    held.append((a, b, w))
                    size += len(a)
                    if size >= max(PIECE, n):  # a piece costs a pass over all entities
                        spool()
                elif r["kind"] == SEEDS:
                    for q, no, p in zip(np.frombuffer(r["a"], np.int32), np.frombuffer(r["b"], np.int32), np.frombuffer(r["c"])):
                        seeds.setdefault(int(q), []).append((no, p))
                else:
                    rows.add(np.frombuffer(r["a"], np.int64), np.frombuffer(r["b"], np.int32), np.frombuffer(r["c"], np.int32), np.frombuffer(r["d"]))
        spool()
        links.done(), rows.done()
        if group < 0:
            return
        for q in range((queries - group + groups - 1) // groups):
            p = np.zeros(n)
            for no, x in seeds.get(q, []):
                p[no] += x
            rank = _rank(p, out, links, alpha, iterations) if seeds.get(q) else p
            query = q * groups + group
            if keep is None:
                at = np.union1d(np.nonzero(rank)[0], np.array([no for no, _ in seeds.get(q, [])], np.int64)).astype(np.int64)
                for i in range(0, len(at), PIECE):
                    part = at[i : i + PIECE]
                    yield pa.RecordBatch.from_pydict({"q": np.full(len(part), query, np.int32), "no": part.astype(np.int32), "rank": rank[part]})
                continue
            kept = keep()
            for i in range(len(rows.pieces)):
                node, sizes, names = (rows.read(i, c) for c in range(3))
                sums = np.zeros(len(node))
                some = sizes > 0
                if some.any():
                    starts = np.r_[0, np.cumsum(sizes[some])[:-1]].astype(np.int64)
                    sums[some] = np.add.reduceat(rank[names], starts)
                t = rows.read(i, 3, q * len(node), len(node)) if rows.pieces[i][3][1] else np.zeros(len(node))
                wanted = ~np.isnan(t)
                kept.add(node[wanted], t[wanted], np.round(sums[wanted], 12))  # copies tie, whatever the order of their sums
            node, t, g = kept.result()
            for i in range(0, len(node), PIECE):
                cut = slice(i, i + PIECE)
                yield pa.RecordBatch.from_pydict({"q": np.full(len(node[cut]), query, np.int32), "node_id": node[cut], "t": t[cut], "g": g[cut]})

    return run


def group_count(df: DataFrame, queries: int) -> int:
    """Groups of queries: as many as tasks run at a time, so that the graph travels no more often."""
    return max(1, min(queries, max(8, df.sparkSession.sparkContext.defaultParallelism)))


class Walks:
    """The graph and the seeds (query_id, node, p; p summing to 1 each) of walks, numbered and packed; the queries' ids, a stated set, are held by the driver."""

    def __init__(self, edges: DataFrame, seeds: DataFrame, alpha: float, iterations: int, ids: list | None = None) -> None:
        self.session, self.alpha, self.iterations = edges.sparkSession, alpha, iterations
        with short_shuffles(self.session):
            seeds = stage_table(seeds.select("query_id", "node", "p"), "rank-seeds")
            edges = stage_table(edges.select("src", "dst", "weight"), "rank-edges")
            self.kind = seeds.schema["query_id"].dataType.simpleString()
            self.ids = sorted({r[0] for r in seeds.select("query_id").distinct().collect()}) if ids is None else ids
            self.groups = group_count(edges, len(self.ids))
            ends = edges.select(F.col("src").alias("node")).union(edges.select("dst")).union(seeds.select("node"))
            self.numbers, self.n = numbered(ends, "node")
            links = pack_links(edges, self.numbers)
            asked = self.query_numbers()
            dealt = seeds.join(F.broadcast(asked), "query_id").join(self.numbers, "node")
            packed = dealt.select((F.col("q") % self.groups).alias("grp"), F.floor(F.col("q") / self.groups).cast("int").alias("q"), "no", F.col("p").cast("double")).mapInArrow(_pack_seeds, PACKED)
            self.packed = stage_table(links.unionByName(packed), "rank-packed", batch=65_536)
            free(edges, seeds)

    def query_numbers(self) -> DataFrame:
        return self.session.createDataFrame(list(zip(self.ids, range(len(self.ids)))), f"query_id {self.kind}, q int")

    def mentioned(self, mentions: DataFrame) -> DataFrame:
        """(node_id, names): the numbers of the entities of the graph that each node mentions."""
        return mentions.join(self.numbers, "node").groupBy("node_id").agg(F.collect_list("no").alias("names"))

    def rows(self, mentions: DataFrame) -> DataFrame:
        """PACKED rows of all nodes that mention something of the graph."""
        return stage_table(self.mentioned(mentions).select("node_id", "names").mapInArrow(_pack_mentions, PACKED), "rank-mentions", batch=16_384)

    def run(self, rows: DataFrame | None, keep: Callable[[], Every] | None) -> DataFrame:
        """(query_id, node_id, t, g) of what keep holds of PACKED rows (a table), or, without rows, (query_id, node, rank)."""
        with short_shuffles(self.session):
            packed = self.packed if rows is None else self.packed.unionByName(rows)
            of = F.when(F.col("grp") < 0, F.sequence(F.lit(0), F.lit(self.groups - 1))).otherwise(F.array("grp"))
            dealt = packed.withColumn("grp", F.explode(of)).repartitionById(self.groups, F.col("grp"))
            walk = _walker(self.n, len(self.ids), self.groups, self.alpha, self.iterations, keep)
            out = stage_table(dealt.mapInArrow(walk, "q int, no int, rank double" if keep is None else "q int, node_id long, t double, g double"), "ranks", batch=PACKED_ROWS)
        out = out.join(F.broadcast(self.query_numbers()), "q")
        return out.select("query_id", "node_id", "t", "g") if keep else out.join(self.numbers, "no").select("query_id", "node", "rank")
