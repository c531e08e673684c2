"""Near duplicates among vectors by sorted projection passes.

Equal vectors collapse to one representative first, with their number. Each pass draws BITS random hyperplanes per
dimension of the vectors; the signs, concatenated, are a key, and vectors are ordered by it across the cluster. Within a
range of that order every vector is compared with the WINDOW that follow it; pairs whose cosine in double precision
reaches the threshold are kept, reduced to a spanning forest before they leave the task, and united across passes.

Vectors that share the first prefix_bits() bits of a key are a run, and every pair of a run is compared, whatever the
density: windows reach all of a run of up to WINDOW, and crowded runs are compared in tiles, but for pairs that the
windows have connected. The number of passes follows from the bits, so that a pair at the threshold shares no run in
any pass with probability MISS at most, on any data; closer pairs are missed far less often.

Windows find which vectors belong together, not how many: in a large group of near copies most pairs are never within a
window. So links are counted afterwards within each component, all against all, in tiles of TILE x TILE vectors, and
components are recomputed from these links' forests, which are the same. No pair is dropped for want of room.

Cases: vectors that are null, empty, zero or hold null or non-finite numbers link with nothing and are their own
components; vectors of different lengths are not compared; equal rows are each a vector; a null vec_id has a null
component; an empty table gives an empty result; extra columns are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.llm._common import components, stage_table

THRESHOLD = 0.95
BITS = 62
WINDOW = 64
MISS = 0.002
TILE = 1024
ROWS_A_RANGE = 20_000
SEED = 11


def prefix_bits(n: int, window: int = WINDOW) -> int:
    """Leading bits of a key that make a run: about window / 2 of n vectors share them if no place is dense."""
    return min(BITS, math.ceil(math.log2(max(2.0, 2 * n / window))))


def passes_needed(n: int, threshold: float = THRESHOLD, window: int = WINDOW, miss: float = MISS) -> int:
    """Passes after which a pair at the threshold has been in one run with probability 1 - miss.

    Two vectors agree in a bit of a random hyperplane with probability 1 - angle / pi, wherever they lie.
    """
    agree = 1 - math.acos(threshold) / math.pi
    near = agree ** prefix_bits(n, window)
    return max(2, math.ceil(math.log(miss) / math.log1p(-min(near, 0.999))))


def _planes(dim: int, number: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, number, dim]).standard_normal((dim, BITS))


def _matrix(column) -> np.ndarray:
    """Unit rows in double precision from a column of equally long lists."""
    x = np.array(list(column), dtype=np.float64)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """v (finite, not zero), rep (smallest vec_id with it) and copies."""
    x = F.col("v")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    good = x.isNotNull() & (F.size(x) > 0) & finite & F.exists(x, lambda e: e != 0)
    # -0.0 and 0.0 are one number
    return (
        vectors.select(F.col(vec_id).alias("id"), F.col(embedding).alias("v"))
        .where(good)
        .select("id", F.transform("v", lambda e: e.cast("double") + 0.0).alias("v"))
    )


def _keys(frame: pd.DataFrame, number: int, seed: int):
    """Of each length and pass: dim, pass, keys, and the rows they belong to."""
    weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    for dim, part in frame.groupby(frame["v"].map(len)):
        x = _matrix(part["v"])
        for p in range(number):
            yield dim, p, ((x @ _planes(dim, p, seed)) > 0) @ weights, part


def _keyed(number: int, bits: int, seed: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, p, keys, part in _keys(frame, number, seed):
                yield pd.DataFrame({"pass": p, "dim": dim, "run": keys >> (BITS - bits), "key": keys, "rep": part["rep"].to_numpy(), "v": part["v"].to_numpy()})

    return run


def _run_sizes(number: int, bits: int, seed: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, p, keys, _ in _keys(frame, number, seed):
                runs, n = np.unique(keys >> (BITS - bits), return_counts=True)
                yield pd.DataFrame({"pass": p, "dim": dim, "run": runs, "n": n})

    return run


class _Forest:
    """Union and find over local numbers; union tells whether a pair was new."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _windows(threshold: float, window: int):
    """Forest links among neighbours, from sorted batches; the last `window` rows carry over between batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            new = 0 if held is None else len(held)
            for _, part in frame.groupby(["pass", "dim"], sort=False):
                x, ids = _matrix(part["v"]), part["rep"].to_numpy()
                fresh = part.index.to_numpy() >= new
                forest = _Forest(len(x))
                a, b = [], []
                for step in range(1, min(window, len(x) - 1) + 1):
                    near = np.einsum("ij,ij->i", x[:-step], x[step:]) >= threshold
                    for i in np.flatnonzero(near & fresh[step:]).tolist():
                        if forest.union(i, i + step):
                            a.append(ids[i])
                            b.append(ids[i + step])
                if a:
                    yield pd.DataFrame({"a": a, "b": b})
            held = frame.tail(window).reset_index(drop=True)

    return run


RUN = ["pass", "dim", "run"]


def keyed(reps: DataFrame, n: int, threshold: float = THRESHOLD, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Each of reps (rep, v), in each pass: pass, dim, run, key, rep, v."""
    return reps.mapInPandas(_keyed(passes_needed(n, threshold, window), prefix_bits(n, window), seed), "pass int, dim int, run long, key long, rep long, v array<double>")


def crowded_runs(reps: DataFrame, n: int, threshold: float = THRESHOLD, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """pass, dim, run: the runs that a window does not span."""
    sizes = reps.mapInPandas(_run_sizes(passes_needed(n, threshold, window), prefix_bits(n, window), seed), "pass int, dim int, run long, n long")
    return sizes.groupBy(*RUN).agg(F.sum("n").alias("n")).where(F.col("n") > window).select(*RUN)


def window_links(rows: DataFrame, crowded: DataFrame, ranges: int, threshold: float = THRESHOLD, window: int = WINDOW) -> DataFrame:
    """(a, b): verified links found by the windows over rows of keyed(), enough to connect what the windows connect.

    Only crowded runs are cut between ranges.
    """
    marked = rows.join(crowded.withColumn("cut", F.lit(True)), RUN, "left")
    return (
        marked.withColumn("at", F.when(F.col("cut"), F.col("key"))).withColumn("by", F.when(F.col("cut"), F.col("rep")))
        .repartitionByRange(ranges, *RUN, "at", "by")
        .sortWithinPartitions("pass", "dim", "key", "rep")
        .select("pass", "dim", "rep", "v")
        .mapInPandas(_windows(threshold, window), "a long, b long")
    )


def _stars(near: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each component of a matrix of links: its first row, its rows, its columns."""
    open_rows = near.any(1)
    while open_rows.any():
        first = int(np.argmax(open_rows))
        new = np.array([first])
        rows, cols = [], np.zeros(near.shape[1], bool)
        while len(new):
            rows.append(new)
            open_rows[new] = False
            more = near[new].any(0) & ~cols
            cols |= more
            new = np.flatnonzero(open_rows & near[:, more].any(1))
        yield first, np.concatenate(rows), np.flatnonzero(cols)


def _tile_links(threshold: float):
    """A forest of the links of a tile."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        i, j = int(group["i"].iloc[0]), int(group["j"].iloc[0])
        x, ids, block = _matrix(group["v"]), group["rep"].to_numpy(), group["block"].to_numpy()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        near = (x[left] @ x[right].T) >= threshold
        if i == j:
            np.fill_diagonal(near, False)
        found = [(ids[left[first]], np.unique(np.concatenate((ids[left[rows]], ids[right[cols]])))) for first, rows, cols in _stars(near)]
        out = pd.DataFrame({"a": np.concatenate([np.full(len(m), c) for c, m in found] or [ids[:0]]), "b": np.concatenate([m for _, m in found] or [ids[:0]])})
        return out[out["a"] != out["b"]]

    return run


def run_links(rows: DataFrame, crowded: DataFrame, grouped: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(a, b): links within crowded runs of keyed() that connect components of grouped (rep, component), in tiles.

    In a run, each component of `tile` members or more has blocks of its own, which are not compared with one another;
    the others share blocks. All other pairs of blocks are groups.
    """
    members = rows.join(crowded, RUN).join(grouped, "rep", "left").select(*RUN, "rep", "v", F.coalesce("component", "rep").alias("component"))
    sizes = members.groupBy(*RUN, "component").agg(F.count("*").alias("n")).withColumn("own", F.col("n") >= tile)
    parts = sizes.groupBy(*RUN, F.when(F.col("own"), F.col("component")).alias("part")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
    order = Window.partitionBy(*RUN).orderBy("part")
    blocks = (
        parts.withColumn("blocks", F.ceil(F.col("n") / tile).cast("int"))
        .withColumn("upto", F.sum("blocks").over(order).cast("int"))
        .withColumn("total", F.sum("blocks").over(Window.partitionBy(*RUN)).cast("int"))
        .withColumn("kinds", F.sum("kinds").over(Window.partitionBy(*RUN)))
        .where("kinds > 1")
    )
    of = sizes.withColumn("part", F.when(F.col("own"), F.col("component"))).drop("n")
    held = blocks.select(*[F.col(c).alias(f"_{c}") for c in RUN], F.col("part").alias("_part"), "blocks", "upto", "total")
    same = F.col("part").eqNullSafe(F.col("_part"))
    for c in RUN:
        same = same & (F.col(c) == F.col(f"_{c}"))
    placed = of.join(held, same).select(*RUN, "component", "own", "blocks", "upto", "total")
    dealt = members.join(placed, [*RUN, "component"])
    dealt = dealt.withColumn("block", F.col("upto") - F.col("blocks") + F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("total") - 1))).where("not own or other < upto - blocks or other >= upto")
    tiles = pairs.select(*RUN, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "v")
    return tiles.groupBy(*RUN, "i", "j").applyInPandas(_tile_links(threshold), "a long, b long")


def _tile(threshold: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        i, j = int(group["i"].iloc[0]), int(group["j"].iloc[0])
        out = np.zeros(len(group), np.int64)
        for _, part in group.reset_index(drop=True).groupby(group["v"].map(len).to_numpy()):
            at, x = part.index.to_numpy(), _matrix(part["v"])
            block, copies = part["block"].to_numpy(), part["copies"].to_numpy(np.int64)
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            for k in range(0, len(left), TILE):
                rows = left[k : k + TILE]
                near = (x[rows] @ x[right].T) >= threshold
                if i == j:
                    near[rows[:, None] == right[None, :]] = False
                    out[at[rows]] += near @ copies[right]
                else:
                    out[at[rows]] += near @ copies[right]
                    out[at[right]] += near.T @ copies[rows]
        return pd.DataFrame({"rep": group["rep"].to_numpy(), "n": out})

    return run


def link_counts(members: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(rep, n): vectors linked to each member (rep, v, copies, component), copies counted, itself not.

    A component of more than `tile` members is dealt to blocks, and every pair of blocks is a group of its own.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("members"))
    blocks = F.ceil(F.col("members") / tile).cast("int")
    dealt = members.join(sizes, "component").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = pairs.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "v", "copies")
    return tiles.groupBy("component", "i", "j").applyInPandas(_tile(threshold), "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id, kept."""
    good = stage_table(usable(vectors, vec_id, embedding), "vectors")
    reps = stage_table(good.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).where("rep is not null"), "reps")
    n = reps.count()
    rows = keyed(reps, n, threshold, window, seed)
    crowded = stage_table(crowded_runs(reps, n, threshold, window, seed), "crowded-runs")
    ranges = max(1, -(-n * passes_needed(n, threshold, window) // ROWS_A_RANGE))
    grouped = stage_table(components(window_links(rows, crowded, ranges, threshold, window)).withColumnsRenamed({"node": "rep"}), "window-components")
    if not crowded.isEmpty():
        more = run_links(rows, crowded, grouped, threshold)
        grouped = stage_table(components(grouped.select(F.col("rep").alias("a"), F.col("component").alias("b")).unionByName(more)).withColumnsRenamed({"node": "rep"}), "vector-components")
    counts = link_counts(reps.join(grouped, "rep"), threshold)
    whole = (
        reps.join(grouped, "rep", "left").join(counts, "rep", "left")
        .select("v", F.coalesce("component", "rep").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    by_id = good.join(whole, "v").select("id", "component", "n_links").groupBy("id").agg(F.min("component").alias("component"), F.max("n_links").alias("n_links"))
    return (
        vectors.select(F.col(vec_id).alias("vec_id"))
        .join(by_id, F.col("vec_id") == F.col("id"), "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").cast("long").alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
