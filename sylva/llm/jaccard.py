"""Size-aware heavy-light join of documents on the Jaccard similarity of their word shingles.

Documents with equal sets form a class; the join works on classes. A set of n shingles that is linked to another shares
all but d = n - ceil(0.8 n) of its shingles with it, so, in any one order of all shingles, linked sets share one of their
first d + 1 and two of their first d + 2.

* Small sets (n up to a boundary) enumerate the two-element subsets of their first d + 2 shingles; small sets that
  share no subset are not linked.
* Large sets scan inverted lists: each of the first d + 2 shingles is a list, holding the large sets and the small ones
  large enough to be linked to a large one. A pair must meet in two lists, which chance meetings seldom do.
* The boundary is where the number of subsets, summed over the sizes that occur, outweighs the postings to be scanned.

Subset or shingle, a signature is a key of one equi-join. The order of shingles is by hash, but for shingles that more than
LIGHT sets lead with: they come last. All members of a signature with up to LIGHT members are paired. A longer list is
scanned from its least member alone, which is linear, and verified links give components: a group of n near
copies costs about n comparisons. Where members of a long list are not connected by then, the order is changed anew for them,
as long as that finds new frequent shingles and MAX_ORDERS times at most. What is still apart is compared all against all, in
tiles of TILE x TILE sets, first on the hashes they kept, likeliest pairs first, then on whole sets, however many there are.
A tile hands on the pairs that join components, not all that it finds. So the result is exact.

A candidate pair is checked on its sizes, on the leading shingles that both kept (their differences alone must not exceed the
difference that a linked pair may have, (n + m) / 9), and on whole sets.

Cases: null, empty and blank texts have no shingles and link with nothing; equal texts are one class; rows that share a
doc_id and differ in text are joined by their doc_id; a null doc_id counts as a document, is given its component and names none; keep_one() leaves
one row of each component, so no equal texts with words; an empty table gives an empty result; huge texts are shingled in segments; extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.llm._bytes import utf8
from sylva.llm._common import components, free, short_shuffles, small_or_shuffled, stage_table
from sylva.llm.shingles import set_keys, shingle_set

#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 80
#: What scanning a posting costs, against making one.
SCAN_COST = 2.0
LIGHT = 8
#: Leading shingles kept beyond d + 2, so that most sets can be put in another order without their texts.
SPARE = 16
MAX_ORDERS = 3
LARGEST_BOUNDARY = 60
TILE = 256
TILE_HASHES = 2_000_000
#: Rows that a join sends to every worker at most, and words put last in the order at most.
MAX_BROADCAST_ROWS = 200_000
MAX_LATE = 1_000_000
#: Rows of one class beyond which its name is sent to the workers.
CROWD = 20_000
CROWDS = 20_000


def differences(n: Column | int) -> Column | int:
    """Shingles of a set of n that may be missing in a linked one: n - ceil(0.8 n)."""
    return F.floor(n * (100 - PERCENT) / 100).cast("int") if isinstance(n, Column) else n * (100 - PERCENT) // 100


def _row_hash() -> Column:
    """What tells rows of one doc_id apart: a hash of the text."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, h, n, k, k2, head: a row's hash, the size of its set, two keys of the set, and its d + 2 + SPARE least hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k, k2, head = [], [], [], []
            for data in utf8(batch.column(2)):
                h = shingle_set(data)
                a, b = set_keys(h)
                n.append(len(h))
                k.append(a)
                k2.append(b)
                head.append(h[: differences(len(h)) + 2 + SPARE])
            at = np.cumsum([0, *map(len, head)], dtype=np.int32)
            heads = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.empty(0, np.int64), *head])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(k2, pa.int64()), heads], ["doc_id", "h", "n", "k", "k2", "head"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_hash().alias("h"), "text").mapInArrow(run, "doc_id long, h long, n long, k long, k2 long, head array<long>")


def _among(h: np.ndarray, late: np.ndarray) -> np.ndarray:
    """Which of h are in the sorted array late."""
    if not len(late):
        return np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(late, h), len(late) - 1)
    return late[at] == h


def reordered(heads: DataFrame, heavy: list[int]) -> DataFrame:
    """(k, n, head, enough) with heavy hashes last, cut to d + 2; not enough: the head would need hashes that were not kept."""
    late = np.array(sorted(heavy), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for k, n, head in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                h = head.values.to_numpy()
                last = _among(h, late)
                light, need = h[~last], differences(n) + 2
                for c, v in zip(out, (k, n, np.concatenate([light, h[last]])[:need], len(light) >= need or len(h) == n), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["k", "n", "head", "enough"])

    return heads.select("k", "n", "head").mapInArrow(run, "k long, n long, head array<long>, enough boolean")


def whole_sets(docs: DataFrame, wanted: DataFrame, heavy: list[int] | None = None) -> DataFrame:
    """(k, n, hashes) of the documents whose doc_id and second set key are in wanted (doc_id, k, k2).

    With heavy, hashes is instead the head of the set in the order in which heavy hashes come last.
    """
    late = np.array(sorted(heavy or ()), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for key, second, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
                h = shingle_set(data)
                if set_keys(h)[1] != second:
                    continue  # another row with this doc_id
                n = len(h)
                if heavy is not None:
                    last = _among(h, late)
                    h = np.concatenate([h[~last], h[last]])[: differences(n) + 2]
                for c, v in zip(out, (key, n, h), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64()))], ["k", "n", "hashes"])

    few = small_or_shuffled(wanted.select(F.col("doc_id").alias("_id"), "k", "k2"), MAX_BROADCAST_ROWS)
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(few, F.col("doc_id").eqNullSafe(F.col("_id"))).select("k", "k2", "text")
    return picked.mapInArrow(run, "k long, n long, hashes array<long>").dropDuplicates(["k"])


def choose_boundary(sizes: dict[int, int], scan_cost: float = SCAN_COST, largest: int = LARGEST_BOUNDARY) -> int:
    """The largest size of small sets, from the number of sets of each size: that of the least total cost."""

    def cost(x: int) -> float:
        subsets = sum(c * (differences(n) + 2) * (differences(n) + 1) / 2 for n, c in sizes.items() if 2 <= n <= x)
        return subsets + (1 + scan_cost) * sum(c * (differences(n) + 1) for n, c in sizes.items() if 100 * n > PERCENT * x)

    return min(range(1, largest + 1), key=lambda x: (cost(x), x))


def signatures(heads: DataFrame, boundary: int) -> DataFrame:
    """(k, sig, w) from (k, n, head): subsets of small sets (w 2) and postings of the others (w 1); a link needs 2 in all."""
    pairs = F.flatten(F.transform("head", lambda x, i: F.transform(F.slice("head", i + 2, F.greatest(F.size("head") - i - 1, F.lit(0))), lambda y: F.xxhash64(x, y))))
    none = F.array().cast("array<bigint>")
    small = F.when((F.col("n") >= 2) & (F.col("n") <= boundary), pairs).otherwise(none)
    large = F.when((F.col("n") >= 2) & (100 * F.col("n") > PERCENT * boundary), F.col("head")).otherwise(none)
    subsets = heads.where((F.col("n") >= 2) & (F.col("n") <= boundary)).select("k", F.explode(small).alias("sig"), F.lit(2).alias("w"))
    return subsets.unionByName(heads.select("k", F.explode(large).alias("sig"), F.lit(1).alias("w")))


def _compatible(n: Column, m: Column) -> Column:
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & (n > 0) & (m > 0)


def weighed(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of classes that share one subset or two postings, from (a, b, w)."""
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w")
    return pairs.groupBy("a", "b").agg(F.sum("w").alias("w")).where("w > 1").select("a", "b")


def _wanted(heads: DataFrame, keys: DataFrame) -> DataFrame:
    return heads.select("k", "k2", "rep").join(keys, "k").select(F.col("rep").alias("doc_id"), "k", "k2")


def verify(pairs: DataFrame, heads: DataFrame, docs: DataFrame) -> DataFrame:
    """The linked ones of distinct pairs (a, b) of classes, as a stage table."""
    ends = stage_table(pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct(), "jaccard-ends")
    own = stage_table(heads.join(small_or_shuffled(ends, MAX_BROADCAST_ROWS), "k", "left_semi"), "jaccard-own")
    free(ends)
    na, nb = (own.select(F.col("k").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
    sized = stage_table(pairs.join(na, "a").join(nb, "b").where(_compatible(F.col("na"), F.col("nb"))), "jaccard-sized")
    ha, hb = (own.select(F.col("k").alias(x), F.col("head").alias(f"h{x}")) for x in "ab")
    reach = F.least(F.element_at("ha", -1), F.element_at("hb", -1))
    upto = lambda h: F.filter(h, lambda x: x <= F.col("reach"))
    apart = F.size("fa") + F.size("fb") - 2 * F.size(F.array_intersect("fa", "fb"))
    likely = (
        sized.join(ha, "a").join(hb, "b")
        .withColumn("reach", reach).withColumn("fa", upto("ha")).withColumn("fb", upto("hb"))
        .where((100 + PERCENT) * apart <= (100 - PERCENT) * (F.col("na") + F.col("nb")))
        .select("a", "b")
    )
    likely = stage_table(likely, "jaccard-likely")
    free(sized)
    nodes = likely.select(F.col("a").alias("k")).union(likely.select("b")).distinct()
    sets = stage_table(whole_sets(docs, _wanted(own, nodes)), "jaccard-sets")
    sa, sb = (sets.select(F.col("k").alias(x), F.col("hashes").alias(f"s{x}")) for x in "ab")
    common = F.size(F.array_intersect("sa", "sb"))
    linked = likely.join(sa, "a").join(sb, "b").withColumn("common", common).where(100 * F.col("common") >= PERCENT * (F.size("sa") + F.size("sb") - F.col("common")))
    links = stage_table(linked.select("a", "b"), "jaccard-links")
    free(likely, sets, own)
    return links


def _lists(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stage tables of signatures with several members (sig, w, m, pivot, last), and of members (sig, k, pivot, w, m) of those with more than two."""
    lists = stage_table(
        entries.groupBy("sig", "w").agg(F.count("*").alias("m"), F.min("k").alias("pivot"), F.max("k").alias("last")).where("m > 1 and pivot <> last"), "jaccard-lists"
    )
    many = lists.where("m > 2").select("sig", "w", "pivot", "m")
    members = stage_table(entries.join(small_or_shuffled(many, MAX_BROADCAST_ROWS), ["sig", "w"]).select("sig", "k", "pivot", "w", "m"), "jaccard-members")
    return lists, members


def _stars(members: DataFrame) -> DataFrame:
    return members.where("k <> pivot").select(F.col("pivot").alias("a"), F.col("k").alias("b"), "w")


def _pairs(members: DataFrame) -> DataFrame:
    """All pairs (a, b, w) of members of a signature."""
    x = members.select("sig", "w", F.col("k").alias("a"))
    return x.join(members.select("sig", "w", F.col("k").alias("b")), ["sig", "w"]).where("a < b").select("a", "b", "w")


def _connected(links: list[DataFrame]) -> DataFrame:
    return stage_table(components(reduce(DataFrame.unionByName, links)).withColumnsRenamed({"node": "k"}), "jaccard-components")


def _unconnected(members: DataFrame, links: list[DataFrame]) -> DataFrame:
    """members with their component, of signatures whose members lie in several; links may be several tables."""
    joined = _connected(links)
    placed = stage_table(members.join(joined, "k", "left").withColumn("component", F.coalesce("component", "k")), "jaccard-placed")
    counts = placed.groupBy("sig", "w").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).where("_low <> _high").select("sig", "w")
    apart = stage_table(placed.join(counts, ["sig", "w"], "left_semi"), "jaccard-unconnected")
    free(joined, placed)
    return apart


def _in_forest(order: np.ndarray, left: np.ndarray, right: np.ndarray, linked=None) -> list[int]:
    """Of pairs, taken in order, those that join components left and right not joined by then (and are linked)."""
    up: dict[int, int] = {}

    def find(v: int) -> int:
        while (w := up.get(v, v)) != v:
            up[v] = v = up.get(w, w)
        return v

    taken = []
    for at, p, q in zip(order.tolist(), left[order].tolist(), right[order].tolist(), strict=True):
        p, q = find(p), find(q)
        if p != q and (linked is None or linked(at)):
            up[max(p, q)] = min(p, q)
            taken.append(at)
    return taken


def _tile(group: pd.DataFrame, exact: bool) -> pd.DataFrame:
    """Pairs (a, b) of two blocks of a group that join different components, at most one less than the tile has sets.

    By heads alone they are the likeliest pairs and still to be verified. If exact, hashes holds whole sets: the pairs
    are links, and join all components of the tile that links join.
    """
    i, j = int(group["i"].iloc[0]), int(group["j"].iloc[0])
    sides = [group[group["block"] == x] for x in (i, j)]
    sets = [[np.asarray(h, np.int64) for h in side["hashes"]] for side in sides]
    (n, m), (c, d), (k, o) = ([side[x].to_numpy(np.int64) for side in sides] for x in ("n", "component", "k"))
    heads = [[h[: differences(len(h)) + 2 + SPARE] for h in part] for part in sets] if exact else sets
    tokens, counts = np.unique(np.concatenate([h for part in heads for h in part]), return_counts=True)
    shared = tokens[counts > 1]  # in a tile of one block all are counted once, in others twice at most: a superset is enough
    matrix = []
    for part in heads:
        x = np.zeros((len(part), len(shared)), np.float32)
        for row, h in enumerate(part):
            x[row, np.searchsorted(shared, h[_among(h, shared)])] = 1
        matrix.append(x)
    last = [np.array([h[-1] for h in part], np.int64) for part in heads]
    # Of each head, how many hashes lie within the reach of each head of the other side.
    left = np.array([np.searchsorted(h, last[1], "right") for h in heads[0]], np.int64).reshape(len(heads[0]), -1)
    right = np.array([np.searchsorted(h, last[0], "right") for h in heads[1]], np.int64).reshape(len(heads[1]), -1).T
    apart = left + right - 2 * np.rint(matrix[0] @ matrix[1].T).astype(np.int64)
    fits = (100 + PERCENT) * apart <= (100 - PERCENT) * (n[:, None] + m[None, :])
    fits &= 100 * np.minimum(n[:, None], m[None, :]) >= PERCENT * np.maximum(n[:, None], m[None, :])
    fits &= (c[:, None] != d[None, :]) & (k[:, None] < o[None, :] if i == j else k[:, None] != o[None, :])
    x, y = np.nonzero(fits)

    def linked(at: int) -> bool:
        a, b = sets[0][x[at]], sets[1][y[at]]
        common = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * common >= PERCENT * (len(a) + len(b) - common)

    taken = _in_forest(np.argsort(apart[x, y] / (n[x] + m[y]), kind="stable"), c[x], d[y], linked if exact else None)
    x, y = x[taken], y[taken]
    return pd.DataFrame({"a": np.minimum(k[x], o[y]), "b": np.maximum(k[x], o[y])})


def _across(members: DataFrame, heads: DataFrame, docs: DataFrame, exact: bool, tile: int = TILE, hashes: int = TILE_HASHES) -> DataFrame:
    """Pairs (a, b) of members of signatures, in different components: the likeliest ones of each tile, or if exact its links.

    Sets that share many signatures would meet in each; so signatures that share members make one group, and a group
    is compared once, in tiles of some `tile` sets by `tile`, fewer where sets are so large that a block would hold more
    than `hashes` hashes.
    """
    # Of two sets that may be linked by their sizes, the larger one's bucket is the smaller one's or the next.
    bucket = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / PERCENT)))
    sized = members.join(heads.select("k", "n"), "k").withColumn("bucket", F.explode(F.array(bucket, bucket + 1)))
    with_sigs = sized.select(F.col("k").alias("a"), F.xxhash64("sig", "w", "bucket").alias("b"))
    groups = components(with_sigs).select(F.col("node").alias("k"), F.col("component").alias("group"))
    keys = stage_table(members.select("k", "component").distinct().join(groups, "k"), "jaccard-groups")
    # Groups all of whose members are in one component have no pairs across.
    several = keys.groupBy("group").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).where("_low <> _high").select("group")
    if exact:
        sets = stage_table(whole_sets(docs, _wanted(heads, keys.join(several, "group", "left_semi").select("k"))), "jaccard-sets")
    else:
        sets = heads.select("k", "n", F.col("head").alias("hashes"))
    placed = stage_table(keys.join(several, "group", "left_semi").join(sets, "k"), "jaccard-placed")
    free(keys, sets)
    blocks = F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum(F.size("hashes")) / hashes)).cast("int")
    sizes = placed.groupBy("group").agg(blocks.alias("blocks"))
    dealt = placed.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "blocks")
    pairs = stage_table(tiles.groupBy("group", "i", "j").applyInPandas(lambda group: _tile(group, exact), "a long, b long"), "jaccard-across")
    free(placed)
    return pairs


def _frequent(leading: DataFrame) -> set[int]:
    """Shingles that more than LIGHT sets lead with; the most frequent if there are very many, as only the order depends on it."""
    counts = leading.select(F.explode("head").alias("h")).groupBy("h").count().where(F.col("count") > LIGHT)
    return set(counts.orderBy(F.desc("count"), "h").limit(MAX_LATE).select("h").toArrow()["h"].to_pylist())


def link_classes(docs: DataFrame, heads: DataFrame) -> list[DataFrame]:
    """Links (a, b) between classes k, enough to connect all that are connected, as stage tables. heads: k, k2, rep, n, head."""
    sizes = {int(r.n): r["count"] for r in heads.where((F.col("n") > 1) & (F.col("n") <= 2 * LARGEST_BOUNDARY)).groupBy("n").count().collect()}
    boundary, links = choose_boundary(sizes), []
    several = heads.where("n > 1")
    late = _frequent(several)

    def from_texts(keys: DataFrame) -> DataFrame:
        return whole_sets(docs, _wanted(heads, keys), sorted(late)).withColumnRenamed("hashes", "head")


    leading = stage_table(reordered(several, sorted(late)), "jaccard-reordered")
    short = leading.where("not enough").select("k")
    if not short.isEmpty():
        whole = stage_table(leading.where("enough").drop("enough").unionByName(from_texts(short)), "jaccard-leading")
        free(leading)
        leading = whole
    left = None
    for order in range(MAX_ORDERS):
        lists, members = _lists(signatures(leading.select("k", "n", "head"), boundary))
        twos = lists.where("m = 2").select(F.col("pivot").alias("a"), F.col("last").alias("b"), "w")
        found = stage_table(weighed(twos.unionByName(_pairs(members.where(F.col("m") <= LIGHT))).unionByName(_stars(members.where(F.col("m") > LIGHT)))), "jaccard-found")
        links.append(verify(found, heads, docs))
        free(found, lists, left)
        left = _unconnected(members.where(F.col("m") > LIGHT), links)
        free(members)
        if left.isEmpty():
            free(left, leading)
            return links
        if order + 1 < MAX_ORDERS:
            touched = stage_table(left.select("k").distinct(), "jaccard-touched")
            more = _frequent(leading.join(small_or_shuffled(touched, MAX_BROADCAST_ROWS), "k", "left_semi"))
            if more <= late:
                free(touched)
                break
            late |= more
            anew = stage_table(from_texts(touched), "jaccard-leading")
            free(leading, touched)
            leading, boundary = anew, 0
    free(leading)
    # First what is likeliest, so that near copies come together at a linear cost; then whole sets, all still across.
    likeliest = _across(left, heads, docs, exact=False)
    links.append(verify(likeliest.distinct(), heads, docs))
    apart = _unconnected(left.drop("component"), links)
    free(left, likeliest)
    if not apart.isEmpty():
        links.append(_across(apart, heads, docs, exact=True))
    free(apart)
    return links


def _keyed(sketched: DataFrame) -> DataFrame:
    """sketched with k a key that no two different sets share: where two do, the key is hashed anew with the second one."""
    for seed in range(64):
        twice = sketched.groupBy("k").agg(F.min("k2").alias("_low"), F.max("k2").alias("_high")).where("_low <> _high").select(F.col("k").alias("_k"))
        if twice.isEmpty():
            return sketched
        anew = sketched.join(small_or_shuffled(stage_table(twice, "jaccard-collisions"), MAX_BROADCAST_ROWS), F.col("k") == F.col("_k"), "left")
        anew = stage_table(anew.withColumn("k", F.when(F.col("_k").isNull(), F.col("k")).otherwise(F.xxhash64("k", "k2", F.lit(seed)))).drop("_k"), "jaccard-sketches")
        free(sketched)
        sketched = anew
    raise RuntimeError("keys of sets collide again and again")


def _grouped(docs: DataFrame) -> DataFrame:
    """doc_id, h, n, k, k2, component (of the class; null without words), component_id for each row of docs."""
    with short_shuffles(docs.sparkSession):
        sketched = _keyed(stage_table(sketches(docs), "jaccard-sketches"))
        least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n", "k2", "head"))
        classes = sketched.where("n > 0").groupBy("k").agg(least.alias("r"), F.count("*").alias("rows"))
        heads = stage_table(classes.select("k", F.col("r.k2").alias("k2"), F.col("r.doc_id").alias("rep"), F.col("r.n").alias("n"), F.col("r.head").alias("head"), "rows"), "jaccard-heads")
        slim = stage_table(sketched.select("doc_id", "h", "n", "k", "k2"), "jaccard-rows")
        free(sketched)
        links = link_classes(docs, heads)
        joined = _connected(links)
        free(*links)
        named = stage_table(heads.select("k", "rep", "rows").join(joined, "k", "left").withColumn("component", F.coalesce("component", "k")), "jaccard-named")
        free(heads, joined)
        lowest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
        of_class = stage_table(named.join(lowest, "component").select(F.col("k").alias("_k"), "component", "component_id", "rows"), "jaccard-classes")
        free(named)
    # Classes of very many rows, CROWDS at most, go to the workers; so no task gets all rows of one.
    crowd = max(CROWD, slim.count() // CROWDS)
    crowds = F.broadcast(of_class.where(F.col("rows") > crowd).select(F.col("_k").alias("_c"), F.col("component").alias("_cc"), F.col("component_id").alias("_ci")))
    marked = slim.where("n > 0").join(crowds, F.col("k") == F.col("_c"), "left")
    one = marked.where("_c is not null").select("doc_id", "h", "n", "k", "k2", F.col("_cc").alias("component"), F.col("_ci").alias("component_id"))
    rest = marked.where("_c is null").select("doc_id", "h", "n", "k", "k2").join(of_class.where(F.col("rows") <= crowd).drop("rows"), F.col("k") == F.col("_k")).drop("_k")
    none = slim.where("n = 0").withColumns({"component": F.lit(None).cast("long"), "component_id": F.lit(None).cast("long")})
    return one.unionByName(rest).unionByName(none)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    return _grouped(docs).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component: that with the smallest doc_id, of several with it that with the smallest hash of its text.

    Rows without words are linked with nothing, but of rows with the same doc_id and the same text one stays. Rows
    without a doc_id come after those with one. Other columns stay as they are; of rows that differ in them alone, the
    one whose JSON is smallest stays.
    """
    rows = stage_table(_grouped(docs).select("doc_id", "h", "n", "component"), "jaccard-grouped")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    with short_shuffles(docs.sparkSession):
        kept = rows.where("n > 0").groupBy("component").agg(F.min(order).alias("best")).select(F.col("component").alias("_c"), "best")
        each = rows.groupBy("doc_id", "h", "component").agg(F.count("*").alias("times"))
        judged = each.join(kept, F.col("component") == F.col("_c"), "left").withColumn("_gone", F.coalesce(order != F.col("best"), F.lit(False)))
        judged = stage_table(judged.where("_gone or times > 1").select(F.col("doc_id").alias("_jaccard_id"), F.col("h").alias("_jaccard_h"), F.col("_gone").alias("_jaccard_gone")), "jaccard-judged")
        free(rows)
        names = docs.columns
        few = small_or_shuffled(judged, MAX_BROADCAST_ROWS)
        marked = docs.join(few, F.col("doc_id").cast("long").eqNullSafe(F.col("_jaccard_id")) & (_row_hash() == F.col("_jaccard_h")), "left")
        single = marked.where("_jaccard_gone is null").select(*names)
        if judged.where("not _jaccard_gone").isEmpty():
            return single
        twice = marked.where("not _jaccard_gone").groupBy("_jaccard_id", "_jaccard_h").agg(F.min_by(F.struct(*names), F.to_json(F.struct(*names))).alias("_row"))
        return single.unionByName(twice.select("_row.*"))
