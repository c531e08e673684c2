"""Class-based bigram language model with classes from exchange clustering, and its scores of documents.

Training counts every word of the training documents. Clustering moves *units*: the UNITS most frequent words and the end
token are units of their own, and all other words share units by their last two bytes, so every word, seen or not,
has a unit and through it a class, while the bigram table of units stays bounded. Exchange clustering starts from
classes dealt by frequency and moves one unit at a time to the class that raises the likelihood of the class bigrams
most, until hardly any moves remain.

Every other word of training, however rare, then becomes a unit of its own: how often it stands beside each class is
counted in Spark, and it moves from the class of its suffix to the class of the greatest gain by the same measure, all
words at once. Class bigrams are counted anew after that. Suffixes decide for unseen words alone. The classes grow with
the cube root of the words of MINIMUM occurrences or more.

P(w | v) = P(class w | class v) * P(w | class w). Transitions mix bigram and unigram class frequencies by Witten-Bell;
emissions add ALPHA to counts and keep a share for words not seen in a class.

Scale: texts are split into words twice, once to count them and once to write them as numbers: the KEPT most frequent
words by their places, others by their places in a list that each text brings along. All later passes are array work
on these numbers. Counts and classes of the KEPT most frequent words go to the workers. Those of all other words are a
table: each occurrence is dealt to its word with the classes beside it, each word is placed where its occurrences meet,
and a join on the word hands count and class back to the texts. So frequent words are not shuffled, the rare ones have
few rows each, and no vocabulary is gathered anywhere.

Cases: null, empty and blank texts are the end token alone; equal rows are scored alike and each once; a null doc_id is
held out (its CRC is that of an empty text); without training documents every probability is the uniform of what
smoothing leaves; huge texts are read in segments; an empty table gives an empty result; extra columns are not carried.
"""

from __future__ import annotations

import math
import zlib
from hashlib import blake2b
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm._bytes import segments, utf8
from sylva.llm._common import free, short_shuffles, stage_table

ALPHA = 0.1
UNITS = 1023
SUFFIXES = 128
MINIMUM = 5
#: Tokens that a worker takes at a time, and pairs of words it counts at a time.
TOKENS = 1_000_000
PAIRS = 8_000_000
CLASSES = 64
SWEEPS = 12
KEPT = 200_000
FLUSH = 400_000
#: The end token's place among words; no word is empty.
END = b""


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def _tokens(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text by segments, and at last the end token."""
    last = None
    for part in segments(data):
        if last is not None:
            yield last
        last = part.lower().split()
    last.append(END)
    yield last


def _training(batch: pa.RecordBatch) -> Iterator[bytes]:
    for doc_id, data in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
        if not held_out(doc_id):
            yield data


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over training documents, counted in workers before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "c"])
            counts.clear()
            return out

        for batch in batches:
            for data in _training(batch):
                for part in _tokens(data):
                    counts.update(part)
                if len(counts) > FLUSH:
                    yield flush()
        yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


NO_HASHES = np.empty(0, np.int64)


def _hash(word: bytes) -> int:
    return int.from_bytes(blake2b(word, digest_size=8).digest(), "little", signed=True)


class _Units(dict):
    """Word -> unit: frequent words their own, then suffixes, then further words by the places of their sorted hashes."""

    def __init__(self, frequent: list[bytes], suffixes: int, further: np.ndarray = NO_HASHES):
        super().__init__((w, i) for i, w in enumerate(frequent))
        self.first, self.suffixes, self.further, self.room = len(frequent), suffixes, further, len(frequent) + 300_000

    def __missing__(self, word: bytes) -> int:
        unit = self.first + zlib.crc32(word[-2:]) % self.suffixes
        if len(self.further):
            h = _hash(word)
            k = int(self.further.searchsorted(h))
            if k < len(self.further) and self.further[k] == h:
                unit = self.first + self.suffixes + k
        if len(self) < self.room:
            self[word] = unit
        return unit


ENCODED = "doc_id long, rid long, train boolean, ids array<int>, rare array<binary>, suffixes array<int>"


def encode(docs: DataFrame, kept: list[bytes]) -> DataFrame:
    """ENCODED: a text's tokens as places in kept, or from len(kept) on in rare, its distinct other words with suffixes."""
    shared = docs.sparkSession.sparkContext.broadcast(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {w: i for i, w in enumerate(shared.value)}
        get, first = place.get, len(place)
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int32()))
        out: list[list] = [[] for _ in kinds]
        size = 0

        def flush() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [c.split()[0] for c in ENCODED.split(", ")])
            for c in out:
                c.clear()
            return done

        for batch in batches:
            for doc_id, rid, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
                rare: dict[bytes, int] = {}
                parts = []
                for part in _tokens(data):
                    at = np.fromiter(map(get, part, repeat(-1)), np.int32, len(part))
                    for i in np.flatnonzero(at < 0).tolist():
                        at[i] = first + rare.setdefault(part[i], len(rare))
                    parts.append(at)
                ids = parts[0] if len(parts) == 1 else np.concatenate(parts)
                size += len(ids)
                row = (doc_id, rid, not held_out(doc_id), ids, list(rare), [zlib.crc32(w[-2:]) % SUFFIXES for w in rare])
                for c, v in zip(out, row, strict=True):
                    c.append(v)
                if size > TOKENS:
                    yield flush()
                    size = 0
        yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), "text")
    return rows.mapInArrow(run, ENCODED)


class _Flat:
    """Encoded texts end to end: the place, unit and unit before of each token; texts by their starts, rare words by theirs (units: suffixes)."""

    def __init__(self, ids: pa.Array, suffixes: pa.Array, of_kept: np.ndarray, first: int):
        lens, rare = ids.value_lengths().to_numpy(), suffixes.value_lengths().to_numpy()
        at = ids.flatten().to_numpy().astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(lens)[:-1])).astype(np.int64)
        self.far = np.flatnonzero(at >= len(of_kept))
        self.begin = np.concatenate(([0], np.cumsum(rare)[:-1])).astype(np.int64)
        self.word = at[self.far] - len(of_kept) + np.repeat(self.begin, lens)[self.far]
        self.of_word = first + suffixes.flatten().to_numpy().astype(np.int64)
        self.lens = lens
        at[self.far] = 0
        self.at, self.unit = at, of_kept[at]
        self.unit[self.far] = self.of_word[self.word]
        self.before = np.concatenate(([0], self.unit[:-1]))
        self.before[self.starts] = 0  # the end


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """batch by rows of TOKENS tokens or so, or of one longer text."""
    ends = np.cumsum(batch.column("ids").value_lengths().to_numpy())
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOKENS, "right")))
        yield batch.slice(at, to - at)
        at = to


def _flats(batches: Iterator[pa.RecordBatch], of_kept: np.ndarray, first: int) -> Iterator[tuple[pa.RecordBatch, _Flat]]:
    for batch in batches:
        for part in _slices(batch):
            yield part, _Flat(part.column("ids"), part.column("suffixes"), of_kept, first)


def unit_bigrams(encoded: DataFrame, of_kept: np.ndarray, first: int, suffixes: int) -> DataFrame:
    """(code, n): how often unit code // units is followed by unit code % units in training; a text follows an end."""
    units = first + suffixes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(units * units, np.int64)
        for _, flat in _flats(batches, of_kept, first):
            total += np.bincount(flat.before * units + flat.unit, minlength=units * units)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 1 << 16):
            part = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], ["code", "n"])

    return encoded.where("train").select("ids", "suffixes").mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each unit, from counts of unit bigrams (square), units in order of falling frequency.

    Every move is judged exactly: the change of sum G log G over class bigrams G less that of both margins.
    """
    units = len(bigrams)
    of = np.arange(units) % classes
    m = bigrams.astype(np.float64)
    one = np.zeros((units, classes))
    one[np.arange(units), of] = 1
    right, left = m @ one, m.T @ one  # of a unit: followers and predecessors by class
    g = one.T @ right
    for _ in range(sweeps):
        moves = 0
        for u in range(units):
            a, self_n = of[u], m[u, u]
            r, b = right[u].copy(), left[u].copy()
            r[a] -= self_n
            b[a] -= self_n
            if not (r.any() or b.any() or self_n):
                continue
            g[a] -= r
            g[:, a] -= b
            g[a, a] -= self_n
            row, col = g.sum(1), g.sum(0)
            fg = _xlogx(g)
            diag = np.arange(classes)
            grown = _xlogx(g + r) - fg
            grown_col = _xlogx(g + b[:, None]) - fg
            gain = grown.sum(1) - grown[diag, diag] + grown_col.sum(0) - grown_col[diag, diag]
            gain += _xlogx(g[diag, diag] + r + b + self_n) - fg[diag, diag]
            n_r, n_b = r.sum() + self_n, b.sum() + self_n
            gain -= _xlogx(row + n_r) - _xlogx(row) + _xlogx(col + n_b) - _xlogx(col)
            to = int(np.argmax(gain))
            if gain[to] <= gain[a] + 1e-9 * abs(gain[a]):
                to = a
            g[to] += r
            g[:, to] += b
            g[to, to] += self_n
            if to != a:
                moves += 1
                of[u] = to
                right[:, a] -= m[:, u]
                right[:, to] += m[:, u]
                left[:, a] -= m[u]
                left[:, to] += m[u]
        if moves <= units // 200:
            break
    return of


def _moved(g: np.ndarray, a: np.ndarray, word: np.ndarray, slot: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The best class of each of len(a) words, which are of classes a.

    word, slot, n: what stands beside them, ordered by words (places in a): followers by class, predecessors by class, itself.
    A word that moves leaves its class first: its counts go from the row and the column of that class. Wherever it goes,
    words before it and behind it still stand beside it. Only cells of classes beside which it stands change.
    """
    classes, every = len(g), np.arange(len(a))
    near = np.zeros((len(a), 2 * classes + 1))
    near[word, slot] = n
    r, b, own = near[:, :classes], near[:, classes:-1], near[:, -1]
    beside = slot < 2 * classes
    word, slot, n = word[beside], slot[beside], n[beside].astype(np.float64)
    each, old = np.arange(len(slot)), a[word]
    cells = np.concatenate((g.T, g))[slot]  # of followers, its row's cells by class; of predecessors, its column's
    before = np.concatenate((_xlogx(g).T, _xlogx(g)))[slot]
    cells[each, old] -= n
    inside = np.flatnonzero(slot % classes == old)
    cells[inside] -= np.where((slot[inside] < classes)[:, None], b[word[inside]], r[word[inside]])
    cells[inside, old[inside]] -= own[word[inside]]
    before[each, old] = _xlogx(cells[each, old])
    before[inside] = _xlogx(cells[inside])
    grown = _xlogx(cells + n[:, None]) - before
    grown[each, slot % classes] = 0  # the diagonal, below
    gain = np.zeros((len(a), classes))
    if len(word):
        found, starts = np.unique(word, return_index=True)
        gain[found] = np.add.reduceat(grown, starts)
    diagonal = np.repeat(np.diag(g)[None], len(a), 0)
    diagonal[every, a] -= r[every, a] + b[every, a] + own
    gain += _xlogx(diagonal + r + b + own[:, None]) - _xlogx(diagonal)
    for margin, total in ((g.sum(1), r.sum(1) + own), (g.sum(0), b.sum(1) + own)):
        rest = np.repeat(margin[None], len(a), 0)
        rest[every, a] -= total
        gain -= _xlogx(rest + total[:, None]) - _xlogx(rest)
    to = gain.argmax(1)
    return np.where(gain[every, to] > gain[every, a] + 1e-9 * np.abs(gain[every, a]), to, a)


def _summed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes in order, each once, and their sums, from batches (code, n) in order; codes of one code // width stay together."""
    codes, n = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        codes, n = np.concatenate((codes, batch.column(0).to_numpy())), np.concatenate((n, batch.column(1).to_numpy()))
        if not len(codes):
            continue
        starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        codes, n = codes[starts], np.add.reduceat(n, starts)
        last = int(np.searchsorted(codes, codes[-1] // width * width))
        if last:
            yield codes[:last], n[:last]
            codes, n = codes[last:], n[last:]
    if len(codes):
        yield codes, n


def place_kept(encoded: DataFrame, of_kept: np.ndarray, first: int, of: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The classes of all units after the kept words that are not frequent have moved. of: their classes before."""
    classes, units = len(g), first + SUFFIXES
    width = 2 * classes + 1
    shared = encoded.sparkSession.sparkContext.broadcast((of_kept, of, g))

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_kept, of, _ = shared.value
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            for i in range(0, len(found), 1 << 16):
                part = found[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(n[i : i + (1 << 16)])], ["code", "n"])

        for _, flat in _flats(batches, of_kept, first):
            a, b = flat.before, flat.unit
            same, far_a, far_b = a == b, a >= units, b >= units
            right, left, own = far_a & ~same, far_b & ~same, far_a & same
            held += [(a[right] - units) * width + of[b[right]], (b[left] - units) * width + classes + of[a[left]], (a[own] - units) * width + 2 * classes]
            size += len(a)
            if size > PAIRS:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, of, g = shared.value
        for codes, n in _summed(batches, width):
            ks, word = np.unique(codes // width, return_inverse=True)
            to = _moved(g, of[units + ks], word, codes % width, n)
            yield pa.RecordBatch.from_arrays([pa.array(ks), pa.array(to.astype(np.int32))], ["word", "class"])

    texts = encoded.where("train").select("ids", "suffixes")
    sparse = texts.mapInArrow(beside, "code long, n long").repartition(F.expr(f"code div {width}")).sortWithinPartitions("code")
    placed = sparse.mapInArrow(place, "word long, class int").toArrow()
    of = of.copy()
    of[units + placed["word"].to_numpy()] = placed["class"].to_numpy()
    return of


def _whole_words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Distinct words, the place of each row's word among them and the rows' values, from batches (word, value) in order of words; all rows of a word stay together."""
    words, values = pa.array([], pa.binary()), np.empty(0, np.int64)
    for batch in batches:
        words, values = pa.concat_arrays([words, batch.column(0)]), np.concatenate((values, batch.column(1).to_numpy()))
        if not len(words):
            continue
        coded = words.dictionary_encode()
        of = coded.indices.to_numpy()
        last = int(np.searchsorted(of, of[-1]))
        if last:
            yield coded.dictionary[:-1], of[:last], values[:last]
            words, values = words[last:], values[last:]
    if len(words):
        coded = words.dictionary_encode()
        yield coded.dictionary, coded.indices.to_numpy(), values


def place_rare(encoded: DataFrame, of_kept: np.ndarray, first: int, of: np.ndarray, g: np.ndarray) -> DataFrame:
    """(word, c, class): all training words that are not kept, their counts, and their classes after they have moved. of: of units before any move.

    Each occurrence goes to its word with three classes in one number: of its suffix, before it and behind it; in place
    of the last two, classes stands for the word itself.
    """
    classes = len(g)
    width, base = 2 * classes + 1, classes + 1
    shared = encoded.sparkSession.sparkContext.broadcast((of_kept, of, g))

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_kept, of, _ = shared.value
        for part, flat in _flats(batches, of_kept, first):
            far = flat.far  # never the last token, which is an end
            word = np.full(len(flat.at), -1)
            word[far] = flat.word
            before = np.where(word[far - 1] == flat.word, classes, of[flat.before[far]])
            behind = np.where(word[far + 1] == flat.word, classes, of[flat.unit[far + 1]])
            seen = (of[flat.unit[far]] * base + before) * base + behind
            words = part.column("rare").flatten()
            for i in range(0, len(far), 1 << 16):
                at = pa.array(flat.word[i : i + (1 << 16)])
                yield pa.RecordBatch.from_arrays([words.take(at), pa.array(seen[i : i + (1 << 16)])], ["word", "seen"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value[2]
        for words, of_row, seen in _whole_words(batches):
            before, behind = seen // base % base, seen % base
            other = behind < classes
            codes = np.concatenate((of_row * width + np.where(before < classes, classes + before, 2 * classes), (of_row * width + behind)[other]))
            codes, n = np.unique(codes, return_counts=True)
            old = seen[np.searchsorted(of_row, np.arange(len(words)))] // (base * base)
            to = _moved(g, old, codes // width, codes % width, n)
            yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(of_row)), pa.array(to.astype(np.int32))], ["word", "c", "class"])

    texts = encoded.where("train").select("ids", "rare", "suffixes")
    dealt = texts.mapInArrow(beside, "word binary, seen long").repartition("word").sortWithinPartitions("word")
    return dealt.mapInArrow(place, "word binary, c long, class int")


def with_rare(encoded: DataFrame, placed: DataFrame) -> DataFrame:
    """encoded without its rare words, but with found: the places among them, classes and counts of those that occur in training."""
    rare = encoded.select("rid", F.posexplode("rare").alias("at", "word")).join(placed, "word")
    found = rare.groupBy("rid").agg(F.collect_list(F.struct("at", "class", "c")).alias("found"))
    return encoded.select("doc_id", "rid", "train", "ids", "suffixes").join(found, "rid", "left")


def _classes(part: pa.RecordBatch, flat: _Flat, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class of each token and of the one before it, and the counts of rare words, from rows of with_rare."""
    found = part.column("found")
    rows = found.flatten()
    at = rows.field("at").to_numpy() + np.repeat(flat.begin, found.value_lengths().fill_null(0).to_numpy())
    of_word, c = of[flat.of_word], np.zeros(len(flat.of_word), np.int64)
    of_word[at], c[at] = rows.field("class").to_numpy(), rows.field("c").to_numpy()
    cls = of[flat.unit]
    cls[flat.far] = of_word[flat.word]
    before = np.concatenate((of[:1], cls[:-1]))
    before[flat.starts] = of[0]  # the end
    return cls, before, c


def class_bigrams(texts: DataFrame, of_kept: np.ndarray, first: int, of: np.ndarray, classes: int) -> np.ndarray:
    """How often each class is followed by each in training. texts: of with_rare."""
    shared = texts.sparkSession.sparkContext.broadcast((of_kept, of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_kept, of = shared.value
        total = np.zeros(classes * classes, np.int64)
        for part, flat in _flats(batches, of_kept, first):
            cls, before, _ = _classes(part, flat, of)
            total += np.bincount(before * classes + cls, minlength=classes * classes)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "n"])

    rows = texts.where("train").select("ids", "suffixes", "found").mapInArrow(run, "code long, n long")
    found = rows.groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    g = np.zeros(classes * classes)
    g[found["code"].to_numpy()] = found["n"].to_numpy()
    return g.reshape(classes, classes)


class Model:
    """What workers need to score: classes of units, log transitions, emission denominators, counts of kept words, sorted hashes of those that are not frequent.

    placed: the stage table of place_rare, of all other training words.
    """

    def __init__(self, frequent, suffixes, of, transitions, denominators, kept, base_denominator, further, of_kept, placed):
        self.frequent, self.suffixes, self.of, self.of_kept, self.placed = frequent, suffixes, of, of_kept, placed
        self.transitions, self.denominators, self.kept, self.base_denominator, self.further = transitions, denominators, kept, base_denominator, further


def kept_words(counts: DataFrame, most: int | None = None) -> tuple[list[bytes], list[int]]:
    """The end token and then the most frequent words, `most` in all, with their counts."""
    top = counts.where(F.col("word") != F.lit(END)).orderBy(F.desc("c"), "word").limit((most or KEPT) - 1).toArrow()
    end = counts.where(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    return [END, *top["word"].to_pylist()], [int(end), *top["c"].to_pylist()]


def learn(counts: DataFrame, classes: int, encoded: DataFrame, kept: tuple[list[bytes], list[int]]) -> tuple[Model, int, DataFrame]:
    """The model, the number of training tokens, and the stage table of with_rare, which has taken the place of encoded."""
    enough = F.sum((F.col("c") >= MINIMUM).cast("long"))
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(enough, F.lit(0)).alias("enough")).first()
    words, n_of = kept
    frequent = words[:UNITS]
    first, units = len(frequent), len(frequent) + SUFFIXES
    plain = _Units(frequent, SUFFIXES)
    plain_kept = np.array([plain[w] for w in words], np.int64)
    found = unit_bigrams(encoded, plain_kept, first, SUFFIXES).toArrow()
    bigrams = np.zeros(units * units, np.int64)
    bigrams[found["code"].to_numpy()] = found["n"].to_numpy()
    bigrams = bigrams.reshape(units, units)
    classes = max(classes, math.ceil(max(totals.enough - sum(n >= MINIMUM for n in n_of[:UNITS]), 0) ** (1 / 3)))
    order = np.argsort(-bigrams.sum(0), kind="stable")
    of = np.empty(units, np.int64)
    of[order] = exchange(bigrams[np.ix_(order, order)], classes)
    one = np.zeros((units, classes))
    one[np.arange(units), of] = 1
    g = one.T @ bigrams @ one
    hashes = np.array([_hash(w) for w in words[UNITS:]], np.int64)
    further, at = np.unique(hashes, return_index=True)
    of = np.concatenate((of, of[plain_kept[UNITS:][at]]))
    unit = _Units(frequent, SUFFIXES, further)
    of_kept = np.array([unit[w] for w in words], np.int64)
    placed = stage_table(place_rare(encoded, of_kept, first, of, g), "placed")
    if len(further):
        of = place_kept(encoded, of_kept, first, of, g)
    texts = stage_table(with_rare(encoded, placed), "texts")
    free(encoded)
    g = class_bigrams(texts, of_kept, first, of, classes)
    singles = (g.sum(0) + ALPHA) / (g.sum() + ALPHA * classes)
    seen, kinds = g.sum(1, keepdims=True), np.maximum((g > 0).sum(1, keepdims=True), 1)
    transitions = np.log10((g + kinds * singles) / (seen + kinds))
    n_of = np.array(n_of, np.float64)
    denominators = ALPHA + np.bincount(of[of_kept], n_of + ALPHA * (n_of > 0), classes)
    for r in placed.groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        denominators[r["class"]] += r.n + ALPHA * r.v
    known = {w: (n > 0, math.log10(n + ALPHA)) for w, n in zip(words, n_of.tolist(), strict=True)}
    model = Model(frequent, SUFFIXES, of, transitions, np.log10(denominators), known, math.log10(totals.n + ALPHA * (totals.v + 1)), further, of_kept, placed)
    return model, int(totals.n), texts


def train(docs: DataFrame, counts: DataFrame, classes: int = CLASSES) -> tuple[Model, int]:
    """The model, and the number of training tokens. counts: the written table of word_counts(docs)."""
    kept = kept_words(counts)
    model, n, texts = learn(counts, classes, stage_table(encode(docs, kept[0]), "encoded"), kept)
    free(texts)
    return model, n


SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def scores(texts: DataFrame, model: Model) -> DataFrame:
    """SCORES of each document. texts: of with_rare."""
    seen, logs = (np.array([x[i] for x in model.kept.values()]) for i in (0, 1))
    arrays = (model.of_kept, len(model.frequent), model.of, model.transitions, model.denominators, seen, logs, model.base_denominator)
    shared = texts.sparkSession.sparkContext.broadcast(arrays)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_kept, first, of, transitions, denominators, seen, logs, base = shared.value
        for part, flat in _flats(batches, of_kept, first):
            cls, before, c = _classes(part, flat, of)
            near, known = logs[flat.at], seen[flat.at].astype(np.int64)
            near[flat.far], known[flat.far] = np.log10(c + ALPHA)[flat.word], (c > 0)[flat.word]
            total = np.add.reduceat(near, flat.starts)
            own = np.add.reduceat(transitions[before, cls] - denominators[cls], flat.starts)
            columns = [part.column("doc_id"), pa.array(flat.lens.astype(np.int64)), pa.array(np.add.reduceat(known, flat.starts))]
            columns += [pa.array(total - flat.lens * base), pa.array(total + own)]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCORES.split(", ")])

    return texts.select("doc_id", "ids", "suffixes", "found").mapInArrow(run, SCORES)


def score(docs: DataFrame, classes: int = CLASSES) -> DataFrame:
    """One row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), perplexity."""
    with short_shuffles(docs.sparkSession):
        counts = stage_table(word_counts(docs), "word-counts")
        kept = kept_words(counts)
        model, n, texts = learn(counts, classes, stage_table(encode(docs, kept[0]), "encoded"), kept)
        free(counts, model.placed)
        done = stage_table(scores(texts, model), "scores")
        free(texts)
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    return done.select(
        "doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score"
    ).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
