"""Quality rules: base counts of a text, and divergence of its histograms from language references.

Two histograms describe a text: characters by class, and words by which of the reference's common words they are. Each
is held against the reference of the document's language by Jensen-Shannon divergence (base 2, in 0..1). A text that
lies too far from its language is rejected; one with fewer than MIN_WORDS words is too short to be judged by divergence,
and texts of up to LONG words get a wider limit, as their histograms are noisy. A document whose language has no
reference is held against the nearest one.

All of it is one projection over built-in functions: no shuffle, and the cost is linear in the text (times a
logarithm for texts with repeated windows).

Cases: null, empty and blank texts have no words and fail the base rules; a null or unknown language takes the nearest
reference; equal rows get equal results; an empty table gives an empty result; kept() keeps extra columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylva.llm._common import SPACE_CLASS, where_late, words

WINDOW = 8
MIN_WORDS = 50
LONG = 200
#: Greatest Jensen-Shannon distances (base 2) from the reference: of characters, of words in long texts and in shorter ones.
MAX_CHARS, MAX_WORDS_LONG, MAX_WORDS_SHORT = 0.316, 0.300, 0.346
REFERENCE_WORDS = 20

#: Rounded shares, in running text, of common words by language, from general frequency lists, in per mille.
COMMON_WORDS = {
    "en": {"the": 58, "of": 31, "and": 26, "to": 24, "in": 19, "a": 20, "is": 11, "that": 11, "for": 9, "it": 9, "was": 9, "on": 7, "be": 6, "with": 7, "as": 7, "by": 6, "this": 5, "at": 5, "are": 5, "from": 4},
    "fr": {"de": 52, "la": 32, "le": 26, "et": 23, "les": 22, "des": 18, "en": 14, "un": 13, "du": 13, "une": 11, "que": 10, "est": 10, "pour": 8, "qui": 8, "dans": 8, "par": 7, "sur": 6, "pas": 6, "au": 6, "plus": 4},
    "de": {"der": 34, "die": 33, "und": 27, "in": 18, "den": 12, "von": 12, "zu": 10, "das": 10, "mit": 9, "sich": 7, "des": 9, "auf": 8, "für": 8, "ist": 9, "im": 8, "dem": 7, "nicht": 7, "ein": 6, "eine": 6, "als": 5},
    "es": {"de": 58, "la": 37, "que": 27, "el": 29, "en": 26, "y": 25, "a": 20, "los": 17, "se": 12, "del": 13, "las": 12, "un": 10, "por": 9, "con": 9, "no": 8, "una": 8, "su": 7, "para": 7, "es": 7, "al": 6},
}
#: Rounded shares of characters by class, in per mille: plain lower-case letters and others, capitals,
#: digits, white space, stops, symbols, and bytes beyond one for each character.
CHAR_SHARES = {
    "en": (779, 25, 5, 165, 25, 1, 0),
    "fr": (727, 22, 5, 163, 30, 1, 52),
    "de": (750, 45, 5, 145, 27, 1, 27),
    "es": (735, 22, 5, 165, 25, 1, 47),
}
SYMBOLS = r"[#*$%&|<>]"
STOPS = r"""[.,;:?"'()-]"""


def _count(text: str, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def _per_language(table: dict, kind: str, lang: str) -> Column:
    """The entry of a table of lists for the language in a column."""
    return F.element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]).cast(kind))]), F.col(lang))


def term(p: Column, q: Column) -> Column:
    """What one bin adds to twice the Jensen-Shannon divergence (base 2) of two distributions."""
    part = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(0.0)
    return part(p) + part(q)


def _window_hashes(w: str) -> Column:
    """The hash of each window of WINDOW words."""
    n = F.size(w)
    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(F.col(w), i + k) for k in range(WINDOW)]))
    return F.when(n >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>"))


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with word_chars, n_words, n_symbols, n_dup_lines, n_repeat_words, base_failed, and the words in `_w`."""
    spaces = _count("_t", SPACE_CLASS)
    lines = F.filter(F.split("_t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    same = lambda x, k: F.coalesce(F.get(F.col("_s"), k)["h"] == x["h"], F.lit(False))
    at = F.sort_array(F.transform(F.filter("_s", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))
    covered = F.aggregate(
        F.transform("_at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_at"), k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x
    )
    return (
        docs.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
        .withColumn("_w", words(F.col("_t")))
        .withColumn("n_words", F.size("_w").cast("long"))
        .withColumn("_spaces", spaces)
        .withColumn("word_chars", (F.length("_t") - F.col("_spaces")).cast("long"))
        .withColumn("n_symbols", _count("_t", SYMBOLS))
        .withColumn("_lines", lines)
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("_h", _window_hashes("_w"))
        .withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
        .withColumn("_at", at)
        .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
        .withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
        .drop("_lines", "_h", "_s", "_at")
    )


def references(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = REFERENCE_WORDS) -> tuple[dict, dict]:
    """References built from a corpus of plain text, in the form of COMMON_WORDS and CHAR_SHARES, in shares per mille.

    The `most` most frequent words of each language (ties by word) with their share of its words, and the shares of its
    characters by class. What comes to the driver is `most` words and seven shares a language. Documents without a
    language are left out.
    """
    rows = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    counts = rows.select("lang", F.explode(F.transform(words(F.col("_t")), lambda x: F.lower(x))).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("c"))
    order = Window.partitionBy("lang").orderBy(F.desc("c"), "w")
    total = Window.partitionBy("lang")
    best = counts.withColumn("n", F.sum("c").over(total)).withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    common: dict = {}
    for r in best.orderBy("lang", "r").collect():
        common.setdefault(r.lang, {})[r.w] = 1000 * r.c / r.n
    classes = [_count("_t", "[A-Z]"), _count("_t", "[0-9]"), _count("_t", SPACE_CLASS), _count("_t", STOPS), _count("_t", SYMBOLS), (F.octet_length("_t") - F.length("_t")).cast("long")]
    sums = rows.groupBy("lang").agg(F.sum(F.length("_t").cast("long")).alias("n"), *[F.sum(c).alias(f"c{i}") for i, c in enumerate(classes)])
    shares = {}
    for r in sums.collect():
        c = [r[f"c{i}"] for i in range(6)]
        every = [max(r.n - sum(c), 0), *c]
        shares[r.lang] = tuple(1000 * x / max(sum(every), 1) for x in every)
    return common, {k: shares[k] for k in common}


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", common_words: dict = COMMON_WORDS, char_shares: dict = CHAR_SHARES) -> DataFrame:
    """docs with the base counts, char_distance, word_distance (Jensen-Shannon, base 2) and kept."""
    known = list(common_words)
    lists = {k: list(v) for k, v in common_words.items()}
    # Filtering before lowering spares most words the lowering.
    forms = sorted({f for table in common_words.values() for w in table for f in (w, w.capitalize(), w.upper())})
    word_shares = {k: [x / 1000 for x in v.values()] for k, v in common_words.items()}
    shares = {k: [x / sum(v) for x in v] for k, v in char_shares.items()}
    upper, digit, stop = _count("_t", "[A-Z]"), _count("_t", "[0-9]"), _count("_t", STOPS)
    beyond = (F.octet_length("_t") - F.length("_t")).cast("long")
    rest = F.length("_t") - F.col("_upper") - F.col("_digit") - F.col("_spaces") - F.col("_stop") - F.col("n_symbols") - F.col("_beyond")
    classes = ["_rest", "_upper", "_digit", "_spaces", "_stop", "n_symbols", "_beyond"]
    # A document in another language is held against the one of whose common words it has most.
    fit = lambda k: F.struct(F.size(F.filter("_common", lambda x: x.isin(lists[k]))).alias("n"), F.lit(k).alias("k"))
    nearest = F.when(F.col(lang).isin(known), F.col(lang)).otherwise(F.array_max(F.array(*map(fit, known)))["k"])
    total = F.nullif(sum((F.col(c) for c in classes[1:]), F.col("_rest")), F.lit(0))
    chars = sum((term(F.col(c) / F.col("_total"), F.get("_shares", k)) for k, c in enumerate(classes[1:], 1)), term(F.col("_rest") / F.col("_total"), F.get("_shares", 0))) / 2
    counts = F.transform("_list", lambda b: F.size(F.filter("_common", lambda x: x == b)))
    listed = F.aggregate("_counts", F.lit(0), lambda a, x: a + x)
    others = term((F.col("n_words") - F.col("_listed")) / F.col("n_words"), 1 - F.aggregate("_word_shares", F.lit(0.0), lambda a, x: a + x))
    terms = F.zip_with("_counts", "_word_shares", lambda c, q: term(c / F.col("n_words"), q))
    among = (F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) + others) / 2
    limit = F.when(F.col("n_words") >= LONG, MAX_WORDS_LONG).otherwise(MAX_WORDS_SHORT)
    far = (F.col("n_words") >= MIN_WORDS) & ((F.col("char_distance") > MAX_CHARS) | (F.col("word_distance") > limit))
    return (
        base_counts(docs, text)
        .withColumns({"_upper": upper, "_digit": digit, "_stop": stop, "_beyond": beyond})
        .withColumn("_rest", F.greatest(rest, F.lit(0)).cast("long"))
        .withColumn("_common", F.transform(F.filter("_w", lambda x: x.isin(forms)), lambda x: F.lower(x)))
        .withColumn("_reference", nearest)
        .withColumns({"_total": total, "_shares": _per_language(shares, "array<double>", "_reference"), "_word_shares": _per_language(word_shares, "array<double>", "_reference"), "_list": _per_language(lists, "array<string>", "_reference")})
        .withColumn("_counts", counts)
        .withColumn("_listed", listed)
        .withColumn("char_distance", F.when(F.col("_total") > 0, F.sqrt(F.greatest(chars, F.lit(0.0)))).otherwise(0.0))
        .withColumn("word_distance", F.when(F.col("n_words") > 0, F.sqrt(F.greatest(among, F.lit(0.0)))).otherwise(0.0))
        .withColumn("kept", ~F.col("base_failed") & ~far)
        .drop("_t", "_w", *[c for c in classes if c[0] == "_"], "_common", "_reference", "_total", "_shares", "_word_shares", "_list", "_counts", "_listed")
    )


def kept(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns, whatever these are called."""
    packed = docs.select(F.struct(*docs.columns).alias("_row"), "text", "lang")
    return where_late(judge(packed), "kept").select("_row.*")
