"""Text predicates, repairs, splits and chunks as column expressions."""

from __future__ import annotations

import html

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words with which a paragraph does not end.
CONNECTORS = ["and", "or", "but", "because", "although", "however", "if", "while", "when", "to", "for", "in", "of", "with", "on", "as", "at", "by", "from", "such", "the", "a", "an"]
#: HTML entities that clean() resolves: the named ones of Latin text.
ENTITIES = {f"&{n};": html.unescape(f"&{n};") for n in "lt gt quot apos nbsp copy reg hellip mdash ndash lsquo rsquo ldquo rdquo eacute egrave agrave ccedil ouml uuml auml szlig ntilde".split()}


def strip(text: Column) -> Column:
    """text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def split_words(text: Column) -> Column:
    bare = strip(F.coalesce(text, F.lit("")))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"(?U)\s+"))


def let(value: Column, body) -> Column:
    """body(value) with value computed once: what stands in a lambda would otherwise be computed in each of its rounds."""
    return F.get(F.transform(F.array(value), body), 0)


def is_incomplete_paragraph(text: Column) -> Column:
    """Whether a paragraph seems cut off: a hyphen, comma, colon or semicolon at its end, no full stop, or a connector
    before it. Texts of fewer than 5 words or 25 characters are titles or captions and complete."""
    bare = strip(F.coalesce(text, F.lit("")))
    unquoted = F.regexp_replace(bare, r"""['"]+$""", "")
    last = F.lower(F.regexp_extract(unquoted, r"(?U)\b(\w+)\b\W*$", 1))
    short = (F.size(split_words(text)) < 5) | (F.length(bare) < 25)
    cut = bare.endswith("-") | unquoted.rlike("[,:;]$") | ~unquoted.rlike("[.!?]$") | last.isin(CONNECTORS)
    return ~short & cut


def begins_with_acronym(text: Column) -> Column:
    """Whether the first word has two characters or more, a capital, and no small letter."""
    first = F.get(split_words(text), F.lit(0))
    return F.coalesce((F.length(first) > 1) & first.rlike(r"\p{Lu}") & ~first.rlike(r"\p{Ll}"), F.lit(False))


def fix_dashes(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)-\s+", "-")


def join_hyphenated(parts: Column) -> Column:
    """Parts of a paragraph joined by spaces, or, behind a hyphen, without it and a space. Empty parts and lone hyphens are passed over."""
    parts = F.filter(parts, lambda x: (F.coalesce(x, F.lit("")) != "") & (x != "-"))
    return F.aggregate(parts, F.lit(""), lambda a, x: F.when(a == "", x).when(a.endswith("-"), F.concat(F.regexp_replace(a, "-$", ""), x)).otherwise(F.concat(a, F.lit(" "), x)))


def cut_ocr_noise(text: Column, window: int = 15, ratio: float = 0.9) -> Column:
    """text up to the first window of words of which a share of ratio or more are single characters.

    Texts with too few single characters in all are not searched.
    """
    least = next(k for k in range(window + 1) if k / window >= ratio)
    total = lambda ones: F.aggregate(ones, F.lit(0), lambda a, x: a + x)

    def cut(ws: Column) -> Column:
        def first(ones: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.size(ones) - window), lambda i: total(F.slice(ones, i + 1, F.lit(window))) >= least)
            return F.when((F.size(ones) >= window) & (total(ones) >= least), F.array_min(starts))

        at = let(F.transform(ws, lambda w: (F.length(w) == 1).cast("int")), first)
        return let(at, lambda n: F.when(n.isNotNull(), F.array_join(F.slice(ws, F.lit(1), n), " ")))

    return F.coalesce(let(split_words(text), cut), text)


def split_at(text: Column, marks: list[str]) -> Column:
    """The trimmed, non-empty parts of text between any of some literal marks."""
    if not marks:
        return F.array(text)
    return F.filter(F.transform(F.split(text, "|".join(rf"\Q{m}\E" for m in marks)), strip), lambda x: x != "")


def split_symbols(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\W+"), lambda x: x != "")


def clean(text: Column) -> Column:
    """text with entities resolved and control characters dropped, lower-cased, other than letters, digits and spaces blanked."""
    out = strip(text)
    for name, value in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(value))
    out = F.replace(F.regexp_replace(out, r"&#39;", "'"), F.lit("&amp;"), F.lit("&"))
    out = F.regexp_replace(out, r"[\x00-\x1f\x7f-\x9f]", "")
    return F.trim(F.regexp_replace(F.lower(out), "[^A-Za-z0-9 ]", " "))


def first_words(text: Column, n: int = 100) -> Column:
    """The first n words of a longer text; a shorter one as it is."""
    ws = split_words(text)
    return F.when(F.size(ws) > n, F.array_join(F.slice(ws, 1, n), " ")).otherwise(text)


def clean_name(name: Column) -> Column:
    return F.regexp_replace(strip(F.lower(name)), r"(?U)\s+", " ")


def clean_type(kind: Column) -> Column:
    return F.regexp_replace(F.upper(strip(kind)), " ", "_")


def has_letters(text: Column) -> Column:
    return F.coalesce(text.rlike("[a-zA-Z]"), F.lit(False))


def is_number(text: Column) -> Column:
    """Whether a string reads as a number."""
    return F.coalesce(strip(text).rlike(r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$"), F.lit(False))


def is_cell_number(text: Column) -> Column:
    """As is_number, leaving out percent signs, brackets and commas."""
    return is_number(F.regexp_replace(text, r"[%(),]", ""))


def is_plain_float(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[-+]?[0-9]*\.?[0-9]+$"), F.lit(False))


def sentences(text: Column) -> Column:
    """text split behind full stops, exclamation and question marks."""
    return F.filter(F.split(strip(F.coalesce(text, F.lit(""))), r"(?U)(?<=[.!?])\s+"), lambda s: s != "")


def n_tokens(text: Column) -> Column:
    """The default token counter: words."""
    return F.size(split_words(text))


def chunks(text: Column, budget: int) -> Column:
    """Sentences packed in order into chunks of at most budget words; a longer sentence is cut every budget words.

    A fold over sentences: the open chunk closes when the next sentence does not fit. Empty texts have no chunks.
    """
    start = F.struct(F.lit("").alias("open"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("done"))
    closed = lambda a: F.when(a["n"] > 0, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"])

    def add(a: Column, s: Column) -> Column:
        ws, n = split_words(s), n_tokens(s)
        cut = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / budget).cast("int")), lambda i: F.array_join(F.slice(ws, i * budget + 1, F.lit(budget)), " "))
        flushed = F.struct(F.lit("").alias("open"), F.lit(0).alias("n"), F.concat(closed(a), cut).alias("done"))
        fresh = F.struct(s.alias("open"), n.alias("n"), closed(a).alias("done"))
        grown = F.struct(F.when(a["n"] > 0, F.concat(a["open"], F.lit(" "), s)).otherwise(s).alias("open"), (a["n"] + n).alias("n"), a["done"].alias("done"))
        return F.when(n > budget, flushed).when(a["n"] + n > budget, fresh).otherwise(grown)

    return F.aggregate(sentences(text), start, add, closed)


def prefix_within(items: Column, sizes: Column, budget: int) -> Column:
    """The leading items whose sizes sum up to at most budget; the first that does not fit ends it."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(True).alias("on"), F.lit(0).alias("n"))

    def add(a: Column, x: Column) -> Column:
        fits = a["on"] & (a["sum"] + x <= budget)
        return F.struct(F.when(fits, a["sum"] + x).otherwise(a["sum"]).alias("sum"), fits.alias("on"), (a["n"] + fits.cast("int")).alias("n"))

    return F.slice(items, F.lit(1), F.aggregate(sizes, start, add, lambda a: a["n"]))


def pack_in_order(sizes: Column, budget: int) -> Column:
    """The bin, from 0, of each item when items fill bins of a budget in order; an oversized item has a bin of its own."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(-1).alias("bin"), F.array().cast("array<int>").alias("bins"))

    def add(a: Column, x: Column) -> Column:
        new = (a["bin"] < 0) | (a["sum"] + x > budget)
        b = F.when(new, a["bin"] + 1).otherwise(a["bin"])
        return F.struct(F.when(new, x).otherwise(a["sum"] + x).alias("sum"), b.alias("bin"), F.concat(a["bins"], F.array(b)).alias("bins"))

    return F.aggregate(sizes, start, add, lambda a: a["bins"])


def uuid5(name: Column, namespace: str = "6ba7b810-9dad-11d1-80b4-00c04fd430c8") -> Column:
    """The version 5 UUID of a name; the default namespace is that of DNS names."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
