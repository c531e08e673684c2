"""Scores of predicted answers against given ones, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.functions.text import is_number, let, split_words, strip

PUNCTUATION = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""
_UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
#: Number words that stand alone as a token.
NUMBER_WORDS = {w: i for i, w in enumerate(_UNITS)} | {w: 10 * i for i, w in enumerate(_TENS, 2)} | {"hundred": 100, "thousand": 1000, "million": 10**6, "billion": 10**9}


def anls(gold: Column, predicted: Column, cut: float = 0.5) -> Column:
    """Edit similarity over the longer length; cut or less counts 0."""
    longest = F.greatest(F.length(gold), F.length(predicted))
    value = F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(gold, predicted) / longest)
    return F.when(value <= cut, 0.0).otherwise(value)


def _places(x: Column) -> Column:
    """Digits behind the point of a number as it is written."""
    return F.when(F.contains(x.cast("string"), F.lit(".")), F.length(F.substring_index(x.cast("string"), ".", -1))).otherwise(3)


def numbers_equal(gold: Column, predicted: Column, percent: bool = False, close: bool = False) -> Column:
    """Equality of doubles rounded to the coarser of their written precisions (2 places at least); with percent also at
    a hundredth and a hundred times gold, with close within one per cent."""
    found = F.lit(False)
    for item in [gold / 100, gold, gold * 100] if percent else [gold]:
        p = F.greatest(F.least(_places(predicted), _places(item)), F.lit(2))
        scale = F.pow(F.lit(10.0), p)
        same = F.bround(predicted * scale) == F.bround(item * scale)
        near = F.abs(item - predicted) <= 0.01 * F.greatest(F.abs(item), F.abs(predicted))
        found = found | (same | near if close else same)
    return F.coalesce(found, F.lit(False))


def clean_answer(text: Column) -> Column:
    """Lower case, without remarks in brackets, a quotation mark at either end, a leading $ or a trailing %."""
    out = F.regexp_replace(strip(F.lower(text)), r"(?U)\s*\([^)]*\)", "")
    out = strip(F.regexp_replace(strip(out), r"""^['"]|['"]$""", ""))
    return strip(F.regexp_replace(strip(F.regexp_replace(out, r"^\$+", "")), "%+$", ""))


def needs_exact_match(text: Column) -> Column:
    """Whether an answer is a web address, file, page, number, time of day, date or mail address."""
    return (
        text.contains("https://") | text.endswith(".py") | text.endswith("ipynb") | text.startswith("page")
        | text.rlike(r"^\d+(-\d+|\s\d+)?$") | text.contains("a.m.") | text.contains("p.m.")
        | text.rlike(r"^\d{4}[-\s]\d{2}[-\s]\d{2}$") | text.rlike(r"^\d{4}[-\s]\d{2}$")
        | text.rlike(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$")
    )


def text_score(gold: Column, predicted: Column) -> Column:
    g, p = clean_answer(gold), clean_answer(predicted)
    return F.when(needs_exact_match(g), (g == p).cast("double")).otherwise(anls(g, p))


def _listed(text: Column) -> Column:
    return F.when(text.startswith("["), F.from_json(F.replace(text, F.lit("'"), F.lit('"')), "array<string>")).otherwise(F.array(text))


def list_score(gold: Column, predicted: Column) -> Column:
    """Lists of equal length compared in sorted order: exactly if the first answer asks for it, else by the worst ANLS."""
    g, p = (F.array_sort(F.transform(_listed(x), clean_answer)) for x in (gold, predicted))
    first = F.get(g, F.lit(0))
    exact = (F.array_join(g, "-") == F.array_join(p, "-")).cast("double")
    worst = F.array_min(F.zip_with(g, p, lambda x, y: anls(x, y)))
    return F.when(F.size(g) != F.size(p), 0.0).when(is_number(first) | needs_exact_match(first), exact).otherwise(worst)


def typed_score(gold: Column, predicted: Column, kind: Column) -> Column:
    """The score of an answer by its type: Int, Float, Str, None or a list."""
    number = lambda c: clean_answer(c).try_cast("double")
    whole = F.coalesce((gold.try_cast("long") == F.floor(predicted.try_cast("double"))), F.lit(False)).cast("double")
    real = numbers_equal(number(gold), number(predicted), percent=True, close=True).cast("double")
    return F.when(kind == "Int", whole).when(kind == "Float", real).when(kind.isin("Str", "None"), text_score(gold, predicted)).otherwise(list_score(gold, predicted))


def normalize_answer(text: Column) -> Column:
    """Lower case without punctuation, articles and double spaces."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text), PUNCTUATION, ""), r"\b(a|an|the)\b", " ")
    return F.array_join(split_words(out), " ")


def token_f1(predicted: Column, gold: Column) -> Column:
    """F1 of the bags of words of two answers, each word counting as often as in both."""
    bag = lambda x: F.filter(F.split(normalize_answer(x), " "), lambda w: w != "")
    times = lambda words, w: F.size(F.filter(words, lambda x: x == w))

    def f1(b: Column) -> Column:
        # Only words of both can be common; what is left of the longer side is searched for each of them.
        shared = let(F.array_intersect(b["g"], b["p"]), lambda c: F.struct(c.alias("c"), F.filter(b["p"], lambda x: F.array_contains(c, x)).alias("p")))
        common = let(shared, lambda m: F.aggregate(m["c"], F.lit(0), lambda a, w: a + F.least(times(b["g"], w), times(m["p"], w))))
        return let(common, lambda c: F.when(c == 0, 0.0).otherwise(2.0 * c / (F.size(b["p"]) + F.size(b["g"]))))

    return let(F.struct(bag(predicted).alias("p"), bag(gold).alias("g")), f1)


def set_f1(predicted: Column, gold: Column) -> Column:
    """F1 of two arrays as sets; two empty ones agree."""
    common = F.size(F.array_intersect(predicted, gold))
    p, g = F.size(F.array_distinct(predicted)), F.size(F.array_distinct(gold))
    return F.when((p == 0) & (g == 0), 1.0).when((p == 0) | (g == 0) | (common == 0), 0.0).otherwise(2.0 * common / (p + g))


def paragraph_f1(predicted: Column, gold: Column) -> Column:
    """As set_f1, but no evidence at all, given and found, counts 1 and either alone 0."""
    return set_f1(predicted, gold)


def contains_answer(predicted: Column, golds: Column) -> Column:
    """1 if the normalised prediction holds any normalised gold answer."""
    return F.exists(golds, lambda g: F.contains(normalize_answer(predicted), normalize_answer(g))).cast("int")


def best_over_golds(predicted: Column, golds: Column) -> tuple[Column, Column]:
    """The accuracy and the F1 of a prediction, each with the gold answer that suits it best."""
    acc = F.array_max(F.transform(golds, lambda g: F.contains(normalize_answer(predicted), normalize_answer(g)).cast("double")))
    return acc, F.array_max(F.transform(golds, lambda g: token_f1(predicted, g)))


def normalize_numbers(text: Column) -> Column:
    """Parts between spaces and hyphens without punctuation and articles; numbers and number words as decimals."""
    table = F.create_map(*[x for k, v in NUMBER_WORDS.items() for x in (F.lit(k), F.lit(str(float(v)) if v < 10**7 else f"{v:.1f}"))])

    def part(t: Column) -> Column:
        t = F.lower(t)
        bare = F.when(is_number(t), t).otherwise(F.regexp_replace(t, PUNCTUATION, ""))
        number = F.when(is_number(bare), bare.try_cast("double").cast("string")).otherwise(F.coalesce(F.try_element_at(table, bare), bare))
        return F.array_join(split_words(F.regexp_replace(number, r"\b(a|an|the)\b", " ")), " ")

    return F.array_join(F.filter(F.transform(F.split(text, " |-"), part), lambda x: x != ""), " ")


def bag(text: Column) -> Column:
    return F.array_distinct(split_words(normalize_numbers(text)))


def numbers_agree(gold_bag: Column, predicted_bag: Column) -> Column:
    """Whether the gold bag holds no number, or one that the predicted bag holds too."""
    g, p = F.filter(gold_bag, is_number), F.filter(predicted_bag, is_number)
    return (F.size(g) == 0) | F.arrays_overlap(g, p)


def bag_f1(predicted_bag: Column, gold_bag: Column) -> Column:
    """F1 of two bags whose numbers agree, else 0."""
    common = F.size(F.array_intersect(gold_bag, predicted_bag))
    p = F.when(F.size(predicted_bag) == 0, 1.0).otherwise(common / F.size(predicted_bag))
    r = F.when(F.size(gold_bag) == 0, 1.0).otherwise(common / F.size(gold_bag))
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return F.when(numbers_agree(gold_bag, predicted_bag), f1).otherwise(0.0)


def list_em(predicted: Column, gold: Column) -> Column:
    """1 if two lists of answers have equal normalised members and lengths."""
    p, g = (F.transform(x, normalize_numbers) for x in (predicted, gold))
    return ((F.size(p) == F.size(g)) & (F.size(F.array_except(p, g)) == 0) & (F.size(F.array_except(g, p)) == 0)).cast("double")


def best_assignment(scores):
    """Row and column indices of the one-to-one assignment of greatest total, by successive shortest paths with potentials."""
    import numpy as np

    cost = -np.asarray(scores, float)
    flipped = cost.shape[0] > cost.shape[1]
    if flipped:
        cost = cost.T
    n, m = cost.shape
    u, v, owner = np.zeros(n), np.zeros(m + 1), np.full(m + 1, -1)
    for row in range(n):
        owner[m], at = row, m
        slack, via, done = np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool)
        while owner[at] >= 0:
            done[at] = True
            i = owner[at]
            reduced = cost[i] - u[i] - v[:m]
            better = ~done[:m] & (reduced < slack)
            slack[better], via[better] = reduced[better], at
            nxt = int(np.argmin(np.where(done[:m], np.inf, slack)))
            step = slack[nxt]
            u[owner[done]] += step
            v[done] -= step
            slack[~done[:m]] -= step
            at = nxt
        while at != m:
            owner[at] = owner[via[at]]
            at = via[at]
    cols = np.flatnonzero(owner[:m] >= 0)
    rows = owner[cols]
    return (cols, rows) if flipped else (rows, cols)


def f1_matrix(predicted_bags: Column, gold_bags: Column) -> Column:
    """bag_f1 of each gold bag (rows) with each predicted bag."""
    return F.transform(gold_bags, lambda g: F.transform(predicted_bags, lambda p: bag_f1(p, g)))


def with_list_f1(rows: DataFrame, matrix: str, out: str) -> DataFrame:
    """rows with the mean F1, to two places, under the best one-to-one alignment in a column of f1_matrix()."""
    import numpy as np

    def align(frames):
        for frame in frames:
            scores = []
            for m in frame[matrix]:
                s = np.array([list(r) for r in m], float).reshape(len(m), -1)
                scores.append(round(float(s[best_assignment(s)].sum()) / max(s.shape), 2))
            yield frame.drop(columns=matrix).assign(**{out: scores})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != matrix)
    return rows.mapInPandas(align, f"{kinds}, `{out}` double")


def gold_answer(info: Column) -> Column:
    """answer, type of an annotation struct (unanswerable, extractive_spans, free_form_answer, yes_no)."""
    spans, free = info["extractive_spans"], info["free_form_answer"]
    kind = F.when(info["unanswerable"], "none").when(F.size(spans) > 0, "extractive").when(F.length(free) > 0, "abstractive").when(info["yes_no"].isNotNull(), "boolean")
    answer = F.when(kind == "none", "Not answerable").when(kind == "extractive", F.array_join(spans, ", ")).when(kind == "abstractive", free).when(info["yes_no"], "Yes").when(~info["yes_no"], "No")
    return F.struct(answer.alias("answer"), kind.alias("type"))


def text_evidence(evidence: Column) -> Column:
    return F.filter(evidence, lambda e: ~e.contains("FLOAT SELECTED"))


def judged(text: Column, key: str) -> Column:
    """The value behind `key:` at the start of a line of a judge's output, in any case; empty if there is none."""
    return F.trim(F.regexp_extract(text, rf"(?im)^\s*\Q{key}\E\s*:[ \t]*(.*)$", 1))
