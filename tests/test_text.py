"""Text functions on worked examples, and chunking against plain loops."""

import math
import re
import uuid

import pytest
from pyspark.sql import functions as F

from sylva.functions import scores as S
from sylva.functions import text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("text", "cut"),
    [
        ("The quick brown fox jumps over the lazy dog and", True), ('He said, "This method is the best."', False), ("Short title here", False),
        ("The quick brown fox jumps over the lazy dog and.", True), ("A list of things that we shall need:", True), ("It was cut in the middle of a wo-", True), (None, False), ("", False),
    ],
)
def test_incomplete_paragraph(spark, text, cut):
    assert one(spark, text, T.is_incomplete_paragraph) is cut


def test_small_repairs(spark):
    assert one(spark, "state-   of", T.fix_dashes) == "state-of"
    assert one(spark, ["exam-", "ple text"], T.join_hyphenated, "array<string>") == "example text"
    assert one(spark, "good words here now then " + "t " * 20, T.cut_ocr_noise).startswith("good")
    assert one(spark, "&lt;b&gt; A&amp;B \x07 ok!", T.clean) == "b  a b  ok"
    assert one(spark, " ".join(map(str, range(101))), T.first_words).split()[-1] == "99"
    assert one(spark, "LLM is", T.begins_with_acronym) and not one(spark, "This is", T.begins_with_acronym)
    assert one(spark, "example.com", T.uuid5) == str(uuid.uuid5(uuid.NAMESPACE_DNS, "example.com"))


def plain_chunks(text, budget):
    out, held, n = [], "", 0
    for s in [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s]:
        ws = s.split()
        if len(ws) > budget:
            if n:
                out.append(held)
            held, n = "", 0
            out += [" ".join(ws[i : i + budget]) for i in range(0, len(ws), budget)]
        elif n + len(ws) > budget:
            out, held, n = out + [held], s, len(ws)
        else:
            held, n = (f"{held} {s}" if n else s), n + len(ws)
    return out + [held] if n else out


def test_chunks(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", T.chunks(F.col("text"), 40).alias("c")).collect()
    for r in docs:
        assert r.c == plain_chunks(r.text, 40)
    assert one(spark, "", lambda c: T.chunks(c, 5)) == []


def test_scores(spark):
    pair = spark.createDataFrame([("kitten", "sitting"), ("abcd", "abxy"), ("", "")], "g string, p string")
    assert [round(r.a, 6) for r in pair.select(S.anls(F.col("g"), F.col("p")).alias("a")).collect()] == [0.571429, 0.0, 1.0]
    f1 = spark.createDataFrame([("the cat sat", "cat sat down")], "p string, g string").select(S.token_f1(F.col("p"), F.col("g")).alias("f")).first().f
    assert math.isclose(f1, 0.8)
    eq = spark.createDataFrame([(5.0, 0.05), (5.0, 500.0), (5.0, 7.0)], "g double, p double").select(S.numbers_equal(F.col("g"), F.col("p"), True).alias("e")).collect()
    assert [r.e for r in eq] == [True, True, False]
    typed = spark.createDataFrame([("5", "5.7", "Int"), ("[\"a\", 'b']", "['b', 'a']", "List"), ("x@y.com", "x@y.org", "Str"), ("12", "abc", "Float")], "g string, p string, k string")
    assert [r.s for r in typed.select(S.typed_score(F.col("g"), F.col("p"), F.col("k")).alias("s")).collect()] == [1.0, 1.0, 0.0, 0.0]
    assert one(spark, "The twenty-one 3,000 cats", S.normalize_numbers) == "20.0 1.0 3000.0 cats"
    assert one(spark, "extracted_answer: 12\nanswer_format: Int", lambda c: S.judged(c, "answer_format")) == "Int"


def test_best_assignment():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    for shape in [(3, 3), (2, 4), (4, 2), (1, 1), (5, 3)]:
        m = rng.random(shape)
        r, c = S.best_assignment(m)
        small, large = sorted(shape)
        wide = m if shape[0] <= shape[1] else m.T
        best = max(sum(wide[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))
        assert len(r) == small and math.isclose(m[r, c].sum(), best)
