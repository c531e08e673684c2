"""Personal data by fixed patterns, and further identifiers by bootstrapped contextual extraction.

Base kinds (email, ip, card, phone) are regular expressions with checks. They and tokens shaped like keys are the seeds
of a bootstrap: a cue is a name and a sign before a slot (`password=`, `token = "`, `contact: `), and each occurrence of
a cue, whatever fills its slot, is an edge between a pattern (the cue) and an instance (the filler). Seeds are instances
of score 1. In each round a pattern scores the mean of its distinct instances, if it has at least SUPPORT of score
CONFIDENT or more, and an instance then scores the noisy or of its patterns that reach CONFIDENT. Fillers that hold a
digit or an @ and follow a pattern of the last round become spans of kind `id`, unless they overlap a base span.

Scoring runs over a table of distinct edges, aggregated before it is shuffled. The confident patterns, all of them, are the
model; they alone reach the driver and become a hash set in the second pass, which like the first is a projection. Seeds are
identifiers by their shape and are reported wherever they stand: base kinds by name, keys as `id`.

The expressions match as leftmost search would, but without backtracking: a run of letters or digits is tried
once and not at each of its places, so time is linear in a text of any length.

Cases: null and blank texts have no spans (and the hash of an empty list); equal rows get equal results; an empty table
gives an empty result and no patterns; a name of more than 64 characters is no cue, while fillers and keys are
found whole at any length; redact() keeps extra columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.llm._common import let, stage_table

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KEY = r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|(?=[0-9]*+[a-f])(?=[a-f]*+[0-9])[0-9a-f]{16,}+)(?![A-Za-z0-9])"
CUE = r"(?<![A-Za-z0-9_-])([A-Za-z][A-Za-z0-9_-]{1,63}+\x20{0,2}[=:#]\x20{0,2}[\"']?)((?:[A-Za-z0-9]|\+[0-9])[^\s\"',;<>]{3,}+)"
#: What ends a sentence is cut from the end of a filler, by trimming: a pattern bound to the end is tried at each place.
STOPS = ".:!?)"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

ROUNDS = 3
SUPPORT = 3
CONFIDENT = 0.8
BLOCK = 512

SPAN = "struct<s:bigint,e:bigint,m:string>"


def _none(kind: str = f"array<{SPAN}>") -> Column:
    return F.array().cast(kind)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    number = F.reverse(digits)
    value = lambda i: F.substring(number, i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + F.when(value(i) > 9, value(i) - 9).otherwise(value(i)))
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        digits = F.regexp_replace(m, "[^0-9]", "")
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


#: Base kinds in the order in which spans are listed, their patterns, and what a text must contain to hold one.
KINDS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
_NEEDS = {"email": "@", "phone": "+"}


def _may_hold(text: Column, kind: str) -> Column:
    if kind == "cue":
        return text.contains("=") | text.contains(":") | text.contains("#")
    if kind in _NEEDS:
        return text.contains(_NEEDS[kind])
    return F.col("_digit")


def _matches(text: Column, kind: str, pattern: str) -> tuple[Column, Column]:
    """The matches in a text, and the text before each (and behind the last, which zips leave out)."""
    there = _may_hold(text, kind)
    found = F.when(there, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(_none("array<string>"))
    between = F.when(there, F.split(text, pattern, -1)).otherwise(F.array(text))
    return found, between


def _placed(found: Column, between: Column) -> Column:
    """Spans (s, e, m) of matches: places add up in blocks of BLOCK matches, so that cost stays nearly linear."""
    items = F.zip_with(found, F.slice(between, 1, F.greatest(F.size(found), F.lit(1))), lambda m, p: F.struct(F.length(p).cast("long").alias("p"), F.length(m).cast("long").alias("l"), m.alias("m")))
    blocks = let(items, lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda b: F.slice(xs, b * BLOCK + 1, BLOCK)))
    start = F.struct(F.lit(0).cast("long").alias("at"), _none().alias("out"))

    def add(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["p"]
        return F.struct((s + x["l"]).alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), (s + x["l"]).alias("e"), x["m"].alias("m")))).alias("out"))

    def shift(acc: Column, b: Column) -> Column:
        moved = F.transform(b["out"], lambda x: F.struct((x["s"] + acc["at"]).alias("s"), (x["e"] + acc["at"]).alias("e"), x["m"].alias("m")))
        return F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], moved).alias("out"))

    return F.when(F.size(found) > 0, F.aggregate(F.transform(blocks, lambda b: F.aggregate(b, start, add)), start, shift)["out"]).otherwise(_none())


def _listed(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat(F.lit(f"{kind}:"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string")))


def _spans(rows: DataFrame, kind: str, pattern: str, text: str = "_t") -> DataFrame:
    """rows with the spans of a kind in `_kind`."""
    found, between = _matches(F.col(text), kind, pattern)
    rows = rows.withColumn("_f", found).withColumn("_b", between)
    return rows.withColumn(f"_{kind}", F.filter(_placed(F.col("_f"), F.col("_b")), lambda x: _valid(kind, x["m"]))).drop("_f", "_b")


def _prepared(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).withColumn("_digit", F.col("_t").rlike("[0-9]"))


def cue_edges(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct edges: pattern, instance, and whether the instance is a seed."""
    rows = _prepared(docs.select(text), text).where(_may_hold(F.col("_t"), "cue"))
    found = F.regexp_extract_all("_t", F.lit(CUE), F.lit(0))
    edges = (
        rows.select(F.explode(found).alias("m"))
        .select(F.lower(F.regexp_extract("m", CUE, 1)).alias("pattern"), F.rtrim(F.regexp_extract("m", CUE, 2), F.lit(STOPS)).alias("instance"))
        .groupBy("pattern", "instance").count().drop("count")
    )
    seed = F.lit(False)
    for kind, pattern in KINDS.items():
        whole = F.regexp_extract("instance", pattern, 0)
        seed = seed | ((whole != "") & (whole == F.col("instance")) & F.coalesce(_valid(kind, whole), F.lit(False)))
    return edges.withColumn("seed", seed | F.col("instance").rlike(f"^{KEY}$"))


def bootstrap(edges: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confident: float = CONFIDENT) -> DataFrame:
    """pattern, score, support: the patterns of the last round that reach `confident`, from edges of cue_edges()."""
    edges = stage_table(edges, "cue-edges")
    scored = edges.withColumn("score", F.col("seed").cast("double"))
    best = None
    for n in range(rounds):
        known = F.col("score") >= confident
        best = scored.groupBy("pattern").agg(F.avg("score").alias("conf"), F.sum(known.cast("int")).alias("support")).where((F.col("support") >= support) & (F.col("conf") >= confident))
        best = stage_table(best, f"cue-patterns-{n}")
        if n + 1 < rounds:
            miss = F.exp(F.sum(F.log(F.greatest(1 - F.col("conf"), F.lit(1e-9)))))
            # Only instances that a good pattern touches change; the others keep their seed score.
            reached = edges.join(best, "pattern").groupBy("instance").agg((1 - miss).alias("found"))
            scored = stage_table(edges.join(reached, "instance", "left").withColumn("score", F.greatest(F.col("seed").cast("double"), F.coalesce("found", F.lit(0.0)))).drop("found"), f"cue-scored-{n}")
    return best.withColumnRenamed("conf", "score")


def learn(docs: DataFrame, text: str = "text") -> list[str]:
    """The patterns that docs teach: all that are confident in the last round, aggregated names with their mark."""
    return sorted(r.pattern for r in bootstrap(cue_edges(docs, text)).select("pattern").collect())


def find(docs: DataFrame, patterns: Sequence[str], text: str = "text") -> DataFrame:
    """docs with `_email`, `_ip`, `_card`, `_phone` and `_id`: arrays of spans (s, e, m)."""
    rows = _prepared(docs, text)
    for kind, pattern in KINDS.items():
        rows = _spans(rows, kind, pattern)
    rows = _spans(_spans(rows, "key", KEY), "cue", CUE)

    def filler(x: Column) -> Column:
        m = F.rtrim(F.regexp_extract(x["m"], CUE, 2), F.lit(STOPS))
        s = x["s"] + F.length(F.regexp_extract(x["m"], CUE, 1))
        return F.struct(s.alias("s"), (s + F.length(m)).alias("e"), m.alias("m"))

    known = F.filter("_cue", lambda x: F.lower(F.regexp_extract(x["m"], CUE, 1)).isin(*patterns) & F.regexp_extract(x["m"], CUE, 2).rlike("[0-9@]")) if patterns else _none()
    rows = rows.withColumn("_base", F.concat(*[F.col(f"_{k}") for k in KINDS])).withColumn("_more", F.concat(F.transform(known, filler), F.col("_key")))
    clear = lambda x, others: ~F.exists(others, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))
    rows = rows.withColumn("_more", F.array_sort(F.array_distinct(F.filter("_more", lambda x: clear(x, F.col("_base"))))))
    # Of overlapping finds the first, and the longer of two that begin together.
    return rows.withColumn("_id", F.filter("_more", lambda x: ~F.exists(F.col("_more"), lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]) & ((y["s"] < x["s"]) | ((y["s"] == x["s"]) & (y["e"] > x["e"])))))).drop("_base", "_more", "_key", "_cue")


def report(docs: DataFrame, patterns: Sequence[str], text: str = "text") -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone, n_id, base_sha256 and spans."""
    rows = find(docs, patterns, text)
    listed = [_listed(k, F.col(f"_{k}")) for k in KINDS]
    rows = rows.withColumns({f"n_{k}": F.size(f"_{k}").cast("long") for k in (*KINDS, "id")})
    rows = rows.withColumn("base_sha256", F.sha2(F.array_join(F.concat(*listed), ","), 256)).withColumn("spans", F.array_join(F.concat(*listed, _listed("id", F.col("_id"))), ","))
    return rows.drop("_t", "_digit", *[f"_{k}" for k in (*KINDS, "id")])


def redact(docs: DataFrame, patterns: Sequence[str], text: str = "text") -> DataFrame:
    """docs with every identifier in text replaced by its kind in angle brackets.

    A text is put together again from its matches and what stands between them, kind after kind.
    """
    rows = _prepared(docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text")), "_text")
    def masked(kind: str):
        return lambda m: F.when(_valid(kind, m), f"<{kind}>").otherwise(m)

    passes = [(k, p, masked(k)) for k, p in KINDS.items()]
    passes.append(("key", KEY, lambda m: F.lit("<id>")))
    if patterns:
        tail = lambda m: F.substr(m, F.length(F.rtrim(m, F.lit(STOPS))) + 1)
        known = lambda m: F.lower(F.regexp_extract(m, CUE, 1)).isin(*patterns) & F.regexp_extract(m, CUE, 2).rlike("[0-9@]")
        passes.append(("cue", CUE, lambda m: F.when(known(m), F.concat(F.regexp_extract(m, CUE, 1), F.lit("<id>"), tail(m))).otherwise(m)))
    for kind, pattern, put in passes:
        found, between = _matches(F.col("_t"), kind, pattern)
        rows = rows.withColumn("_f", found).withColumn("_b", between)
        joined = F.array_join(F.flatten(F.zip_with("_b", F.transform("_f", put), lambda b, m: F.array(b, F.coalesce(m, F.lit(""))))), "")
        rows = rows.withColumn("_t", F.when(F.size("_f") > 0, joined).otherwise(F.col("_t"))).drop("_f", "_b")
    new = F.when(F.col("_text").isNotNull(), F.col("_t")).alias(text)
    return rows.select(*[new if c == text else F.col("_row")[c].alias(c) for c in docs.columns])
