"""URL filtering: listed rules first, then logistic regression on hashed character n-grams of host and path.

The regression learns from a small labelled table of URLs (MAX_LABELLED rows at most, checked). Training is one row of
higher-order functions: the samples are an array, and a fold over epochs and samples moves an array of DIM weights.
The weights (DIM numbers) become a literal, so judging a table of any size is a projection without a shuffle.

Cases: a null URL or one without :// has an empty host and path, fits no rule and is judged by the model's bias alone;
very long URLs cost time in proportion; equal rows get equal results; an empty table gives an empty result; extra
columns are kept by filter_urls and dropped by the query.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm._common import ascii_lower, let

DIM = 2048
GRAMS = (3, 4, 5)
EPOCHS, RATE, DECAY = 8, 0.05, 1e-4
#: What a sample to be blocked counts against one to be allowed: there are fewer of them.
BLOCK_WEIGHT = 3.0
MAX_LABELLED = 5000
#: (verdict, host, path); a rule fits its host and all subdomains if the path begins with the rule's.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Words of the labelled table by topic, written down from general knowledge of what URL lists block; each is set in every template.
BAD_WORDS = (
    "casino poker roulette blackjack jackpot betting bookmaker gambling slots bingo lottery sportsbet wager "
    "viagra cialis pills steroids painkillers pharma weightloss diet-pill "
    "porn xxx sex nude naked escort adult erotic webcam hentai fetish hookup camgirls "
    "torrent warez cracked keygen serialkey nulled pirated leaks leaked "
    "phishing malware spyware ransomware trojan botnet hacked exploit-kit stolen-cards "
    "spam clickbait adserver adtracker popunder banner-ads linkfarm doorway bulkmail "
    "payday quickloan fastcash getrich pyramid forex-signals replica counterfeit fakeid"
).split()
GOOD_WORDS = (
    "news library museum science physics chemistry biology garden school university college research history weather maps "
    "recipes cooking travel hotel airport railway city council parliament government court law health hospital clinic medicine "
    "journal review archive wiki encyclopedia dictionary docs manual tutorial forum blog music concert orchestra art gallery "
    "film cinema theatre novel poetry author book bookshop sport football cycling running climbing nature forest mountain river "
    "ocean island energy solar water climate farm agriculture kitchen furniture house architecture building bridge engine "
    "software developer database network computer mathematics statistics geography language translation grammar philosophy "
    "religion church family children education teacher student exam career jobs business finance bank insurance market "
    "shop clothing shoes jewelry garden-centre photo camera video radio television magazine newspaper letter postcard "
    "animal bird horse dog cat fish insect flower tree bread coffee tea wine restaurant bakery market-hall festival "
    "north south east west summer winter spring autumn morning evening north-sea community society foundation charity volunteer "
    "transport bus bicycle car repair tools craft knitting pottery painting design fashion pattern colour paper stone glass"
).split()
#: Neutral syllables; their pairs are allowed hosts, so that a made-up name is not suspect in itself.
SYLLABLES = "ba ko lin mar ve sto dan fri gel hum pra wen".split()
TEMPLATES = ("https://www.{w}.com/", "http://{w}.org/about/team.html", "https://{w}online.info/page/12", "https://my-{w}.co/list?page=3", "https://portal.site.eu/{w}/item/2024")


def labelled_urls(spark: SparkSession, bad: Sequence[str] = tuple(BAD_WORDS), good: Sequence[str] = tuple(GOOD_WORDS), templates: Sequence[str] = TEMPLATES) -> DataFrame:
    """url, label (1: block): the words in the templates. Any table of these columns will do in its place."""
    good = (*good, *(a + b for a in SYLLABLES for b in SYLLABLES if a < b))
    rows = [(t.format(w=w), y) for y, ws in ((1, bad), (0, good)) for w in dict.fromkeys(ws) for t in templates]
    return spark.createDataFrame(rows, "url string, label int")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def gram_ids(host: Column, path: Column, dim: int = DIM) -> Column:
    """The distinct hashed n-grams of host and path, from 1 to dim; every digit counts as 0."""
    marked = F.concat(F.lit("^"), F.regexp_replace(host, "[0-9]", "0"), F.lit("$"), F.regexp_replace(F.lower(path), "[0-9]", "0"))
    chars = F.split(F.when((host == "") & (path == ""), F.lit("")).otherwise(marked), "")

    def grams(c: Column, n: int) -> Column:
        hashed = F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.pmod(F.xxhash64(*[F.get(c, i + k) for k in range(n)]), F.lit(dim)) + 1)
        return F.when(F.size(c) >= n, hashed).otherwise(F.array().cast("array<bigint>"))

    return let(chars, lambda c: F.array_distinct(F.concat(*[grams(c, n) for n in GRAMS])))


def train(labelled: DataFrame, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY) -> list[float]:
    """dim weights and a bias, last, by stochastic gradient descent over labelled (url, label) in an order fixed by hash."""
    if labelled.limit(MAX_LABELLED + 1).count() > MAX_LABELLED:
        raise ValueError(f"the labelled table has more than {MAX_LABELLED} rows: sample it first")
    host, path = host_and_path(F.col("url"))
    ids = labelled.where("url is not null and label is not null").select("url", F.col("label").cast("double").alias("y"), gram_ids(host, path, dim).alias("ids"))
    listed = ids.select(F.struct(F.xxhash64("url").alias("k"), "url", "y", "ids").alias("s")).agg(F.array_sort(F.collect_list("s")).alias("samples"))

    def dense(s: Column) -> Column:
        """A sample with a row of zeros and ones, and a one for the bias."""
        x = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.array_contains(s["ids"], i.cast("bigint")).cast("double"))
        return F.struct(s["y"].alias("y"), F.concat(x, F.array(F.lit(1.0))).alias("x"))

    def step(w: Column, s: Column) -> Column:
        z = F.aggregate(F.zip_with(w, s["x"], lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        push = F.array(F.lit(rate) * F.when(s["y"] > 0, BLOCK_WEIGHT).otherwise(1.0) * (s["y"] - 1 / (1 + F.exp(-z))))  # an array of one, so that it is computed once
        return F.get(F.transform(push, lambda g: F.zip_with(w, s["x"], lambda a, b: a * (1 - decay) + g * b)), 0)

    def fit(samples: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(epochs)), F.array_repeat(F.lit(0.0), dim + 1), lambda w, _: F.aggregate(samples, w, step))

    # Arrays of one, so that what stands in them is computed once and not in every round of a lambda.
    weights = F.get(F.transform(F.array(F.transform("samples", dense)), fit), 0)
    return list(listed.select(weights.alias("w")).first().w or [0.0] * (dim + 1))


def score(host: Column, path: Column, weights: Sequence[float]) -> Column:
    """The model's log odds of block."""
    w = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    return F.aggregate(gram_ids(host, path, len(weights) - 1), F.lit(float(weights[-1])), lambda a, i: a + F.element_at(w, i.cast("int")))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, at, begin in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(begin)
        name, verdict = F.when(fits, at + begin).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def filter_urls(pages: DataFrame, weights: Sequence[float], rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url") -> DataFrame:
    """pages with host, path, rule, url_score and verdict (block or allow)."""
    host, path = host_and_path(F.col(url))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return (
        pages.withColumn("host", host).withColumn("path", path).withColumn("rule", rule)
        .withColumn("url_score", score(F.col("host"), F.col("path"), weights))
        .withColumn("verdict", F.coalesce(verdict, F.when(F.col("url_score") > 0, "block").otherwise("allow")))
    )
