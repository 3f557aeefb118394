"""URL filter: host and path rules, then logistic regression on hashed character n-grams (native).

A rule has a host, a path prefix and a verdict; it fits its host and every
subdomain where the url's path starts with the prefix, and the longest rule wins
(at equal length the one that sorts last by text; block before allow for equal
rules).  Where no rule fits, a logistic regression decides.  It is trained on a
small labelled table (at most ``max_rows`` rows, ``MAX_LABELLED`` by default, all
of them used; more is an error) by stochastic gradient steps that are folded over
the rows inside one SQL expression.  The trained model, ``DIMENSIONS`` weights
whatever the number of pages, enters the scoring plan as a literal, so scoring is
a projection without shuffle or broadcast.

Defined results: a null url or one without ``://`` has an empty host and path and
fits no rule; its model features are empty, so the bias alone decides.  Extra
columns are ignored, repeated rows give repeated results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import let

DIMENSIONS = 1024
MAX_LABELLED = 2000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed values: (host, path prefix, verdict).
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]

#: A small labelled table; 1 is to be blocked.
LABELLED_URLS = [
    ("https://spam-farm.example.org/en/12", 1), ("http://spam-farm.example.com/buy/now", 1), ("https://cheap-pills.example.com/order/1", 1),
    ("https://casino-bonus.example.net/win", 1), ("http://free-casino.example.org/slots/88", 1), ("https://adult-cams.example.com/live", 1),
    ("https://xxx-videos.example.net/hot/4", 1), ("http://warez.example.org/crack/keygen", 1), ("https://torrent-crack.example.com/dl/9", 1),
    ("https://seo-links.example.net/backlinks/cheap", 1), ("http://clickbait-farm.example.com/you-wont-believe", 1), ("https://ad-tracker.example.net/click?id=4", 1),
    ("https://payday-loans.example.com/apply/now", 1), ("http://link-farm.example.org/page/3", 1), ("https://content-farm.example.net/a/44", 1),
    ("https://spam.example.com/offers/free", 1), ("http://viagra-shop.example.org/buy", 1), ("https://poker-casino.example.com/bet", 1),
    ("https://lottery-winner.example.net/claim", 1), ("http://spam-farm.example.net/de/4", 1), ("https://spamfarm.example.org/fr/3", 1),
    ("https://get-rich-quick.example.com/free-money", 1), ("https://pills-online.example.net/cheap", 1), ("http://bet-bonus.example.org/promo", 1),
    ("https://en.wiki.example.org/article/Spark", 0), ("https://docs.example.com/guide/install", 0), ("https://blog.example.com/2024/05/post", 0),
    ("https://news.example.net/world/2023", 0), ("https://m.news.example.org/fr/57", 0), ("https://www.example.com/about", 0),
    ("https://university.example.org/papers/12", 0), ("https://library.example.net/books/list", 0), ("https://api.example.com/v2/reference", 0),
    ("http://blog.travel.example.net/es/24", 0), ("https://cooking.example.com/recipes/33", 0), ("https://museum.example.org/collection/8", 0),
    ("https://forum.example.net/thread/1234", 0), ("http://science.example.com/de/100", 0), ("https://history.example.org/en/41", 0),
    ("https://weather.example.net/city/paris", 0), ("https://m.garden.example.com/fr/9", 0), ("https://code.example.org/repo/readme", 0),
    ("https://school.example.net/lessons/7", 0), ("http://health.example.org/guide/sleep", 0), ("https://sports.example.com/results/2", 0),
    ("https://radio.example.net/programme/en", 0), ("https://maps.example.org/de/12.html", 0), ("https://music.example.com/album/5", 0),
]


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as a struct (``size, rule, verdict``), or null.

    Rules are grouped by host in a literal map, looked up for each suffix of the
    host; a few thousand rules fit, beyond that keep the rules in a table and join.
    """
    by_host: dict[str, list] = {}
    for h, p, v in rules:
        by_host.setdefault(h, []).append(F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(p).alias("path")))
    if not by_host:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string,path:string>")
    table = F.create_map(*[x for h, found in by_host.items() for x in (F.lit(h), F.array(*found))])
    labels = F.split(host, "\\.")
    longest = max(h.count(".") + 1 for h in by_host)
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - longest + 1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.lit(longest)), "."))
    fitting = F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(table, s)), lambda x: x.isNotNull()))
    return F.array_max(F.filter(fitting, lambda r: F.startswith(path, r["path"])))


def _bucket(tag: int, text: Column, n: int, dimensions: int):
    return lambda i: F.pmod(F.xxhash64(F.lit(tag), F.substring(text, i, F.lit(n))), F.lit(dimensions)).cast("int")


def features(host: Column, path: Column, dimensions: int = DIMENSIONS, lengths=(3, 4)) -> Column:
    """Distinct buckets (from 0) of hashed character n-grams of ``^host$`` and ``^path$``."""
    parts = []
    for tag, text in ((1, F.concat(F.lit("^"), host, F.lit("$"))), (2, F.concat(F.lit("^"), path, F.lit("$")))):
        for n in lengths:
            starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
            parts.append(F.transform(starts, _bucket(tag, text, n, dimensions)))
    return F.array_distinct(F.concat(*parts))


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "label", dimensions: int = DIMENSIONS, epochs: int = 30, rate: float = 0.5, penalty: float = 1e-4, max_rows: int = MAX_LABELLED) -> list[float]:
    """Weights of the logistic regression, the bias last; rows with a null label are left out.

    Rows are visited in an order fixed by a hash of the url, so reruns agree.
    """
    rows = labelled.where(F.col(label_col).isNotNull()).select(host_of(F.col(url_col)).alias("h"), path_of(F.col(url_col)).alias("p"), F.col(label_col).cast("double").alias("y"), F.col(url_col).alias("u"))
    if rows.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"more than {max_rows} labelled urls; raise max_rows")
    sparse = rows.select(F.struct(F.xxhash64("u").alias("k"), "u", "y", features(F.col("h"), F.col("p"), dimensions).alias("f")).alias("row"))
    dense = sparse.select(
        F.struct("row.k", "row.u", "row.y", F.size("row.f").alias("n"), F.concat(F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.when(F.array_contains("row.f", i), 1.0).otherwise(0.0) / F.sqrt(F.size("row.f"))), F.array(F.lit(1.0))).alias("x")).alias("row")
    )
    data = dense.agg(F.array_sort(F.collect_list("row")).alias("rows"))

    def step(w, row):
        z = F.aggregate(F.zip_with(w, row["x"], lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        return let(F.lit(rate) * (row["y"] - 1.0 / (1.0 + F.exp(-z))), lambda g: F.zip_with(w, row["x"], lambda a, b: a * (1.0 - rate * penalty) + g * b))

    zero = F.array_repeat(F.lit(0.0), dimensions + 1)
    folded = F.aggregate(F.sequence(F.lit(1), F.lit(epochs)), zero, lambda w, _: F.aggregate(F.col("rows"), w, step))
    return [float(x) for x in data.select(folded.alias("w")).first()["w"]]


def score(host: Column, path: Column, weights: list[float]) -> Column:
    """Probability that the url is to be blocked."""
    found, table = features(host, path, len(weights) - 1), F.lit(weights)
    total = let(found, lambda f: F.aggregate(f, F.lit(0.0), lambda a, i: a + F.get(table, i)) / F.sqrt(F.size(f)))
    return 1.0 / (1.0 + F.exp(-(total + weights[-1])))


def judge(pages: DataFrame, weights: list[float], id_col: str = "page_id", url_col: str = "url", rules=RULES, threshold: float = 0.5) -> DataFrame:
    """``page_id, host, path, rule, score, verdict``: the rule's verdict, else the model's."""
    split = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    ruled = split.select("*", match_rule(F.col("host"), F.col("path"), rules).alias("__r"), score(F.col("host"), F.col("path"), weights).alias("score"))
    by_model = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return ruled.select("page_id", "host", "path", F.col("__r.rule").alias("rule"), "score", F.coalesce(F.col("__r.verdict"), by_model).alias("verdict"))


def labelled_table(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{u}', {y})" for u, y in LABELLED_URLS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(url, label)")
