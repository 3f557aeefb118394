"""Retrieval and answer metrics over ranked results and gold sets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranking_metrics(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """``query_id, item, rank`` and ``query_id, item`` → recall at 5 and 10, reciprocal rank and nDCG at 10.

    Null without gold, 0 on a miss; only a query's first occurrence of an item counts.
    """
    first = ranked.groupBy("query_id", "item").agg(F.min("rank").alias("rank"))
    hits = gold.distinct().join(first, ["query_id", "item"], "left")
    gain = F.when(F.col("rank") <= 10, F.log(F.lit(2.0)) / F.log(F.col("rank") + 1.0)).otherwise(0.0)
    per = hits.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("rank") <= 5).alias("h5"), F.count_if(F.col("rank") <= 10).alias("h10"), F.min(F.when(F.col("rank") <= 10, F.col("rank"))).alias("best"), F.sum(gain).alias("dcg")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(10)).cast("int")), F.lit(0.0), lambda a, k: a + F.log(F.lit(2.0)) / F.log(k + 1.0))
    all_queries = ranked.select("query_id").union(gold.select("query_id")).distinct()
    return all_queries.join(per, "query_id", "left").select(
        "query_id", F.round(F.col("h5") / F.col("n"), 6).alias("recall_5"), F.round(F.col("h10") / F.col("n"), 6).alias("recall_10"),
        F.when(F.col("n").isNotNull(), F.round(F.coalesce(1.0 / F.col("best"), F.lit(0.0)), 6)).alias("rr_10"), F.round(F.col("dcg") / ideal, 6).alias("ndcg_10"),
    )


def anchor_recall(anchors: DataFrame, evidence: DataFrame, k: int) -> DataFrame:
    """Share of a query's anchor texts that stand in evidence of the same item within the first ``k`` ranks."""
    from strandline.functions.text import nfkc_fold

    fold = nfkc_fold()
    near = evidence.where(F.col("rank") <= k).select("query_id", "item", fold("text").alias("text"))
    found = anchors.select("query_id", "item", fold("anchor").alias("anchor")).join(near, ["query_id", "item"], "left")
    per = found.groupBy("query_id", "item", "anchor").agg(F.max(F.coalesce(F.contains("text", "anchor"), F.lit(False))).alias("hit"))
    return per.groupBy("query_id").agg(F.round(F.avg(F.col("hit").cast("int")), 6).alias(f"anchor_recall_{k}"))


def latency_summary(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Count, nearest-rank percentiles, extremes and mean."""
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})").alias(f"p{round(q * 100)}")
    return df.groupBy(*by).agg(F.count(value).alias("n"), p(0.5), p(0.95), p(0.99), F.min(value).alias("min"), F.max(value).alias("max"), F.round(F.avg(value), 6).alias("mean"))


def page_metrics(hits: Column, gold: Column) -> list[Column]:
    """Any and all gold pages hit, and their coverage, from two arrays of pages."""
    both = F.size(F.array_intersect(hits, gold))
    n = F.size(F.array_distinct(gold))
    return [(both > 0).alias("any_page"), ((both == n) & (n > 0)).alias("all_pages"), F.when(n > 0, F.round(both / n, 6)).alias("coverage")]


def token_coverage(left: DataFrame, right: DataFrame) -> DataFrame:
    """``pair, token`` on both sides → length-weighted share of the left's token multiset that the right has."""
    count = lambda df, name: df.groupBy("pair", "token").agg(F.count(F.lit(1)).alias(name))
    both = count(left, "a").join(count(right, "b"), ["pair", "token"], "left")
    size = F.length("token")
    return both.groupBy("pair").agg(F.round(F.sum(size * F.least("a", F.coalesce("b", F.lit(0)))) / F.sum(size * F.col("a")), 6).alias("coverage"))


def quota_sample(rows: DataFrame, stratum: str, quotas: dict[str, int], seed: str, *key: str) -> DataFrame:
    """The first rows of each stratum in a deterministic random order, as many as its quota."""
    from strandline.functions.hashing import hash_order

    table = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    order = Window.partitionBy(stratum).orderBy(hash_order(seed, *[F.col(k) for k in key]))
    return rows.where(F.col(stratum).isin(*quotas)).withColumn("n", F.row_number().over(order)).where(F.col("n") <= F.element_at(table, F.col(stratum)))


def compare_runs(a: DataFrame, b: DataFrame, key: str, *metrics: str) -> DataFrame:
    """Difference of two runs by case; null where one of them has none."""
    both = a.alias("a").join(b.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    return both.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *[F.round(F.col(f"b.{m}") - F.col(f"a.{m}"), 6).alias(f"delta_{m}") for m in metrics])


def same_content_gold(gold: DataFrame, items: DataFrame) -> DataFrame:
    """Gold widened to all items of equal content (``item, sha``)."""
    return gold.join(items, "item").select("query_id", "sha").distinct().join(items, "sha").select("query_id", "item")


def page_mapping(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """``document, physical, label`` and ``document, printed`` → ``document, printed, physical, error``.

    A printed page maps to the one physical page that bears it as its label; a label
    that no page or several pages bear is refused, with the pages in the error.
    """
    bearing = pages.groupBy("document", F.col("label").alias("printed")).agg(F.count(F.lit(1)).alias("n"), F.min("physical").alias("first"))
    found = wanted.select("document", "printed").distinct().join(bearing, ["document", "printed"], "left")
    n = F.coalesce("n", F.lit(0))
    return found.select("document", "printed", F.when(n == 1, F.col("first")).alias("physical"), F.when(n != 1, F.concat(F.lit("label on "), n.cast("string"), F.lit(" pages"))).alias("error"))


def normalized_answers():
    """Arrow function: without ``[E1]`` marks, NFKC, case folded, only word characters, ``.`` and ``%``."""
    @F.pandas_udf("string")
    def run(xs: pd.Series) -> pd.Series:
        return xs.map(normalized_answer)

    return run


def normalized_answer(x: str | None) -> str:
    import re
    import unicodedata

    bare = re.sub(r"(?i)\[E\d+\]", " ", x or "")
    return re.sub(r"[^\w.%]+", "", unicodedata.normalize("NFKC", bare).casefold())


def assess_answers(cases: DataFrame) -> DataFrame:
    """``case_id, format, reference, items, answer`` → ``case_id, matched, item_recall, in_order``.

    Numbers match if the reference's first number is among the answer's; texts if one
    holds the other; a list (its ``items``) if the answer holds every item, in order if the items'
    first places do not fall.  Without an answer nothing matches.
    """
    from strandline.functions.text import numbers

    norm = normalized_answers()
    flat = cases.select("case_id", "format", "reference", "answer", norm("reference").alias("r"), norm("answer").alias("a"))
    items = cases.where(F.col("format") == "List").select("case_id", F.posexplode("items").alias("n", "item"), "answer")
    places = items.select("case_id", "n", norm("item").alias("i"), norm("answer").alias("a")).select("case_id", "n", F.when(F.col("i") == "", 0).otherwise(F.instr("a", F.col("i")) - 1).alias("at"))
    order = Window.partitionBy("case_id").orderBy("n")
    lists = places.withColumn("falls", F.col("at") < F.lag("at").over(order)).groupBy("case_id").agg(F.avg((F.col("at") >= 0).cast("double")).alias("recall"), F.max(F.coalesce("falls", F.lit(False))).alias("falls"))
    rows = flat.join(lists, "case_id", "left")
    given = F.length(F.coalesce("answer", F.lit(""))) > 0
    decimal = lambda xs: F.transform(xs, lambda n: n.cast("decimal(38,18)"))
    number = F.get(decimal(numbers(F.col("reference"))), 0)
    of_number = F.coalesce(F.array_contains(decimal(numbers(F.col("answer"))), number), F.lit(False))
    of_text = (F.length("r") > 0) & (F.contains("a", "r") | F.contains("r", "a"))
    listed = F.col("format") == "List"
    whole = F.coalesce(F.col("recall") == 1, F.lit(False))
    return rows.select(
        "case_id", (given & F.when(F.col("format").isin("Int", "Float"), of_number).when(listed, whole).otherwise(of_text)).alias("matched"),
        F.when(listed, F.when(given, F.round("recall", 6)).otherwise(0.0)).alias("item_recall"), F.when(listed, given & whole & ~F.col("falls")).alias("in_order"),
    )


def citation_metrics(cases: DataFrame, citations: DataFrame) -> DataFrame:
    """``case_id, document, pages`` (the gold) and ``case_id, document, page`` → what each case's citations hit."""
    hits = citations.join(cases.select("case_id", F.col("document").alias("gold"), "pages"), "case_id")
    own = F.col("document") == F.col("gold")
    per = hits.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.max(own).alias("own"), F.collect_set(F.when(own & F.array_contains("pages", F.col("page")), F.col("page"))).alias("hit"))
    rows = cases.select("case_id", F.array_distinct("pages").alias("pages")).join(per, "case_id", "left")
    hit = F.size(F.coalesce("hit", F.array().cast("array<int>")))
    return rows.select(
        "case_id", F.coalesce("n", F.lit(0)).alias("citations"), F.coalesce("own", F.lit(False)).alias("relevant_document"), (hit > 0).alias("any_gold_page"),
        F.round(hit / F.size("pages"), 6).alias("page_coverage"), (hit == F.size("pages")).alias("all_gold_pages"),
    )


def normal_mode(responses: DataFrame, mode: str = "HYBRID") -> DataFrame:
    """Responses whose metrics count: the request succeeded, undegraded, in the wanted mode, and was measured."""
    return responses.where(F.col("ok") & ~F.coalesce("degraded", F.lit(False)) & (F.col("executed_mode") == mode) & F.col("measured"))


def answer_summary(responses: DataFrame, metrics: DataFrame, by: str = "run") -> DataFrame:
    """Rates over all requests of a run: what failed or was degraded scores zero.

    ``responses``: ``run, case_id, ok, degraded, executed_mode, measured, status, attempts``.
    """
    normal = normal_mode(responses).join(metrics, "case_id", "left")
    yes = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    good = normal.groupBy(by).agg(yes(F.col("status") == "ANSWERED", "answered"), yes(F.col("status") == "INSUFFICIENT_EVIDENCE", "refused"), yes(F.col("relevant_document"), "relevant"), yes(F.col("any_gold_page"), "any_page"), yes(F.col("all_gold_pages"), "all_pages"), F.sum("page_coverage").alias("coverage"), F.count(F.lit(1)).alias("normal"))
    per = responses.groupBy(by).agg(F.count(F.lit(1)).alias("requests"), F.count_if("ok").alias("successes"), F.count_if(F.col("ok") & F.col("degraded")).alias("degraded"), F.sum(F.greatest(F.lit(0), F.col("attempts") - 1)).alias("retries"))
    share = lambda c: F.round(F.coalesce(c, F.lit(0)) / F.col("requests"), 6).alias(f"{c}_rate")
    return per.join(good, by, "left").select(by, "requests", "successes", F.coalesce("normal", F.lit(0)).alias("normal"), "degraded", "retries", *[share(c) for c in ("answered", "refused", "relevant", "any_page", "all_pages", "coverage")])


#: Fixed values of the source data set.
NOT_ANSWERABLE, ANSWER_FORMATS, PURE_TEXT = "Not answerable", ("Str", "Int", "Float", "List"), "Pure-text (Plain-text)"


def candidate_kind(cases: DataFrame) -> DataFrame:
    """Cases (``answer, format, pages, sources``) with ``kind``: usable as answerable, as unanswerable, or null.

    Answerable ones have an answer of a known format whose evidence has pages and is
    plain text alone; unanswerable ones say so and have no evidence and no format.
    """
    none = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) == 0
    pages = F.col("pages").cast("array<string>")
    yes = (F.col("answer") != NOT_ANSWERABLE) & F.coalesce(F.col("format").isin(*ANSWER_FORMATS), F.lit(False)) & ~none(pages) & F.col("sources").eqNullSafe(F.array(F.lit(PURE_TEXT)))
    no = (F.col("answer") == NOT_ANSWERABLE) & none(pages) & none(F.col("sources")) & F.col("format").isNull()
    return cases.select("*", F.when(yes, "ANSWERABLE").when(no, "UNANSWERABLE").alias("kind"))


def answer_checks(cases: DataFrame, citations: DataFrame, anchors: DataFrame) -> DataFrame:
    """``case_id, answerable, status`` → whether the status is right, how many citations hold an anchor of their document, and made-up citations of a refusal.

    ``citations``: ``case_id, n, document, text``; ``anchors``: ``case_id, document, anchor``.  Texts are compared folded.
    """
    from strandline.functions.text import nfkc_fold

    fold = nfkc_fold()
    cited = citations.select("case_id", "n", "document", fold("text").alias("text"))
    wanted = anchors.select("case_id", "document", fold("anchor").alias("anchor"))
    valid = cited.join(wanted, ["case_id", "document"], "left").groupBy("case_id", "n").agg(F.max(F.coalesce(F.contains("text", "anchor"), F.lit(False))).alias("valid"), F.max(F.col("anchor").isNotNull()).alias("own"))
    per = valid.groupBy("case_id").agg(F.count(F.lit(1)).alias("citations"), F.count_if("valid").alias("valid"), F.max("own").alias("own"))
    rows = cases.join(per, "case_id", "left")
    n = F.coalesce("citations", F.lit(0))
    expected = F.when(F.col("answerable"), "ANSWERED").otherwise("INSUFFICIENT_EVIDENCE")
    return rows.select("case_id", F.coalesce(F.col("status") == expected, F.lit(False)).alias("status_correct"), n.alias("citations"), F.coalesce("valid", F.lit(0)).alias("valid_citations"), F.coalesce("own", F.lit(False)).alias("relevant_document"), F.coalesce((F.col("status") == "INSUFFICIENT_EVIDENCE") & (n > 0), F.lit(False)).alias("fabricated"))


def hits_at(ranked: DataFrame, gold: DataFrame, cuts=(1, 3, 5, 10)) -> DataFrame:
    """Whether a gold document of a query is among the first 1, 3, 5 and 10; null without gold."""
    first = ranked.groupBy("query_id", "item").agg(F.min("rank").alias("rank"))
    best = gold.distinct().join(first, ["query_id", "item"], "left").groupBy("query_id").agg(F.min("rank").alias("best"))
    every = ranked.select("query_id").union(gold.select("query_id")).distinct()
    found = gold.select("query_id", F.lit(True).alias("has")).distinct()
    rows = every.join(found, "query_id", "left").join(best, "query_id", "left")
    return rows.select("query_id", *[F.when(F.col("has"), F.coalesce(F.col("best") <= n, F.lit(False))).alias(f"hit_{n}") for n in cuts])


def corrected_metrics(ranked: DataFrame, gold: DataFrame, items: DataFrame) -> DataFrame:
    """Ranking metrics where a document of the same content (``item, sha``) counts as the gold one.

    A content is one document: its first copy in a ranking is the hit, so copies of the gold add nothing to what is to be found.
    """
    named = lambda df: df.join(items, "item", "left").withColumn("item", F.coalesce(F.col("sha"), F.col("item").cast("string")))
    return ranking_metrics(named(ranked).select("query_id", "item", "rank"), named(gold).select("query_id", "item"))


def select_cases(candidates: DataFrame, quotas: dict[str, dict[str, int]], seed: str) -> DataFrame:
    """``case, document, domain, label`` → the selected cases, with their ``step`` and place ``n`` in it.

    Label after label, and domain after domain as ``quotas`` names them, cases are taken
    in a random order that depends on the seed alone; first those of documents that no
    case was taken of, one each, then any others until the quota is full.  A step that
    cannot fill it is an error.  There is one step for each quota, with one window each.
    """
    from strandline.adapters import stored
    from strandline.functions.hashing import hash_order

    used, taken, done = None, None, []
    for label, by_domain in quotas.items():
        for domain, quota in by_domain.items():
            own = candidates.where((F.col("label") == label) & (F.col("domain") == domain)).withColumn("score", hash_order(f"{seed}|{label}|{domain}", F.col("case"), F.col("document")))
            own = own.withColumn("old", F.lit(False)) if used is None else own.join(used.withColumn("old", F.lit(True)), "document", "left").withColumn("old", F.coalesce("old", F.lit(False)))
            nth = F.row_number().over(Window.partitionBy("document").orderBy("score", "case"))
            ranked = own.withColumn("late", F.col("old") | (nth > 1)).orderBy("late", "score", "case").limit(quota)
            step = stored(ranked.select("case", "document", "domain", "label", F.lit(len(done)).alias("step"), F.row_number().over(Window.orderBy("late", "score", "case")).alias("n")), "cases")
            if step.count() < quota:
                raise ValueError(f"too few {label}/{domain} cases")
            done.append(step)
            taken = step if taken is None else taken.unionByName(step)
            used = taken.select("document").distinct()
    return taken


class RepeatedCases(ValueError):
    """Two populations that are to be summed up together share a case."""


def counters(cases: DataFrame, *keys: str, distinct: str | None = None) -> DataFrame:
    """How many cases a data set has by its keys, and of how many different ``distinct``."""
    extra = [F.countDistinct(distinct).alias(f"{distinct}s")] if distinct else []
    return cases.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *extra)


def combined_population(parts: list[DataFrame], key: str, strict: bool = True) -> DataFrame:
    """The cases of several runs as one population; a case that is there twice is an error, or with ``strict`` off one row."""
    both = parts[0].select(key)
    for p in parts[1:]:
        both = both.unionAll(p.select(key))
    counted = both.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    if strict and (twice := counted.where("n > 1").orderBy(key).first()):
        raise RepeatedCases(f"{key} {twice[key]}")
    return counted


def answer_rates(checks: DataFrame, responses: DataFrame, by: str = "run") -> DataFrame:
    """``case_id`` with ``answer_checks`` and ``run, case_id, answerable, degraded, attempts`` → a run's rates.

    Accuracy of the status over all requests, over the answerable ones, and over the
    others (controlled refusals); citations that refusals made up; degraded responses; retries.
    """
    rows = responses.join(checks, "case_id")
    right = F.col("status_correct").cast("double")
    share = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("requests"), share(right, "status_accuracy"), share(F.when(F.col("answerable"), right), "answerable_accuracy"), share(F.when(~F.col("answerable"), right), "refusal_rate"),
        F.count_if("fabricated").alias("fabricated"), F.count_if("degraded").alias("degraded"), F.sum(F.greatest(F.lit(0), F.col("attempts") - 1)).alias("retries"),
    )
