"""Queries of the evaluation operators. Results: orders by clerk priority; gold: line items."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.adapters import table
from strandline.operators import evaluation as E

Q, S = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


RANKED = """ranked AS (SELECT o_custkey AS query_id, o_orderkey % 40 AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
gold AS (SELECT DISTINCT o_custkey AS query_id, o_orderkey % 40 AS item FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 4 <> 0 UNION SELECT c_custkey, c_custkey % 40 FROM customer WHERE c_acctbal > 5000)"""
METRICS = """g AS (SELECT gold.query_id, min(rank) AS rank FROM gold LEFT JOIN ranked USING (query_id, item) GROUP BY gold.query_id, item),
m AS (SELECT query_id, count(*) AS n, count(*) FILTER (WHERE rank <= 5) AS h5, count(*) FILTER (WHERE rank <= 10) AS h10, min(rank) FILTER (WHERE rank <= 10) AS best, sum(CASE WHEN rank <= 10 THEN ln(2) / ln(rank + 1.0) ELSE 0 END) AS dcg FROM g GROUP BY query_id),
metrics AS (SELECT q.query_id, round(h5 / n, 6) AS recall_5, round(h10 / n, 6) AS recall_10, CASE WHEN n IS NOT NULL THEN round(coalesce(1.0 / best, 0), 6) END AS rr_10,
  round(dcg / list_sum(list_transform(range(1, CAST(least(n, 10) AS BIGINT) + 1), lambda k: ln(2) / ln(k + 1.0))), 6) AS ndcg_10 FROM (SELECT query_id FROM ranked UNION SELECT query_id FROM gold) q LEFT JOIN m USING (query_id))"""


def _ranked(s, d):
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(s, d, "orders").select(F.col("o_custkey").alias("query_id"), (F.col("o_orderkey") % 40).alias("item"), F.row_number().over(order).alias("rank"))


def _gold(s, d):
    a = table(s, d, "orders").where("o_orderstatus = 'F' AND o_custkey % 4 <> 0").select(F.col("o_custkey").alias("query_id"), (F.col("o_orderkey") % 40).alias("item"))
    b = table(s, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("query_id"), (F.col("c_custkey") % 40).alias("item"))
    return a.union(b).distinct()


@query(f"WITH {RANKED}, {METRICS} SELECT * FROM metrics")
def ranking_metrics(s, d):
    return E.ranking_metrics(_ranked(s, d), _gold(s, d))


@query(f"""WITH {RANKED}, {METRICS} SELECT query_id % 3 AS mode, count(*) AS attempts, count(recall_5) AS scored, round(avg(recall_5), 6) AS recall_5, round(avg(rr_10), 6) AS mrr_10, round(avg(ndcg_10), 6) AS ndcg_10, count(*) FILTER (WHERE rr_10 = 0) AS misses FROM metrics GROUP BY 1""")
def mode_summary(s, d):
    m = E.ranking_metrics(_ranked(s, d), _gold(s, d))
    mean = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return m.groupBy((F.col("query_id") % 3).alias("mode")).agg(F.count(F.lit(1)).alias("attempts"), F.count("recall_5").alias("scored"), mean("recall_5", "recall_5"), mean("rr_10", "mrr_10"), mean("ndcg_10", "ndcg_10"), F.count_if(F.col("rr_10") == 0).alias("misses"))


@query(f"""WITH {RANKED}, {METRICS}, b AS (SELECT query_id, recall_5 * 2 AS recall_5, rr_10 FROM metrics WHERE query_id % 5 <> 0) SELECT coalesce(a.query_id, b.query_id) AS query_id, round(b.recall_5 - a.recall_5, 6) AS delta_recall_5, round(b.rr_10 - a.rr_10, 6) AS delta_rr_10 FROM metrics a FULL JOIN b ON a.query_id = b.query_id""")
def run_comparison(s, d):
    a = E.ranking_metrics(_ranked(s, d), _gold(s, d))
    return E.compare_runs(a, a.where("query_id % 5 <> 0").withColumn("recall_5", F.col("recall_5") * 2), "query_id", "recall_5", "rr_10")


@query("""WITH t AS (SELECT item_id AS query_id, doc_id AS item, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS rank, lower(regexp_replace(d.text, '\\s+', '', 'g')) AS text, lower(regexp_replace(b.text, '\\s+', '', 'g')) AS anchor FROM benchmark b JOIN documents d ON d.doc_id % 40 = b.item_id)
SELECT query_id, round(avg(hit), 6) AS anchor_recall_10 FROM (SELECT query_id, item, max(CASE WHEN rank <= 10 AND contains(text, anchor) THEN 1 ELSE 0 END) AS hit FROM t GROUP BY ALL) GROUP BY query_id""".replace("\\\\", "\\"))
def anchor_recall(s, d):
    docs = table(s, d, "documents").select((F.col("doc_id") % 40).alias("query_id"), F.col("doc_id").alias("item"), "text")
    items = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("anchor"))
    evidence = docs.join(items.select("query_id"), "query_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("item")))
    return E.anchor_recall(docs.select("query_id", "item").join(items, "query_id"), evidence, 10)


@query("""SELECT event_type, count(value) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean FROM events GROUP BY event_type""")
def latency_summary(s, d):
    return E.latency_summary(table(s, d, "events"), "value", "event_type")


@query("""SELECT event_type, round(count(*) / (date_diff('microsecond', min(ts), max(ts)) / 1e6), 9) AS per_second FROM events GROUP BY event_type""")
def throughput(s, d):
    t = lambda f: F.unix_micros(f("ts").cast("timestamp"))
    return table(s, d, "events").groupBy("event_type").agg(F.round(F.count(F.lit(1)) / ((t(F.max) - t(F.min)) / 1e6), 9).alias("per_second"))


@query("""WITH x AS (SELECT o_orderkey AS k, o_custkey % 6 AS run, o_orderkey % 3 = 0 AS yes, CASE WHEN (o_orderkey % 3 = 0) = (o_orderkey % 2 = 0) THEN 1.0 ELSE 0.0 END AS ok FROM orders)
SELECT run, count(*) AS requests, round(avg(ok), 6) AS status_accuracy, round(avg(ok) FILTER (WHERE yes), 6) AS answerable_accuracy, round(avg(ok) FILTER (WHERE NOT yes), 6) AS refusal_rate, count(*) FILTER (WHERE k % 2 = 1 AND NOT yes) AS fabricated,
  count(*) FILTER (WHERE k % 11 = 0) AS degraded, CAST(sum(greatest(0, k % 4 - 1)) AS BIGINT) AS retries FROM x GROUP BY run""")
def answer_rates(s, d):
    k = F.col("o_orderkey")
    responses = table(s, d, "orders").select((F.col("o_custkey") % 6).alias("run"), k.alias("case_id"), (k % 3 == 0).alias("answerable"), (k % 11 == 0).alias("degraded"), (k % 4).alias("attempts"))
    return E.answer_rates(answer_checks(s, d), responses)


@query("""WITH p AS (SELECT o_custkey, list_distinct(list(o_orderkey % 9)) AS hits, list_distinct(list(o_orderkey % 9) FILTER (WHERE o_orderstatus = 'F')) AS gold FROM orders GROUP BY o_custkey)
SELECT o_custkey, coalesce(len(list_intersect(hits, gold)), 0) > 0 AS any_page, coalesce(len(list_intersect(hits, gold)), 0) = coalesce(len(gold), 0) AND coalesce(len(gold), 0) > 0 AS all_pages, CASE WHEN len(gold) > 0 THEN round(len(list_intersect(hits, gold)) / len(gold), 6) END AS coverage FROM p""")
def page_metrics(s, d):
    page = F.col("o_orderkey") % 9
    p = table(s, d, "orders").groupBy("o_custkey").agg(F.collect_set(page).alias("hits"), F.collect_set(F.when(F.col("o_orderstatus") == "F", page)).alias("gold"))
    return p.select("o_custkey", *E.page_metrics(F.col("hits"), F.col("gold")))


@query("""WITH a AS (SELECT doc_id % 50 AS pair, unnest(string_split(text, ' ')) AS token FROM documents WHERE doc_id % 2 = 0), b AS (SELECT doc_id % 50 - 1 AS pair, unnest(string_split(text, ' ')) AS token FROM documents WHERE doc_id % 2 = 1),
x AS (SELECT pair, token, count(*) AS a FROM a WHERE token <> '' GROUP BY ALL), y AS (SELECT pair, token, count(*) AS b FROM b WHERE token <> '' GROUP BY ALL)
SELECT pair, round(sum(length(token) * least(a, coalesce(b, 0))) / sum(length(token) * a), 6) AS coverage FROM x LEFT JOIN y USING (pair, token) GROUP BY pair""")
def token_coverage(s, d):
    words = table(s, d, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("token")).where("token <> ''")
    k = F.col("doc_id")
    return E.token_coverage(words.where(k % 2 == 0).select((k % 50).alias("pair"), "token"), words.where(k % 2 == 1).select((k % 50 - 1).alias("pair"), "token"))


@query("""SELECT c_custkey, c_mktsegment, n FROM (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('s1|' || CAST(c_custkey AS VARCHAR))) AS n FROM customer) WHERE (c_mktsegment = 'BUILDING' AND n <= 10) OR (c_mktsegment = 'MACHINERY' AND n <= 5)""")
def quota_sample(s, d):
    return E.quota_sample(table(s, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", {"BUILDING": 10, "MACHINERY": 5}, "s1", "c_custkey").select("c_custkey", "c_mktsegment", "n")


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY sha256('d|' || CAST(doc_id AS VARCHAR)) LIMIT 100""")
def distractor_documents(s, d):
    from strandline.functions.hashing import hash_order

    rest = table(s, d, "documents").select("doc_id").join(table(s, d, "labels").select("doc_id"), "doc_id", "left_anti")
    return rest.orderBy(hash_order("d", F.col("doc_id"))).limit(100)


@query("""WITH g AS (SELECT doc_id % 40 AS query_id, doc_id AS item FROM labels WHERE quality = 0) SELECT DISTINCT g.query_id, d2.doc_id AS item FROM g JOIN documents d ON d.doc_id = g.item JOIN documents d2 ON sha256(d2.text) = sha256(d.text)""")
def same_content_gold(s, d):
    gold = table(s, d, "labels").where("quality = 0").select((F.col("doc_id") % 40).alias("query_id"), F.col("doc_id").alias("item"))
    return E.same_content_gold(gold, table(s, d, "documents").select(F.col("doc_id").alias("item"), F.sha2("text", 256).alias("sha"))).distinct()


@query("""SELECT p_brand, p_size % 4 AS split, count(*) AS n, count(DISTINCT p_type) AS types FROM part GROUP BY ALL""")
def dataset_counters(s, d):
    cases = table(s, d, "part").select("p_brand", (F.col("p_size") % 4).alias("split"), F.col("p_type").alias("type"))
    return E.counters(cases, "p_brand", "split", distinct="type")


@query("""WITH p AS (SELECT l_orderkey AS document, l_linenumber AS physical, CAST(CASE WHEN l_quantity > 40 THEN l_linenumber - 1 ELSE l_linenumber + 2 END AS VARCHAR) AS label FROM lineitem),
w AS (SELECT DISTINCT l_orderkey AS document, CAST(l_linenumber AS VARCHAR) AS printed FROM lineitem)
SELECT w.document, w.printed, CASE WHEN count(p.label) = 1 THEN min(p.physical) END AS physical, CASE WHEN count(p.label) <> 1 THEN 'label on ' || count(p.label) || ' pages' END AS error
FROM w LEFT JOIN p ON p.document = w.document AND p.label = w.printed GROUP BY ALL""")
def page_mapping(s, d):
    n = F.col("l_linenumber")
    rows = table(s, d, "lineitem").select(F.col("l_orderkey").alias("document"), n.alias("physical"), F.when(F.col("l_quantity") > 40, n - 1).otherwise(n + 2).cast("string").alias("label"))
    return E.page_mapping(rows, rows.select("document", F.col("physical").cast("string").alias("printed")))


@query("""SELECT o_orderkey, count(*) AS n FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY o_orderkey""")
def combined_population(s, d):
    """Two runs that share cases, without the guard."""
    o = table(s, d, "orders")
    return E.combined_population([o.where("o_orderstatus = 'F'"), o.where("o_orderpriority = '1-URGENT'")], "o_orderkey", strict=False)


_RESPONSES = """rs AS (SELECT event_id AS case_id, user_id % 7 AS run, event_type <> 'error' AS ok, event_id % 11 = 0 AS degraded, CASE WHEN event_id % 4 = 0 THEN 'KEYWORD' ELSE 'HYBRID' END AS executed_mode, event_id % 13 <> 0 AS measured, CASE WHEN event_id % 3 = 0 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'ANSWERED' END AS status, event_id % 3 AS attempts FROM events)"""


def _responses(s, d):
    k = F.col("event_id")
    return table(s, d, "events").select(
        k.alias("case_id"), (F.col("user_id") % 7).alias("run"), (F.col("event_type") != "error").alias("ok"), (k % 11 == 0).alias("degraded"), F.when(k % 4 == 0, "KEYWORD").otherwise("HYBRID").alias("executed_mode"),
        (k % 13 != 0).alias("measured"), F.when(k % 3 == 0, "INSUFFICIENT_EVIDENCE").otherwise("ANSWERED").alias("status"), (k % 3).alias("attempts"),
    )


@query(f"""WITH {_RESPONSES} SELECT case_id FROM rs WHERE ok AND NOT degraded AND executed_mode = 'HYBRID' AND measured""")
def normal_population(s, d):
    return E.normal_mode(_responses(s, d)).select("case_id")


_CITED = """cs AS (SELECT o_orderkey AS case_id, o_custkey % 5 AS document, [o_orderkey % 4, o_orderkey % 3 + 4, o_orderkey % 4] AS pages FROM orders),
ct AS (SELECT l_orderkey AS case_id, l_suppkey % 5 AS document, CAST(l_linenumber AS INTEGER) AS page FROM lineitem)"""


def _cited(s, d):
    k = F.col("o_orderkey")
    cases = table(s, d, "orders").select(k.alias("case_id"), (F.col("o_custkey") % 5).alias("document"), F.array(k % 4, k % 3 + 4, k % 4).cast("array<int>").alias("pages"))
    return cases, table(s, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), (F.col("l_suppkey") % 5).alias("document"), F.col("l_linenumber").cast("int").alias("page"))


_CITATION_SQL = """cm AS (SELECT c.case_id, count(t.case_id) AS citations, coalesce(bool_or(t.document = c.document), false) AS relevant_document, count(DISTINCT t.page) FILTER (WHERE t.document = c.document AND list_contains(c.pages, t.page)) AS hit, any_value(len(list_distinct(c.pages))) AS n
FROM cs c LEFT JOIN ct t ON t.case_id = c.case_id GROUP BY c.case_id)"""


@query(f"""WITH {_CITED}, {_CITATION_SQL} SELECT case_id, citations, relevant_document, hit > 0 AS any_gold_page, round(hit / n, 6) AS page_coverage, hit = n AS all_gold_pages FROM cm""")
def citation_metrics(s, d):
    return E.citation_metrics(*_cited(s, d))


@query(f"""WITH {_RESPONSES}, {_CITED}, {_CITATION_SQL}, m AS (SELECT rs.*, relevant_document, hit > 0 AS any_page, hit = n AS all_pages, round(hit / n, 6) AS coverage, ok AND NOT degraded AND executed_mode = 'HYBRID' AND measured AS normal_ok FROM rs LEFT JOIN cm USING (case_id))
SELECT run, count(*) AS requests, count(*) FILTER (WHERE ok) AS successes, count(*) FILTER (WHERE normal_ok) AS normal, count(*) FILTER (WHERE ok AND degraded) AS degraded, CAST(sum(greatest(0, attempts - 1)) AS BIGINT) AS retries,
  round(count(*) FILTER (WHERE normal_ok AND status = 'ANSWERED') / count(*), 6) AS answered_rate, round(count(*) FILTER (WHERE normal_ok AND status <> 'ANSWERED') / count(*), 6) AS refused_rate, round(count(*) FILTER (WHERE normal_ok AND relevant_document) / count(*), 6) AS relevant_rate,
  round(count(*) FILTER (WHERE normal_ok AND any_page) / count(*), 6) AS any_page_rate, round(count(*) FILTER (WHERE normal_ok AND all_pages) / count(*), 6) AS all_pages_rate, round(coalesce(sum(coverage) FILTER (WHERE normal_ok), 0) / count(*), 6) AS coverage_rate FROM m GROUP BY run""")
def answer_summary(s, d):
    return E.answer_summary(_responses(s, d), E.citation_metrics(*_cited(s, d)))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 <> 0 AND p_size % 3 <> 0 AND p_size % 5 <> 0 AND p_size % 7 <> 0 THEN 'ANSWERABLE' WHEN p_size % 4 = 0 AND p_size % 3 = 0 AND p_size % 5 = 0 AND p_size % 7 = 0 OR (p_size % 4 = 0 AND p_size % 3 = 0 AND p_size % 5 = 0 AND p_size % 7 = 1) THEN 'UNANSWERABLE' END AS kind FROM part""")
def candidate_cases(s, d):
    k = F.col("p_size")
    sources = F.when(k % 7 == 0, F.array().cast("array<string>")).when((k % 7 == 1) & (k % 4 == 0), F.lit(None).cast("array<string>")).otherwise(F.array(F.lit(E.PURE_TEXT)))
    cases = table(s, d, "part").select("p_partkey", F.when(k % 4 == 0, E.NOT_ANSWERABLE).otherwise("42").alias("answer"), F.when(k % 3 != 0, F.get(F.array(*[F.lit(x) for x in E.ANSWER_FORMATS]), (k % 4).cast("int"))).alias("format"), F.when(k % 5 != 0, F.array(k)).alias("pages"), sources.alias("sources"))
    return E.candidate_kind(cases).select("p_partkey", "kind")


@query("""WITH c AS (SELECT p_partkey AS case_id, CASE p_size % 3 WHEN 0 THEN 'Int' WHEN 1 THEN 'Str' ELSE 'List' END AS format, p_size, split_part(p_name, ' ', 1) AS x, split_part(p_name, ' ', 2) AS y, p_partkey % 4 AS k FROM part)
SELECT case_id, CASE WHEN k = 3 THEN false WHEN format = 'Int' THEN k <> 2 WHEN format = 'Str' THEN k <> 2 ELSE k <> 2 END AS matched, CASE WHEN format = 'List' THEN CASE k WHEN 3 THEN 0.0 WHEN 2 THEN 0.5 ELSE 1.0 END END AS item_recall, CASE WHEN format = 'List' THEN k = 0 END AS in_order FROM c
WHERE x <> y AND NOT contains(x, y) AND NOT contains(y, x)""")
def answer_assessment(s, d):
    """Answers that give a part's size, name or words: rightly, in the other order, half, or not at all."""
    n = F.col("p_name")
    x, y, k = F.split_part(n, F.lit(" "), F.lit(1)), F.split_part(n, F.lit(" "), F.lit(2)), F.col("p_partkey") % 4
    size = F.col("p_size").cast("string")
    form = F.when(F.col("p_size") % 3 == 0, "Int").when(F.col("p_size") % 3 == 1, "Str").otherwise("List")
    right = F.when(form == "Int", F.concat(F.lit("It is "), size, F.lit(".0 [E1] in all"))).when(form == "Str", F.concat(F.lit("the "), F.upper(n), F.lit("!"))).otherwise(F.concat(x, F.lit(" and "), y))
    turned = F.when(form == "Int", F.concat(F.lit("7777 or "), size)).when(form == "Str", x).otherwise(F.concat(y, F.lit(" and "), x))
    wrong = F.when(form == "Int", F.concat(F.lit("v"), size)).when(form == "Str", F.lit("Ω")).otherwise(x)
    rows = table(s, d, "part").where((x != y) & ~F.contains(x, y) & ~F.contains(y, x))
    cases = rows.select(F.col("p_partkey").alias("case_id"), form.alias("format"), F.when(form == "Int", size).otherwise(n).alias("reference"), F.array(x, y).alias("items"), F.when(k == 0, right).when(k == 1, turned).when(k == 2, wrong).otherwise("").alias("answer"))
    return E.assess_answers(cases)


@query(f"""WITH {RANKED}, b AS (SELECT g.query_id, min(r.rank) AS best FROM (SELECT DISTINCT * FROM gold) g LEFT JOIN (SELECT query_id, item, min(rank) AS rank FROM ranked GROUP BY ALL) r ON r.query_id = g.query_id AND r.item = g.item GROUP BY g.query_id), q AS (SELECT query_id FROM ranked UNION SELECT query_id FROM gold)
SELECT q.query_id, {", ".join(f"CASE WHEN b.query_id IS NOT NULL THEN coalesce(best <= {n}, false) END AS hit_{n}" for n in (1, 3, 5, 10))} FROM q LEFT JOIN b USING (query_id)""")
def hits_at(s, d):
    return E.hits_at(_ranked(s, d), _gold(s, d))


@query("""SELECT o_orderkey AS case_id, (o_orderkey % 3 = 0) = (o_orderkey % 2 = 0) AS status_correct, CAST(o_orderkey % 3 AS BIGINT) AS citations, CAST(CASE WHEN o_orderkey % 3 = 2 THEN 1 ELSE 0 END AS BIGINT) AS valid_citations, o_orderkey % 3 > 0 AS relevant_document, o_orderkey % 2 = 1 AND o_orderkey % 3 > 0 AS fabricated FROM orders""")
def answer_checks(s, d):
    """Answers with none, one wrong, or a wrong and a right citation."""
    k = F.col("o_orderkey")
    orders = table(s, d, "orders")
    cases = orders.select(k.alias("case_id"), (k % 3 == 0).alias("answerable"), F.when(k % 2 == 0, "ANSWERED").otherwise("INSUFFICIENT_EVIDENCE").alias("status"))
    anchors = orders.select(k.alias("case_id"), F.lit("a").alias("document"), F.concat(F.lit("Order "), k.cast("string"), F.lit(" is &lt;due&gt;")).alias("anchor"))
    said = F.when(F.col("n") == 1, F.lit("nothing")).otherwise(F.concat(F.lit("It says ORDER\n"), k.cast("string"), F.lit("  is <due> now")))
    citations = orders.where(k % 3 > 0).select(k, F.explode(F.sequence(F.lit(1).cast("long"), k % 3)).alias("n")).select(k.alias("case_id"), "n", F.lit("a").alias("document"), said.alias("text"))
    return E.answer_checks(cases, citations, anchors)


QUERIES, SQL = Q, S
