"""Queries of checks that fail closed, and of what projections and sessions promise."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline import adapters as A
from strandline.adapters import table
from strandline.functions import hashing as H
from strandline.functions import vectors as V
from strandline.operators import canonical as C
from strandline.operators import cards as K
from strandline.operators import control
from strandline.operators import search as R
from strandline.operators import session as E
from strandline.plans.structure import BLOCKS, TREE, _parsed

Q, S = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


@query("""SELECT o_orderkey AS version_id, CASE WHEN o_orderkey % 11 = 0 THEN 'NO_CANONICAL' WHEN o_orderkey % 7 = 0 THEN 'NO_RETRIEVAL' WHEN o_orderkey % 5 = 0 THEN 'SOURCE_DRIFT' WHEN o_orderkey % 3 = 0 THEN 'CANONICAL_DRIFT' END AS error FROM orders""")
def manifest_lineage(s, d):
    k = F.col("o_orderkey")
    o = table(s, d, "orders")
    sha = lambda x: F.sha2(x.cast("string"), 256)
    versions = o.select(k.alias("version_id"), sha(k).alias("source_sha"))
    canonical = o.where(k % 11 != 0).select(k.alias("version_id"), F.when(k % 5 == 0, "x").otherwise(sha(k)).alias("source_sha"), sha(k * 2).alias("canonical_sha"))
    retrieval = o.where(k % 7 != 0).select(k.alias("version_id"), F.when(k % 3 == 0, "x").otherwise(sha(k * 2)).alias("canonical_sha"), F.lit("f").alias("fingerprint"))
    return control.lineage_errors(versions, canonical, retrieval)


@query("""WITH n AS (SELECT l_suppkey AS kb_id, l_orderkey % 4 AS version_id, count(*) AS n FROM lineitem GROUP BY ALL) SELECT kb_id, version_id, CASE WHEN kb_id % 2 = 0 THEN 1 ELSE n END AS n FROM n""")
def scope_replacement(s, d):
    """Rows by scope after the even knowledge bases were written anew with one row a version."""
    rows = table(s, d, "lineitem").select(F.col("l_suppkey").alias("kb_id"), (F.col("l_orderkey") % 4).alias("version_id"), F.col("l_orderkey").alias("block"))
    new = rows.where("kb_id % 2 = 0").groupBy("kb_id", "version_id").agg(F.max("block").alias("block"))
    return control.replace_scope(rows, new, "kb_id", "version_id").groupBy("kb_id", "version_id").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_suppkey AS kb_id, count(*) + 1 AS expected, count(*) AS actual FROM lineitem WHERE l_suppkey % 3 = 0 GROUP BY 1 UNION ALL SELECT -1, 5, 0""")
def scope_counts(s, d):
    rows = table(s, d, "lineitem").select(F.col("l_suppkey").alias("kb_id"))
    expected = rows.groupBy("kb_id").agg((F.count(F.lit(1)) + F.max(F.when(F.col("kb_id") % 3 == 0, 1).otherwise(0))).alias("n")).union(s.sql("SELECT -1L, 5L"))
    return control.count_errors(rows, expected, "kb_id")


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'UNKNOWN_CURSOR' WHEN event_id % 3 = 0 OR event_id % 4 = 0 THEN 'CURSOR_QUERY_OR_SCOPE_MISMATCH' END AS error FROM events""")
def cursor_checks(s, d):
    k = F.col("event_id")
    e = table(s, d, "events")
    cursors = e.where(k % 5 != 0).select(F.col("user_id").alias("session"), k.cast("string").alias("cursor"), F.concat(F.lit("How  many "), "event_type").alias("query"), F.when(k % 2 == 0, "D1").alias("scope"))
    requests = e.select("event_id", F.col("user_id").alias("session"), k.cast("string").alias("cursor"), F.concat(F.lit(" how MANY "), "event_type", F.when(k % 3 == 0, "?").otherwise("")).alias("query"), F.when(k % 4 == 0, "D2").when(k % 2 == 0, "D1").alias("scope"))
    return E.cursor_errors(requests, cursors).select("event_id", "error")


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE 'search:{"a":{"x":' || event_id || ',"y":[{"b":1,"c":2}]},"q":"' || event_type || '"}' END AS signature FROM events""")
def nested_signatures(s, d):
    """Calls whose arguments come in two key orders, with spaces, or are no object."""
    k = F.col("event_id").cast("string")
    first = F.concat(F.lit('{"q":"'), "event_type", F.lit('","a":{"y":[{"c":2,"b":1}],"x":'), k, F.lit("}}"))
    second = F.concat(F.lit('{ "a" : {"x": '), k, F.lit(', "y":[ {"b":1 ,"c":2} ]}, "q":"'), "event_type", F.lit('"}'))
    n = F.col("event_id") % 4
    return table(s, d, "events").select("event_id", H.json_signature()(F.lit("search"), F.when(n == 0, first).when(n < 3, second).otherwise(F.concat(F.lit("["), k, F.lit("]")))).alias("signature"))


@query(f"""WITH RECURSIVE {BLOCKS}, {TREE}, w AS (SELECT p.doc_id FROM par p LEFT JOIN par q ON q.doc_id = p.doc_id AND q.pos = p.parent WHERE p.level > coalesce(q.level, 0) + 1 UNION ALL SELECT doc_id FROM blocks GROUP BY doc_id HAVING count(level) = 0),
n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id)
SELECT b.doc_id, count(*) AS n_blocks, count(level) AS n_headings, max(start + length(text)) AS text_length, sha256(string_agg(text, chr(10) || chr(10) ORDER BY ordinal)) AS text_sha256, count(DISTINCT ordinal // 4) AS n_pages, coalesce(any_value(n.n), 0) AS n_warnings FROM blocks b LEFT JOIN n ON n.doc_id = b.doc_id GROUP BY b.doc_id""")
def full_manifests(s, d):
    blocks = C.assemble(_parsed(s, d)).withColumn("page", F.floor(F.col("ordinal") / 4))
    return C.full_manifest(blocks, C.warnings(C.heading_tree(blocks), blocks))


@query(f"""WITH {BLOCKS}, b AS (SELECT *, coalesce((SELECT max(h.ordinal) FROM blocks h WHERE h.doc_id = x.doc_id AND h.ordinal <= x.ordinal AND h.level IS NOT NULL), -1) AS heading, ordinal % 6 = 3 AS cell FROM blocks x),
m AS (SELECT *, CASE WHEN lag(ordinal) OVER w IS NULL OR heading <> lag(heading) OVER w OR cell OR lag(cell) OVER w THEN 1 ELSE 0 END AS new FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)), g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY ordinal) AS g FROM m)
SELECT doc_id, g, min(ordinal) AS first, max(ordinal) AS last, count(*) AS n FROM g GROUP BY doc_id, g""")
def evidence_groups_with_cells(s, d):
    cell = F.when(F.col("ordinal") % 6 == 3, 1)
    return C.evidence_groups(C.assemble(_parsed(s, d)).withColumn("row", cell).withColumn("col", cell))


@query("""WITH b AS (SELECT l_orderkey AS section, l_orderkey * 10 + l_linenumber AS block_id, CAST(l_linenumber AS BIGINT) AS ordinal, l_linenumber % 3 = 0 AS structural FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) = 1)
SELECT o_custkey AS query_id, section, block_id, row_number() OVER (PARTITION BY o_custkey, section ORDER BY structural, ordinal) AS n FROM orders JOIN b ON b.section = o_orderkey AND ordinal >= 2 AND ordinal < 7 QUALIFY n <= 3""")
def blocks_without_keywords(s, d):
    one = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey")
    rows = table(s, d, "lineitem").withColumn("r", F.row_number().over(one)).where("r = 1")
    n = F.col("l_linenumber").cast("long")
    blocks = rows.select(F.col("l_orderkey").alias("section"), (F.col("l_orderkey") * 10 + n).alias("block_id"), n.alias("ordinal"), (n % 3 == 0).alias("structural"))
    return R.select_without_keywords(blocks, table(s, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("section"), F.lit(2).alias("start"), F.lit(7).alias("end")))


@query("""WITH x AS (SELECT l_suppkey AS query_id, l_orderkey AS rank, l_linenumber AS n FROM lineitem WHERE l_orderkey % 3 > 0) SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY rank) AS position FROM x QUALIFY position <= 5""")
def top_nonempty_results(s, d):
    used = table(s, d, "lineitem").where("l_orderkey % 3 > 0").select(F.col("l_suppkey").alias("query_id"), F.col("l_orderkey").alias("rank"), F.col("l_linenumber").alias("n"))
    return R.top_results(used, 5)


@query("""SELECT event_id AS request_id, CASE WHEN event_id % 7 = 0 THEN 'NONE' WHEN event_id % 2 = 0 THEN 'KEYWORD' ELSE 'SEMANTIC' END AS executed_mode, event_id % 2 = 0 AND event_id % 7 > 0 AS degraded, CAST(NULL AS VARCHAR) AS error FROM events""")
def empty_snapshots(s, d):
    k = F.col("event_id")
    req = table(s, d, "events").select(k.alias("request_id"), F.when(k % 2 == 0, "HYBRID").otherwise("SEMANTIC").alias("mode"), F.lit(True).alias("keyword_ok"), (k % 2 == 1).alias("semantic_ok"), (k % 7).alias("snapshot_size"))
    return R.execute_mode(req).select("request_id", "executed_mode", "degraded", "error")


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 1 THEN 'BAD_ITEM' WHEN 2 THEN 'BAD_ITEM' WHEN 3 THEN 'NO_ITEMS' WHEN 4 THEN 'NOT_AN_OBJECT' END AS error, CASE o_orderkey % 5 WHEN 0 THEN 2 END AS items, CASE o_orderkey % 5 WHEN 0 THEN o_orderpriority END AS summary, CASE o_orderkey % 5 WHEN 0 THEN 0 END AS aliases FROM orders""")
def provider_answers(s, d):
    """Answers with unknown fields, an item in an array, an item without id, no items, no object."""
    good = F.concat(F.lit('{"request_id":"r1","summary":"'), "o_orderpriority", F.lit('","topics":["t"],"extra":{"x":1}}'))
    forms = [F.concat(F.lit('{"model":"m","items":['), good, F.lit(',{"request_id":"r2"}]}')), F.concat(F.lit('{"items":[['), good, F.lit("]]}")), F.lit('{"items":[{"summary":"s"}]}'), F.lit('{"cards":[]}'), F.concat(F.lit("["), good, F.lit("]"))]
    read = K.provider_cards(F.get(F.array(*forms), (F.col("o_orderkey") % 5).cast("int")))
    return table(s, d, "orders").select("o_orderkey", read.alias("r")).select("o_orderkey", "r.error", F.when(F.col("r.items").isNotNull(), F.size("r.items")).alias("items"), F.get("r.items", F.lit(0))["summary"].alias("summary"), F.when(F.col("r.items").isNotNull(), F.size(F.get("r.items", F.lit(0))["aliases"])).alias("aliases"))


@query("""SELECT p_partkey, 64 AS dimensions, true AS unit, true AS same FROM part""")
def card_embeddings(s, d):
    """Template texts to vectors, coded and decoded."""
    rows = table(s, d, "part").select("p_partkey", V.hashing_embedder(64)(F.concat(F.lit("Document: "), "p_name")).alias("v"))
    back = V.decode()(V.encode()("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return rows.select("p_partkey", F.size("v").alias("dimensions"), (F.abs(norm - 1) < 1e-5).alias("unit"), (back == F.col("v")).alias("same"))


@query("""SELECT c_custkey AS section, c_custkey % 3 = 0 AND c_custkey * 500 > 64000 AS cut FROM customer""")
def partition_triggers(s, d):
    k = F.col("c_custkey")
    rows = table(s, d, "customer").select(k.alias("section"), (k * 500).alias("tokens"), (k % 3).alias("children"))
    cut = K.partition_trigger(rows, enabled=True).select("section", F.lit(True).alias("cut"))
    off = K.partition_trigger(rows).select("section", F.lit(True).alias("cut"))
    return rows.join(cut.union(off), "section", "left").select("section", F.coalesce("cut", F.lit(False)).alias("cut"))


@query("""WITH j AS (SELECT l_orderkey AS version_id, l_linenumber AS attempt_no, CASE WHEN l_returnflag = 'A' THEN 'FAILED' ELSE 'RUNNING' END AS job_status, l_quantity > 25 AS retryable, l_shipmode AS lease_owner FROM lineitem)
SELECT version_id, attempt_no FROM j WHERE job_status = 'FAILED' AND retryable AND attempt_no >= 2""".replace("l_shipmode", "l_linestatus"))
def job_filters(s, d):
    jobs = table(s, d, "lineitem").select(F.col("l_orderkey").alias("version_id"), F.col("l_linenumber").alias("attempt_no"), F.when(F.col("l_returnflag") == "A", "FAILED").otherwise("RUNNING").alias("job_status"), (F.col("l_quantity") > 25).alias("retryable"), F.col("l_linestatus").alias("lease_owner"))
    return control.filter_jobs(jobs, status="FAILED", retryable=True, attempt_from=2).select("version_id", "attempt_no")


@query("""SELECT event_id FROM events WHERE event_type = 'click' AND user_id = 3 AND 'x' || event_id % 2 = 'x1'""")
def audit_filters_by_ids(s, d):
    e = table(s, d, "events")
    audits = e.select("event_id", F.col("event_type").alias("operation"), F.col("user_id").alias("request_id"), F.lit("e").alias("execution_id"), F.concat(F.lit("x"), (F.col("event_id") % 2).cast("string")).alias("trace_id"))
    return control.filter_audits(audits, operation="click", request_id=3, execution_id="e", trace_id="x1").select("event_id")


@query(f"""WITH RECURSIVE {BLOCKS}, {TREE} SELECT d.doc_id, true AS valid, (SELECT count(*) FROM blocks b WHERE b.doc_id = d.doc_id) AS n_blocks, sha256(coalesce((SELECT string_agg(text, chr(10) || chr(10) ORDER BY ordinal) FROM blocks b WHERE b.doc_id = d.doc_id), '')) AS text_sha256 FROM documents d""")
def canonical_lines(s, d):
    """Blocks, headings and warnings written as JSON lines and read again."""
    blocks = C.assemble(_parsed(s, d))
    tree = C.heading_tree(blocks)
    return K.read_json_lines(K.json_lines(table(s, d, "documents").select("doc_id"), blocks, tree.select("doc_id", "pos", "title"), C.warnings(tree, blocks)))


QUERIES, SQL = Q, S
