"""Queries of navigation cards and their artifacts, over the headings of ``documents``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.adapters import table
from strandline.operators import artifacts as A
from strandline.operators import canonical as C
from strandline.plans.structure import BLOCKS, TREE, _parsed

Q, S = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


@query()
def section_cards(s, d):
    """A card for each heading, from the deepest up (tested against a plain recursion)."""
    blocks = C.assemble(_parsed(s, d))
    cards = A.section_cards(blocks, C.heading_tree(blocks))
    return cards.select("doc_id", "pos", "depth", F.md5("source").alias("source"), F.md5(F.to_json("card")).alias("card"))


@query(f"""WITH RECURSIVE {BLOCKS}, {TREE}, c AS (SELECT doc_id, CAST(sum(length(text)) AS BIGINT) AS chars FROM blocks GROUP BY doc_id),
hc AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS headings, CAST(sum(ceil(n / 4)) + 1 AS BIGINT) AS calls FROM (SELECT doc_id, depth, count(*) AS n FROM walk GROUP BY ALL) GROUP BY doc_id)
SELECT doc_id, chars, coalesce(headings, 0) AS headings, coalesce(calls, 1) AS calls, CASE WHEN chars > 4000000 OR coalesce(headings, 0) + 1 > 2000 OR coalesce(calls, 1) > 128 THEN 'RETRIEVAL_GENERATION_LIMIT_EXCEEDED' END AS error FROM c LEFT JOIN hc USING (doc_id)""")
def card_limits(s, d):
    blocks = C.assemble(_parsed(s, d))
    return A.card_limits(blocks, C.heading_tree(blocks))


@query("""WITH r AS (SELECT o_custkey AS batch, o_orderkey AS request_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
b AS (SELECT DISTINCT batch, CASE WHEN batch % 5 = 4 THEN NULL WHEN batch % 5 = 0 THEN 1 ELSE 2 END AS attempt FROM r)
SELECT batch, request_id, n, attempt, CASE WHEN attempt IS NULL THEN 'RETRIEVAL_MODEL_OUTPUT_INVALID' END AS error FROM r JOIN b USING (batch)""")
def model_outputs(s, d):
    """First answers that are right, lack a request, have one twice, or are invalid; second ones that mend it, or not."""
    k, b = F.col("request_id"), F.col("batch")
    requests = table(s, d, "orders").select(F.col("o_custkey").alias("batch"), F.col("o_orderkey").alias("request_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("n"))
    first = requests.where((b % 5 != 1) | (F.col("n") > 1)).select("batch", F.lit(1).alias("attempt"), k, (b % 5 != 2).alias("valid"))
    twice = requests.where((b % 5 == 3) & (F.col("n") == 1)).select("batch", F.lit(1).alias("attempt"), k, F.lit(True).alias("valid"))
    second = requests.select("batch", F.lit(2).alias("attempt"), F.when((b % 5 == 4) & (F.col("n") == 1), -k - 1).otherwise(k).alias("request_id"), F.lit(True).alias("valid"))
    lost = requests.where((b % 5 == 4) & (F.col("n") == 1)).select("batch", F.lit(1).alias("attempt"), F.lit(None).cast("long").alias("request_id"), F.lit(True).alias("valid"))
    return A.accepted_outputs(requests, first.unionByName(twice).unionByName(second).unionByName(lost))


_CARDS = """cd AS (SELECT l_orderkey AS version, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS n FROM lineitem)"""


@query(f"""WITH {_CARDS}, t AS (SELECT version, count(*) AS n FROM cd GROUP BY version) SELECT version, rule, n FROM (
  SELECT version, 'CARD_ID_REPEATED' AS rule, 2 AS n FROM t WHERE version % 5 = 1 AND n >= 2 UNION ALL SELECT version, 'BAD_SHAPE', 1 FROM t WHERE version % 5 = 2
  UNION ALL SELECT version, 'PARENT_AFTER_CHILD', 1 FROM t WHERE version % 5 = 3 AND n >= 3 UNION ALL SELECT version, 'TEXT_NOT_OF_TEMPLATE', n FROM t WHERE version % 5 = 4
  UNION ALL SELECT version, 'PARTS_NOT_CONTIGUOUS', 1 FROM t WHERE version % 7 = 3 AND version % 5 = 0 AND n >= 2 UNION ALL SELECT version, 'MIXED_CARDS', n FROM t WHERE version % 7 = 4 AND version % 5 = 0 AND n >= 2)""")
def artifact_violations(s, d):
    """Chains of cards that are spoilt in one way each: an id twice, an empty range, a parent that comes later, another text, a gap between parts, parts beside a full card."""
    v, n = F.col("version"), F.col("n")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity")
    rows = table(s, d, "lineitem").select(F.col("l_orderkey").alias("version"), F.row_number().over(order).alias("n"))
    parted = (v % 5 == 0) & ((v % 7 == 3) | (v % 7 == 4))
    part = F.when(parted & ((v % 7 == 3) | (n > 1)), F.when(v % 7 == 3, n - 1).otherwise(n - 2))
    node = F.when(parted, F.lit(1)).otherwise(n)
    return A.artifact_violations(
        rows.select(
            "version", "n", F.concat(v.cast("string"), F.when(part.isNull(), F.lit(":rn:")).otherwise(":rsp:"), F.when((v % 5 == 1) & (n == 2), F.lit(1)).otherwise(n).cast("string")).alias("card_id"),
            F.when(part.isNull(), "HEADING_NODE").otherwise("HEADING_SUBPARTITION").alias("card_type"), node.alias("node"),
            F.when((node == 1) | parted, F.lit(0)).when((v % 5 == 3) & (n == 3), F.lit(999)).otherwise(n - 1).alias("parent"), F.when(parted, F.lit(1)).otherwise(n).alias("depth"), F.lit(0).alias("sibling"), part.alias("part"),
            F.lit("t").alias("title"), F.lit("p").alias("path"), (n * 10 + F.when((v % 7 == 3) & parted & (n == 2), 1).otherwise(0)).alias("start"), F.when((v % 5 == 2) & (n == 1), F.lit(0)).otherwise(n * 10 + 10).alias("end"),
            F.lit(0).alias("canonical_start"), F.lit(1).alias("canonical_end"), F.lit("x").alias("embedding_text"), F.when(v % 5 == 4, "y").otherwise("x").alias("wanted_text"),
        )
    )


def _navigation(s, d):
    k = F.col("c_custkey")
    card = F.struct(F.col("c_mktsegment").alias("summary"), F.array("c_name").alias("topics"), F.array().cast("array<string>").alias("aliases"), F.array(F.lit("q?")).alias("questions"))
    c = table(s, d, "customer")
    cards = c.select((k % 50).alias("version"), F.floor(k / 50).cast("int").alias("node"), F.when(k % 3 == 0, (k % 4).cast("int")).alias("part"), F.lit(1).alias("depth"), F.col("c_name").alias("title"), F.concat_ws(" > ", "c_mktsegment", "c_name").alias("path"), F.lit(0).alias("start"), F.lit(5).alias("end"), card.alias("card"), F.array(F.lit(0.5)).alias("embedding"))
    profiles = c.groupBy((k % 50).alias("version")).agg(F.min("c_name").alias("title")).select("version", "title", F.struct(F.lit("all").alias("summary"), F.array(F.col("title")).alias("topics"), F.array().cast("array<string>").alias("aliases"), F.array(F.lit("q?")).alias("questions")).alias("card"), F.array(F.lit(0.25)).alias("embedding"))
    return A.navigation_rows(cards, profiles)


@query("""WITH t AS (SELECT c_custkey % 50 AS version, min(c_name) AS title FROM customer GROUP BY 1)
SELECT c_custkey % 50 AS version, (c_custkey % 50) || CASE WHEN c_custkey % 3 = 0 THEN ':rsp:' ELSE ':rn:' END || lpad(CAST(c_custkey // 50 AS VARCHAR), 6, '0') || CASE WHEN c_custkey % 3 = 0 THEN ':' || lpad(CAST(c_custkey % 4 AS VARCHAR), 2, '0') ELSE '' END AS card_id,
  CASE WHEN c_custkey % 3 = 0 THEN 'HEADING_SUBPARTITION' ELSE 'HEADING_NODE' END AS card_type, md5('Document: ' || title || chr(10) || 'Section: ' || c_mktsegment || ' > ' || c_name || chr(10) || 'Summary: ' || c_mktsegment || chr(10) || 'Topics: ' || c_name || chr(10) || 'Questions: q?') AS digest FROM customer JOIN t ON t.version = c_custkey % 50
UNION ALL SELECT version, version || ':rp:document', 'DOCUMENT_PROFILE', md5('Document: ' || title || chr(10) || 'Summary: all' || chr(10) || 'Topics: ' || title || chr(10) || 'Questions: q?') FROM t""")
def navigation_index(s, d):
    return _navigation(s, d).select("version", "card_id", "card_type", F.md5("embedding_text").alias("digest"))


@query("""WITH v AS (SELECT DISTINCT c_custkey % 50 AS version FROM customer), n AS (SELECT c_custkey % 50 AS version, count(*) AS nodes FROM customer GROUP BY 1)
SELECT version, CASE version % 8 WHEN 1 THEN 'NO_HEADER' WHEN 2 THEN 'NO_FOOTER' WHEN 3 THEN 'UNKNOWN_RECORD' WHEN 4 THEN 'UNKNOWN_SCHEMA' WHEN 5 THEN 'COUNT_MISMATCH' WHEN 6 THEN 'DIGEST_MISMATCH' WHEN 7 THEN 'BLANK_LINE' END AS error, CASE WHEN version % 8 = 5 THEN nodes - 1 ELSE nodes END AS nodes FROM v JOIN n USING (version)""")
def retrieval_round_trip(s, d):
    """JSON lines written and read again: whole, or without a header or footer, with another record, schema, count or text, or a blank line."""
    v, n = F.col("version"), F.col("n")
    rows = _navigation(s, d).select("version", "card_id", "card_type", F.col("embedding_text").alias("text")).withColumn("n", (F.row_number().over(Window.partitionBy("version").orderBy(F.col("card_type") != "DOCUMENT_PROFILE", "card_id")) - 1).cast("int"))
    headers = rows.select("version").distinct().select("version", F.sha2(v.cast("string"), 256).alias("fingerprint"))
    lines = A.retrieval_lines(rows, headers).withColumn("at", F.row_number().over(Window.partitionBy("version").orderBy("section", "n")))
    case = v % 8
    kept = lines.where(~((case == 1) & (F.col("section") == 0)) & ~((case == 2) & (F.col("section") == 3)) & ~((case == 5) & (F.col("section") == 2) & (n == 1)))
    line = F.col("line")
    spoilt = (
        F.when((case == 3) & (F.col("section") == 1), F.replace(line, F.lit('"recordType":"profile"'), F.lit('"recordType":"other"'))).when((case == 4) & (F.col("section") == 0), F.replace(line, F.lit('"schemaVersion":2'), F.lit('"schemaVersion":3')))
        .when((case == 6) & (F.col("section") == 1), F.replace(line, F.lit("Summary: all"), F.lit("Summary: other"))).otherwise(line)
    )
    blank = lines.where((case == 7) & (F.col("section") == 1)).select("version", F.lit(" ").alias("line"), F.col("at") + 0.5)
    return A.read_retrieval_lines(kept.select("version", spoilt.alias("line"), F.col("at").cast("double").alias("at")).union(blank))


@query(r"""SELECT p_partkey, 'Section: ' || p_name || chr(10) || 'Summary: ' || p_type || chr(10) || 'Topics: ' || p_brand || ' | ' || p_type || chr(10) || 'Questions: ' AS card, CASE WHEN p_size % 2 = 0 THEN p_brand || chr(10) ELSE '' END || p_name AS document FROM part""")
def rendered_cards(s, d):
    card = F.struct(F.col("p_type").alias("summary"), F.array("p_brand", "p_type").alias("topics"), F.array().cast("array<string>").alias("questions"))
    return table(s, d, "part").select("p_partkey", A.temporary_card(F.col("p_name"), card).alias("card"), A.rerank_document(F.when(F.col("p_size") % 2 == 0, F.col("p_brand")), F.col("p_name")).alias("document"))


@query()
def reduced_texts(s, d):
    """Every document as a source of at most 200 estimated tokens, by rounds of summaries (tested against a plain loop)."""
    texts = table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")
    found = A.reduce_texts(texts, 200, lambda piece: A.temporary_card(F.lit("part"), A.extract(piece, F.lit("part"))))
    return found.select(F.col("id").alias("doc_id"), "rounds", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"), "error")


QUERIES, SQL = Q, S
