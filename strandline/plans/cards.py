"""Queries of cards, packing and answer sessions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.adapters import table
from strandline.operators import canonical as C
from strandline.operators import cards as K
from strandline.operators import session as A
from strandline.plans.structure import BLOCKS, TREE, _parsed

Q, S = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


PACK = """WITH RECURSIVE i AS (SELECT o_custkey AS g, o_orderkey AS o, CAST(o_totalprice AS BIGINT) AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
p AS (SELECT g, o, n, s AS total, 1 AS items, 0 AS batch FROM i WHERE n = 1 UNION ALL
  SELECT i.g, i.o, i.n, CASE WHEN f THEN s ELSE total + s END, CASE WHEN f THEN 1 ELSE items + 1 END, batch + CASE WHEN f THEN 1 ELSE 0 END FROM (SELECT p.*, i.o AS o2, i.s, p.items >= 4 OR p.total + i.s > 600000 AS f FROM p JOIN i ON i.g = p.g AND i.n = p.n + 1) x JOIN i ON i.g = x.g AND i.o = x.o2)
SELECT g AS o_custkey, o AS o_orderkey, batch FROM p"""


@query(PACK.replace("CASE WHEN f THEN s ELSE total + s END", "CASE WHEN f THEN i.s ELSE total + i.s END"))
def greedy_batches(s, d):
    rows = table(s, d, "orders").select("o_custkey", "o_orderkey", F.rint("o_totalprice").cast("long").alias("size"))
    return K.greedy_batches(rows, "o_custkey", "o_orderkey", "size", 4, 600_000)


@query("""SELECT o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 20 AS batch FROM orders""")
def fixed_batches(s, d):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return table(s, d, "orders").select("o_orderkey", F.floor((n - 1) / 20).alias("batch"))


@query("""SELECT o_orderkey, greatest(2, CAST(ceil(t / 64000.0) AS BIGINT)) AS min_parts, least(6, greatest(2, CAST(ceil(t / 64000.0) AS BIGINT)) + 1) AS max_parts, greatest(2, CAST(ceil(t / 64000.0) AS BIGINT)) > 6 AS too_large FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS t FROM orders)""")
def partition_bounds(s, d):
    return table(s, d, "orders").select("o_orderkey", *K.partition_bounds(F.floor("o_totalprice"), 64_000, 6))


@query()
def partition_plan(s, d):
    """Best partitions of orders into runs of line items (tested against enumeration)."""
    strength = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber").cast("long"))
    blocks = F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("o"), F.col("l_quantity").cast("long").alias("tokens"), strength.alias("strength"))))
    return K.plan_partitions(table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("section")).agg(blocks.alias("blocks")), 80, 10)


@query("""WITH c AS (SELECT l_orderkey AS section, l_linenumber AS n, l_linenumber - 1 + CASE WHEN l_suppkey % 9 = 0 THEN -1 ELSE 0 END AS start, repeat('t', CAST(l_quantity * 3 AS INTEGER)) AS title, l_partkey % 7 AS strength, l_partkey % 10 AS topics, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k FROM lineitem),
x AS (SELECT *, lag(start) OVER (PARTITION BY section ORDER BY k) AS last FROM c)
SELECT section, error, count(*) AS n FROM (SELECT section, 'NOT_INCREASING' AS error FROM x WHERE start <= last UNION ALL SELECT section, 'NOT_FROM_START' FROM x WHERE k = 1 AND start <> 0 UNION ALL SELECT section, 'BAD_TITLE' FROM x WHERE length(title) > 120 OR length(title) = 0 UNION ALL SELECT section, 'BAD_STRENGTH' FROM x WHERE strength NOT BETWEEN 1 AND 5 UNION ALL SELECT section, 'BAD_TOPICS' FROM x WHERE topics NOT BETWEEN 1 AND 8) GROUP BY ALL""")
def candidate_errors(s, d):
    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    start = F.col("l_linenumber") - 1 + F.when(F.col("l_suppkey") % 9 == 0, -1).otherwise(0)
    return K.candidate_errors(table(s, d, "lineitem").select(F.col("l_orderkey").alias("section"), k.alias("n"), start.alias("start"), F.expr("repeat('t', cast(l_quantity * 3 as int))").alias("title"), (F.col("l_partkey") % 7).alias("strength"), F.expr("array_repeat('topic', cast(l_partkey % 10 as int))").alias("topics")))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN CAST(l_orderkey AS VARCHAR) || ':rp:document' WHEN l_linenumber < 5 THEN CAST(l_orderkey AS VARCHAR) || ':rn:' || lpad(CAST(l_linenumber AS VARCHAR), 6, '0') ELSE CAST(l_orderkey AS VARCHAR) || ':rsp:' || lpad(CAST(l_linenumber AS VARCHAR), 6, '0') || ':' || lpad(CAST(l_suppkey % 7 AS VARCHAR), 2, '0') END AS card_id FROM lineitem""")
def card_ids(s, d):
    n = F.col("l_linenumber")
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", K.card_ids(F.col("l_orderkey"), F.when(n > 1, n), F.when(n >= 5, F.col("l_suppkey") % 7)).alias("card_id"))


@query("""SELECT p_partkey AS card_id, concat_ws(',', CASE WHEN p_size % 14 = 0 OR p_size % 14 > 12 THEN 'topics' END, CASE WHEN p_size % 16 > 12 THEN 'aliases' END, CASE WHEN p_size % 10 > 8 THEN 'questions' END, CASE WHEN p_size * 15 > 600 THEN 'summary' END) AS errors FROM part""")
def semantic_errors(s, d):
    n = F.col("p_size")
    many = lambda m: F.when(n % m > 0, F.array_repeat(F.lit("t"), (n % m).cast("int"))).otherwise(F.array().cast("array<string>"))
    return K.semantic_errors(table(s, d, "part").select(F.col("p_partkey").alias("card_id"), many(14).alias("topics"), many(16).alias("aliases"), many(10).alias("questions"), F.expr("repeat('s', p_size * 15)").alias("summary")))


@query("""WITH c AS (SELECT p_partkey AS card_id, p_partkey % 3 = 0 AS profile, repeat('s', p_size * 15) || CASE WHEN p_partkey % 50 = 0 THEN '' ELSE 'x' END AS text, list_transform(range(0, p_size % 15), lambda i: 't' || CASE WHEN p_partkey % 11 = 0 AND i = 1 THEN '0 ' ELSE CAST(i AS VARCHAR) END) AS topics,
  CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE list_transform(range(0, p_size % 14), lambda i: repeat('a', i * 7 + 1)) END AS aliases, list_transform(range(0, p_size % 10), lambda i: CASE WHEN i = 3 AND p_partkey % 7 = 0 THEN '  ' ELSE repeat('q', i + 1) END) AS questions FROM part),
u AS (SELECT *, length(text) BETWEEN 1 AND CASE WHEN profile THEN 400 ELSE 600 END AS a, len(topics) BETWEEN 1 AND 12 AND len(list_distinct(list_transform(topics, lambda x: trim(x)))) = len(topics) AS b, coalesce(len(aliases) <= 12 AND len(list_filter(aliases, lambda x: length(x) > 80)) = 0, false) AS c,
  len(questions) BETWEEN CASE WHEN profile THEN 1 ELSE 0 END AND 8 AND len(list_filter(questions, lambda x: trim(x) = '')) = 0 AS q FROM c)
SELECT card_id, concat_ws(',', CASE WHEN NOT a THEN CASE WHEN profile THEN 'purpose' ELSE 'summary' END END, CASE WHEN NOT b THEN 'topics' END, CASE WHEN NOT c THEN 'aliases' END, CASE WHEN NOT q THEN 'questions' END) AS errors FROM u""")
def semantic_violations(s, d):
    """Parts as cards and profiles with lists of many lengths; some have items twice, blank, too long or none."""
    k, n = F.col("p_partkey"), F.col("p_size")
    listed = lambda m, f: F.when(n % m > 0, F.transform(F.sequence(F.lit(0), F.greatest(n % m, F.lit(1)).cast("int") - 1), f)).otherwise(F.array().cast("array<string>"))
    topics = listed(15, lambda i: F.concat(F.lit("t"), F.when((k % 11 == 0) & (i == 1), "0 ").otherwise(i.cast("string"))))
    aliases = F.when(k % 13 > 0, listed(14, lambda i: F.repeat(F.lit("a"), i * 7 + 1)))
    questions = listed(10, lambda i: F.when((i == 3) & (k % 7 == 0), "  ").otherwise(F.repeat(F.lit("q"), i + 1)))
    text = F.concat(F.expr("repeat('s', p_size * 15)"), F.when(k % 50 == 0, "").otherwise("x"))
    return K.semantic_violations(table(s, d, "part").select(k.alias("card_id"), (k % 3 == 0).alias("profile"), text.alias("text"), topics.alias("topics"), aliases.alias("aliases"), questions.alias("questions")))


@query(f"""WITH {BLOCKS} SELECT d.doc_id, true AS valid, count(b.text) AS n_blocks, sha256(coalesce(string_agg(b.text, chr(10) || chr(10) ORDER BY b.ordinal), '')) AS text_sha256 FROM documents d LEFT JOIN blocks b USING (doc_id) GROUP BY d.doc_id""")
def json_lines_round_trip(s, d):
    blocks = C.assemble(_parsed(s, d))
    return K.read_json_lines(K.json_lines(table(s, d, "documents").select("doc_id"), blocks))


@query(f"""WITH RECURSIVE {BLOCKS}, {TREE}, b AS (SELECT *, coalesce((SELECT max(h.ordinal) FROM blocks h WHERE h.doc_id = x.doc_id AND h.ordinal <= x.ordinal AND h.level IS NOT NULL), -1) AS heading FROM blocks x)
SELECT b.doc_id, b.ordinal, d.lang AS tenant_id, d.source AS kb_id, 'D' || b.doc_id AS title, CASE WHEN level IS NULL THEN 'PARAGRAPH' ELSE 'HEADING' END AS kind, b.heading, coalesce(w.path, '') AS heading_path, sha256(b.text) AS text_sha256, start, start + length(b.text) AS "end", src + 1 AS start_line, sha256(d.text) AS artifact_sha256, md5(d.source) AS fingerprint
FROM b JOIN documents d ON d.doc_id = b.doc_id LEFT JOIN walk w ON w.doc_id = b.doc_id AND w.pos = b.heading""")
def evidence_index_rows(s, d):
    blocks = C.assemble(_parsed(s, d)).withColumn("start_line", F.col("src") + 1)
    docs = table(s, d, "documents")
    documents = docs.select("doc_id", F.col("lang").alias("tenant_id"), F.col("source").alias("kb_id"), F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("title"))
    manifests = docs.select("doc_id", F.sha2("text", 256).alias("artifact_sha256"), F.md5("source").alias("fingerprint"))
    rows = K.evidence_rows(blocks, C.heading_tree(blocks), documents, manifests)
    return rows.select("doc_id", "ordinal", "tenant_id", "kb_id", "title", "kind", "heading", "heading_path", F.sha2("text", 256).alias("text_sha256"), "start", "end", "start_line", "artifact_sha256", "fingerprint")


@query("""SELECT session, key, 'E' || CAST(row_number() OVER (PARTITION BY session ORDER BY first, key) AS VARCHAR) AS evidence_id FROM (SELECT user_id AS session, event_id % 17 AS key, min(event_id) AS first FROM events GROUP BY ALL)""")
def evidence_numbers(s, d):
    return A.evidence_numbers(table(s, d, "events").select(F.col("user_id").alias("session"), (F.col("event_id") % 17).alias("key"), F.col("event_id").alias("at")))


@query(f"""WITH {BLOCKS}, w AS (SELECT doc_id, ordinal // 7 AS w, min(ordinal) AS first, max(ordinal) AS last FROM blocks GROUP BY ALL) SELECT *, lag(w) OVER (PARTITION BY doc_id ORDER BY w) AS previous, lead(w) OVER (PARTITION BY doc_id ORDER BY w) AS next FROM w""")
def adjacent_windows(s, d):
    return A.adjacent_windows(C.assemble(_parsed(s, d)))


@query("""SELECT doc, page, row_number() OVER (PARTITION BY doc ORDER BY first) AS position FROM (SELECT l_suppkey AS doc, l_orderkey % 12 AS page, min(l_partkey * 100000 + l_orderkey % 100000) AS first FROM lineitem GROUP BY ALL)""")
def reading_order(s, d):
    return A.reading_order(table(s, d, "lineitem").select(F.col("l_suppkey").alias("doc"), (F.col("l_orderkey") % 12).alias("page"), (F.col("l_partkey") * 100000 + F.col("l_orderkey") % 100000).alias("ordinal")))


@query("""WITH RECURSIVE i AS (SELECT o_custkey AS session, o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS cost, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
p AS (SELECT session, k, n, CASE WHEN cost <= 500000 THEN cost ELSE 0 END AS used, cost <= 500000 AS accepted FROM i WHERE n = 1 UNION ALL SELECT i.session, i.k, i.n, p.used + CASE WHEN p.used + i.cost <= 500000 THEN i.cost ELSE 0 END, p.used + i.cost <= 500000 FROM p JOIN i ON i.session = p.session AND i.n = p.n + 1) SELECT session, k AS n, accepted FROM p""")
def evidence_token_budget(s, d):
    return A.accept_budget(table(s, d, "orders").select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("n"), F.floor("o_totalprice").alias("cost")), 500_000)


@query("""WITH x AS (SELECT c_custkey, c_custkey % 90 AS a, c_custkey % 35 AS b, c_custkey % 61 AS c FROM customer), y AS (SELECT *, least(a, 33) AS u FROM x), z AS (SELECT *, least(b, greatest(1, (100 - u) // 2)) AS v FROM y) SELECT c_custkey, CAST(u AS BIGINT) AS first, CAST(v AS BIGINT) AS second, CAST(least(c, greatest(1, 100 - u - v)) AS BIGINT) AS third FROM z""")
def citation_shares(s, d):
    k = F.col("c_custkey")
    share = A.fair_share(F.array(k % 90, k % 35, k % 61), 100)
    return table(s, d, "customer").select("c_custkey", share.alias("s")).select("c_custkey", F.get("s", F.lit(0)).alias("first"), F.get("s", F.lit(1)).alias("second"), F.get("s", F.lit(2)).alias("third"))


@query("""SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 2 = 0 AND c_custkey % 5 <> 0 THEN 'E1' END, CASE WHEN c_custkey % 3 = 0 THEN 'E2' END) AS cited FROM customer""")
def citation_filter(s, d):
    k = F.col("c_custkey")
    pick = lambda *xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    cited = A.accepted_citations(F.array(F.lit("E1"), F.lit("E9"), F.lit("E2"), F.lit("E1")), pick(F.when(k % 2 == 0, "E1"), F.lit("E2"), F.lit("E3")), pick(F.when(k % 5 != 0, "E1"), F.when(k % 3 == 0, "E2")))
    return table(s, d, "customer").select("c_custkey", F.array_join(cited, ",").alias("cited"))


@query("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'NOT_AN_OBJECT' WHEN 1 THEN 'WRONG_KEYS' WHEN 2 THEN 'BAD_STATUS' WHEN 3 THEN 'EMPTY_ANSWER' WHEN 4 THEN 'NO_CITATION' WHEN 5 THEN 'CITED_REFUSAL' END AS error FROM events""")
def final_answer_contract(s, d):
    texts = ["[1]", '{"status":"ANSWERED","answer":"x"}', '{"status":"X","answer":"x","evidenceIds":[]}', '{"status":"ANSWERED","answer":" ","evidenceIds":["E1"]}', '{"status":"ANSWERED","answer":"x","evidenceIds":[]}', '{"status":"INSUFFICIENT_EVIDENCE","answer":"","evidenceIds":["E1"]}', '{"status":"ANSWERED","answer":"x","evidenceIds":["E1"]}', '{"status":"INSUFFICIENT_EVIDENCE","answer":"","evidenceIds":[]}']
    return table(s, d, "events").select("event_id", A.final_answer_error(F.get(F.array(*[F.lit(t) for t in texts]), (F.col("event_id") % 8).cast("int"))).alias("error"))


@query(f"""WITH RECURSIVE {BLOCKS}, {TREE} SELECT doc_id, pos, walk.depth, par.title, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n, count(*) OVER (PARTITION BY doc_id) > 3 AS truncated FROM par JOIN walk USING (doc_id, pos) QUALIFY n <= 3""")
def outline_budget(s, d):
    return A.outline(C.heading_tree(C.assemble(_parsed(s, d))), 3)


@query(f"""WITH RECURSIVE {BLOCKS}, {TREE}, b AS (SELECT *, coalesce((SELECT max(h.ordinal) FROM blocks h WHERE h.doc_id = x.doc_id AND h.ordinal <= x.ordinal AND h.level IS NOT NULL), -1) AS heading FROM blocks x)
SELECT p.doc_id, p.pos, (SELECT count(*) FROM par c WHERE c.doc_id = p.doc_id AND c.parent = p.pos) AS children, o.blocks, o.chars, o.chars > 500 AS narrow FROM par p JOIN (SELECT doc_id, heading, count(*) AS blocks, CAST(sum(length(text)) AS BIGINT) AS chars FROM b GROUP BY ALL) o ON o.doc_id = p.doc_id AND o.heading = p.pos""")
def section_read(s, d):
    blocks = C.assemble(_parsed(s, d))
    return A.section_read(blocks, C.heading_tree(blocks), 500)


_PLAIN = r"length(regexp_replace(text, '[^\x00-\x7F]', '', 'g'))"


@query(f"""WITH RECURSIVE {BLOCKS}, {TREE}, b AS (SELECT *, coalesce((SELECT max(h.ordinal) FROM blocks h WHERE h.doc_id = x.doc_id AND h.ordinal <= x.ordinal AND h.level IS NOT NULL), -1) AS heading FROM blocks x),
tk AS (SELECT doc_id, heading AS pos, CAST(sum(greatest(1, ({_PLAIN} + 3) // 4 + length(text) - {_PLAIN})) AS BIGINT) AS tokens FROM b WHERE trim(text) <> '' GROUP BY ALL),
pr AS (SELECT DISTINCT doc_id, parent AS pos FROM par WHERE parent >= 0),
hd AS (SELECT p.doc_id, p.pos, p.parent, p.title, pr.pos IS NOT NULL AS has_children, coalesce(tokens, 0) AS tokens, coalesce(tokens, 0) > 60 AS narrow FROM par p LEFT JOIN tk ON tk.doc_id = p.doc_id AND tk.pos = p.pos LEFT JOIN pr ON pr.doc_id = p.doc_id AND pr.pos = p.pos)
SELECT doc_id, pos, 'SECTION' AS kind, CAST(pos AS BIGINT) AS ref, title, has_children, tokens, narrow FROM hd
UNION ALL SELECT h.doc_id, h.pos, 'CHILD', c.pos, c.title, c.has_children, h.tokens, h.narrow FROM hd h JOIN hd c ON c.doc_id = h.doc_id AND c.parent = h.pos
UNION ALL SELECT h.doc_id, h.pos, 'BLOCK', b.ordinal, '', false, h.tokens, h.narrow FROM hd h JOIN b ON b.doc_id = h.doc_id AND b.heading = h.pos WHERE NOT h.narrow AND trim(b.text) <> ''""")
def opened_sections(s, d):
    """Every section opened with 60 tokens left: its blocks if they fit, and its children."""
    blocks = C.assemble(_parsed(s, d))
    tree = C.heading_tree(blocks)
    return A.opened_sections(blocks, tree, tree.select("doc_id", "pos", F.lit(60).alias("remaining")))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1 + CASE WHEN contains(text, 'the ') THEN 1 ELSE 0 END END AS kept FROM documents WHERE length(text) > 0""")
def highlight_safety(s, d):
    f = F.array(F.left("text", F.lit(12)), F.lit("the "), F.left("text", F.lit(12)), F.lit("absent"))
    return table(s, d, "documents").where(F.length("text") > 0).select("doc_id", F.size(A.safe_highlights(f, F.col("text"), F.col("doc_id") % 5 == 0)).alias("kept"))


@query("""SELECT l_orderkey AS group, min(l_linenumber) AS first_line, max(l_linenumber) AS last_line, CASE WHEN count(DISTINCT l_suppkey % 3) = 1 THEN min(l_suppkey % 3) END AS page FROM lineitem GROUP BY l_orderkey""".replace("AS group", 'AS "group"'))
def merged_positions(s, d):
    return A.merged_position(table(s, d, "lineitem").select(F.col("l_orderkey").alias("group"), F.col("l_linenumber").alias("line"), (F.col("l_suppkey") % 3).alias("page")))


@query("""SELECT query_id, item, rank, CASE WHEN n > 8 THEN 8 END AS next_offset FROM (SELECT o_custkey AS query_id, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE rank > 4 AND rank <= 8""")
def cursor_page(s, d):
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return A.cursor_page(table(s, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("item"), F.row_number().over(order).alias("rank")), 4, 4)


QUERIES, SQL = Q, S
