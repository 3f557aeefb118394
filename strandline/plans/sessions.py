"""Queries of the answer loop: limits, caches, opened evidence, the last packages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.adapters import stored, table
from strandline.operators import session as E

Q, S = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


@query("""WITH c AS (SELECT o_custkey AS session, row_number() OVER w AS seq, (row_number() OVER w + 2) // 3 AS round, o_orderkey % 3 = 0 AS tool, CAST(o_orderkey % 40 AS BIGINT) + row_number() OVER w * 30 AS secs FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
n AS (SELECT *, count(*) FILTER (WHERE tool) OVER w AS t, count(*) FILTER (WHERE NOT tool) OVER w AS m FROM c WINDOW w AS (PARTITION BY session ORDER BY seq)),
x AS (SELECT *, CASE WHEN secs >= 300 THEN 'EXECUTION_TIMEOUT' WHEN round > 4 OR t > 3 OR m > 6 THEN 'EXECUTION_LIMIT_EXCEEDED' END AS why FROM n), y AS (SELECT session, min(seq) AS seq, arg_min(why, seq) AS why FROM x WHERE why IS NOT NULL GROUP BY session)
SELECT x.session, x.seq, y.seq IS NULL OR x.seq < y.seq AS runs, CASE WHEN x.seq >= y.seq THEN y.why END AS stop FROM x LEFT JOIN y ON y.session = x.session""")
def loop_limits(s, d):
    """Scripted sessions under small limits."""
    k, n = F.col("o_orderkey"), F.col("seq")
    rows = table(s, d, "orders").select(F.col("o_custkey").alias("session"), F.row_number().over(Window.partitionBy("o_custkey").orderBy(k)).alias("seq"), k)
    calls = rows.select("session", "seq", F.floor((n + 2) / 3).alias("round"), F.when(k % 3 == 0, "TOOL").otherwise("MODEL").alias("kind"), (k % 40 + n * 30).alias("at"))
    return E.loop_limits(calls, 4, 3, 6)


@query("""WITH c AS (SELECT user_id AS session, event_id AS seq, event_type AS signature FROM events) SELECT session, seq, 'r' || min(seq) OVER (PARTITION BY session, signature) AS result, seq = min(seq) OVER (PARTITION BY session, signature) AS ran FROM c""")
def cached_results(s, d):
    calls = table(s, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.col("event_type").alias("signature"))
    return E.cached_results(calls, calls.select("session", "seq", F.concat(F.lit("r"), F.col("seq").cast("string")).alias("result")))


_BLOCKS = """bk AS (SELECT l_suppkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS INTEGER) AS ordinal, l_orderkey, l_linenumber, l_quantity FROM lineitem),
bl AS (SELECT doc_id, ordinal, ordinal // 20 AS heading, CASE WHEN doc_id % 2 = 0 THEN ordinal // 15 END AS page, CASE WHEN ordinal % 30 < 12 THEN ordinal // 30 END AS table_id, CASE WHEN ordinal % 5 > 0 THEN 'h' || (ordinal % 3) END AS header, CAST(l_quantity AS BIGINT) AS tokens FROM bk)"""


def _blocks(s, d):
    o = F.col("ordinal")
    rows = table(s, d, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")).alias("ordinal"), "l_quantity")
    whole = lambda n: F.floor(o / n).cast("int")
    return rows.select(
        "doc_id", "ordinal", whole(20).alias("heading"), F.when(F.col("doc_id") % 2 == 0, whole(15)).alias("page"), F.when(o % 30 < 12, whole(30)).alias("table_id"),
        F.when(o % 5 > 0, F.concat(F.lit("h"), (o % 3).cast("string"))).alias("header"), F.col("l_quantity").cast("long").alias("tokens"),
    )


@query(f"""WITH {_BLOCKS}, a AS (SELECT 's' || doc_id AS session, 'E' || ordinal AS evidence, ['PAGE', 'TABLE', 'COLUMN'][ordinal % 3 + 1] AS view, * FROM bl WHERE ordinal % 17 = 0),
x AS (SELECT *, CASE WHEN view = 'COLUMN' AND table_id IS NOT NULL AND header IS NOT NULL THEN 'EVIDENCE_COLUMN' WHEN view <> 'PAGE' AND table_id IS NOT NULL THEN 'EVIDENCE_TABLE' WHEN page IS NOT NULL THEN 'EVIDENCE_PAGE' ELSE 'EVIDENCE_NEIGHBORHOOD' END AS scope FROM a)
SELECT session, evidence, scope, b.ordinal AS shown FROM x JOIN bl b ON b.doc_id = x.doc_id AND b.table_id = x.table_id AND b.header = x.header WHERE scope = 'EVIDENCE_COLUMN'
UNION ALL SELECT session, evidence, scope, b.ordinal FROM x JOIN bl b ON b.doc_id = x.doc_id AND b.table_id = x.table_id WHERE scope = 'EVIDENCE_TABLE'
UNION ALL SELECT session, evidence, scope, b.ordinal FROM x JOIN bl b ON b.doc_id = x.doc_id AND b.page = x.page WHERE scope = 'EVIDENCE_PAGE'
UNION ALL SELECT session, evidence, scope, b.ordinal FROM (SELECT *, unnest(range(ordinal - 3, ordinal + 4)) AS near FROM x WHERE scope = 'EVIDENCE_NEIGHBORHOOD') y JOIN bl b ON b.doc_id = y.doc_id AND b.ordinal = y.near AND b.heading = y.heading""")
def opened_evidence(s, d):
    """Every seventeenth block opened as a page, a table or a column."""
    blocks = _blocks(s, d)
    o = F.col("ordinal")
    view = F.get(F.array(F.lit("PAGE"), F.lit("TABLE"), F.lit("COLUMN")), (o % 3).cast("int"))
    anchors = blocks.where(o % 17 == 0).select(F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("session"), F.concat(F.lit("E"), o.cast("string")).alias("evidence"), "doc_id", "ordinal", view.alias("view"))
    return E.opened_evidence(blocks, anchors)


@query()
def final_packages(s, d):
    """Each document's session: the packages of every sixth block as evidence under a small budget (tested against a plain version)."""
    blocks = stored(_blocks(s, d), "session-blocks")
    o = F.col("ordinal")
    evidence = blocks.where(o % 6 == 0).select(F.col("doc_id").alias("session"), o.alias("n"), F.concat_ws(":", F.col("doc_id").cast("string"), o.cast("string")).alias("evidence"), "doc_id", "ordinal")
    return E.final_packages(evidence, blocks, 4_000)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority ELSE o_orderpriority || chr(10) || chr(10) || '参考依据：' || array_to_string(list_transform(range(1, o_orderkey % 4 + 1), lambda k: '[' || k || ']'), '') END AS answer FROM orders""")
def cited_answers(s, d):
    k = F.col("o_orderkey")
    cited = F.when(k % 4 == 0, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(1).cast("long"), F.greatest(k % 4, F.lit(1))))
    return table(s, d, "orders").select("o_orderkey", E.cited_answer(F.col("o_orderpriority"), cited).alias("answer"))


QUERIES, SQL = Q, S
