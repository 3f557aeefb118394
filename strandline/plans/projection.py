"""Queries of projections and session caches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strandline.adapters import shared_dir, table
from strandline.operators import projection as P
from strandline.operators import projection_store as T

Q, S = {}, {}


def query(sql: str):
    def add(f):
        Q[f.__name__] = f
        S[f.__name__] = sql
        return f

    return add


@query("""WITH w AS (SELECT o_orderkey AS version_id, md5(o_orderpriority || o_orderstatus) AS fingerprint FROM orders), b AS (SELECT o_orderkey AS version_id, md5(o_orderpriority || CASE WHEN o_orderkey % 5 = 0 THEN 'F' ELSE o_orderstatus END) AS fingerprint, o_orderkey % 3 <> 0 AS complete FROM orders)
SELECT version_id, fingerprint FROM w WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.complete AND b.version_id = w.version_id AND b.fingerprint = w.fingerprint)""")
def projection_reuse(s, d):
    o, k = table(s, d, "orders"), F.col("o_orderkey")
    wanted = o.select(k.alias("version_id"), F.md5(F.concat("o_orderpriority", "o_orderstatus")).alias("fingerprint"))
    built = o.select(k.alias("version_id"), F.md5(F.concat("o_orderpriority", F.when(k % 5 == 0, "F").otherwise(F.col("o_orderstatus")))).alias("fingerprint"), (k % 3 != 0).alias("complete"))
    return P.to_rebuild(wanted, built, "version_id").select("version_id", "fingerprint")


@query("""SELECT o_custkey, count(*) AS n, sha256(string_agg(o_orderpriority || chr(10), '' ORDER BY o_orderkey, o_orderpriority)) AS digest FROM orders GROUP BY o_custkey""")
def card_digests(s, d):
    return P.ordered_digest(table(s, d, "orders"), "o_custkey", "o_orderkey", "o_orderpriority")


@query("""SELECT p_brand, count(*) AS n, sha256(string_agg('{"p_partkey":' || p_partkey || ',"p_type":"' || p_type || '","p_size":' || p_size || '}' || chr(10), '' ORDER BY p_partkey)) AS semantic_digest, sha256(string_agg(p_name, '' ORDER BY p_partkey)) AS vector_digest FROM part GROUP BY p_brand""")
def artifact_digests(s, d):
    """Parts as the cards of their brands; a name's bytes stand for a vector."""
    cards = table(s, d, "part").withColumn("payload", F.base64(F.col("p_name").cast("binary")))
    return P.artifact_digests(cards, "p_brand", "p_partkey", ["p_partkey", "p_type", "p_size"], "payload")


CELLS = """c AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS cell_id, l_suppkey AS table_id, CAST(l_orderkey % 200 AS INTEGER) AS row, l_returnflag || CAST(l_linenumber AS VARCHAR) AS header FROM lineitem)"""


@query(f"""WITH {CELLS}, a AS (SELECT cell_id AS anchor, table_id, header, row AS place FROM c WHERE cell_id % 97 = 0) SELECT anchor, cell_id, row_number() OVER (PARTITION BY anchor ORDER BY abs(row - place), row, cell_id) AS n FROM a JOIN c USING (table_id, header) WHERE row <> place QUALIFY n <= 5""")
def same_column_expansion(s, d):
    k = F.col("l_orderkey")
    cells = table(s, d, "lineitem").select((k * 10 + F.col("l_linenumber")).alias("cell_id"), F.col("l_suppkey").alias("table_id"), (k % 200).cast("int").alias("row"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("header")).distinct()
    return P.expand_same_column(cells, cells.where("cell_id % 97 = 0").withColumnRenamed("cell_id", "anchor"))


@query("""WITH r AS (SELECT o_orderkey AS rank, o_custkey AS version, CAST(o_orderkey % 4 - 1 AS INTEGER) AS heading FROM orders) SELECT rank, version, heading FROM r WHERE heading >= 0 OR version NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 2000)""")
def root_placeholders(s, d):
    ranked = table(s, d, "orders").select(F.col("o_orderkey").alias("rank"), F.col("o_custkey").alias("version"), (F.col("o_orderkey") % 4 - 1).cast("int").alias("heading"))
    return P.keep_root_placeholders(ranked, table(s, d, "customer").where("c_acctbal > 2000").select(F.col("c_custkey").alias("version"))).select("rank", "version", "heading")


@query("""SELECT user_id AS session, event_id AS seq, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS repeat FROM events""")
def tool_call_cache(s, d):
    calls = table(s, d, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("signature"), F.col("event_id").alias("seq"))
    return P.first_calls(calls).select("session", "seq", "repeat")


@query("""SELECT user_id AS request_id, count(*) FILTER (WHERE event_type = 'view') AS model_calls, count(*) FILTER (WHERE event_type <> 'view') AS tool_calls, count(DISTINCT event_id % 5) FILTER (WHERE event_type <> 'view') AS tool_rounds, CAST(sum(length(props)) AS BIGINT) AS characters,
CAST(sum(event_id % 3) AS BIGINT) AS evidence, CAST(coalesce(sum(event_id % 2) FILTER (WHERE event_type = 'view'), 0) AS BIGINT) AS citations FROM events GROUP BY user_id""")
def telemetry_rollup(s, d):
    k, model = F.col("event_id"), F.col("event_type") == "view"
    calls = table(s, d, "events").select(F.col("user_id").alias("request_id"), F.when(model, "MODEL").otherwise("TOOL").alias("kind"), (k % 5).alias("round"), F.length("props").alias("characters"), (k % 3).alias("evidence"), F.when(model, k % 2).alias("citations"))
    return P.telemetry(calls)


@query("""SELECT CAST(o_custkey % 40 AS VARCHAR) AS scope, o_orderkey, CASE WHEN o_custkey % 40 % 3 = 0 THEN o_orderpriority ELSE o_orderstatus END AS value FROM orders""")
def stored_projection(s, d):
    """Two runs over forty scopes: the second replaces every third of them, after one that was stopped before its manifest."""
    path = f"{shared_dir(s)}/strandline/projection-{uuid.uuid4().hex}"
    scope = F.col("o_custkey") % 40
    rows = lambda value: table(s, d, "orders").select(scope.alias("scope"), "o_orderkey", value.alias("value"))
    named = lambda r, fingerprint: r.select("scope").distinct().select("scope", fingerprint.alias("fingerprint"))
    first, changed = rows(F.col("o_orderstatus")), F.col("scope") % 3 == 0
    T.project(named(first, F.lit("a")), first, path, 1)
    stopped = rows(F.lit("lost"))
    T.write_rows(named(stopped, F.lit("b")), stopped, path)
    second = rows(F.when(scope % 3 == 0, F.col("o_orderpriority")).otherwise(F.col("o_orderstatus")))
    T.project(named(second, F.when(changed, "b").otherwise("a")), second, path, 2)
    return T.current(s, path, "o_orderkey long, value string").select("scope", "o_orderkey", "value")


QUERIES, SQL = Q, S
