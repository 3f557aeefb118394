"""Service-shaped tables out of the star schema, as DataFrames and as SQL for the oracles.

tenant = region, knowledge base = nation, document = customer, version = order,
processing job = line item, query audit = event.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

READY, PROCESSING, FAILED = "READY", "PROCESSING", "FAILED"


#: Tables whose rows are long texts.
TEXTS = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(found) if name in TEXTS else found


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt to all cores if it is read in fewer splits than there are; so only what is small in any case is dealt anew."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows of one task where a step sorts its rows in memory.
TASK_ROWS = 500_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, dealt by ``keys`` so that a task gets about ``TASK_ROWS`` rows, if the cores are too few for that; what sorts them then needs no more memory as they grow."""
    parts = -(-df.count() // TASK_ROWS)
    return df.repartition(parts, *keys) if parts > df.sparkSession.sparkContext.defaultParallelism else df


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share; where it is unset and all run in one process, a local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: what reads it repeats no work, also after an executor is lost."""
    path = f"{shared_dir(df.sparkSession)}/strandline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stream_fold(df: DataFrame, keys: list[str], order: list[str], start, step, schema: str) -> DataFrame:
    """A fold over each group's rows in order, one output row for each: ``keys``, then what ``schema`` names.

    ``step(state, row)`` gives the next state and the output; ``start()`` the first state of
    a group.  Partitions are sorted and read as a stream, so a group of any size needs
    one state and never a row of its own.
    """
    names = df.columns
    kinds = [(f.name, f.dataType.simpleString()) for k in keys for f in df.schema.fields if f.name == k]
    fields = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        import pandas as pd

        key, state = None, None
        for b in batches:
            out = []
            for values in zip(*(b[c].tolist() for c in names), strict=True):
                row = {c: None if isinstance(v, float) and v != v else v for c, v in zip(names, values, strict=True)}
                here = tuple(row[k] for k in keys)
                if here != key:
                    key, state = here, start()
                state, got = step(state, row)
                out.append((*here, *got))
            yield pd.DataFrame(out, columns=[*keys, *fields])

    kept = df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order)
    return kept.mapInPandas(run, ", ".join([f"{n} {t}" for n, t in kinds] + [schema]))


def ladder(*steps, otherwise):
    """First matching (condition, value) wins."""
    out = None
    for when, value in steps:
        out = F.when(when, F.lit(value)) if out is None else out.when(when, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def kbs(spark, d) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("kb_id"), F.col("n_regionkey").alias("tenant_id"), F.col("n_name").alias("kb_name"))


def versions(spark, d) -> DataFrame:
    """``version_id, document_id, version_no, status, sha, created_at``."""
    o = table(spark, d, "orders")
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    status = ladder((F.col("o_orderstatus") == "F", READY), (F.col("o_orderstatus") == "O", PROCESSING), otherwise=FAILED)
    return o.select(
        F.col("o_orderkey").alias("version_id"), F.col("o_custkey").alias("document_id"), F.row_number().over(order).cast("long").alias("version_no"),
        status.alias("status"), F.sha2(F.col("o_orderpriority"), 256).alias("sha"), F.col("o_orderdate").alias("created_at"),
    )


def documents(spark, d) -> DataFrame:
    """``document_id, tenant_id, kb_id, name, doc_status, active_version_id, latest_version_id`` of documents with a version."""
    c = table(spark, d, "customer")
    v = versions(spark, d).groupBy("document_id").agg(
        F.max_by(F.when(F.col("status") == READY, F.col("version_id")), F.when(F.col("status") == READY, F.col("version_no"))).alias("active_version_id"),
        F.max_by("version_id", "version_no").alias("latest_version_id"),
    )
    base = c.join(kbs(spark, d), F.col("c_nationkey") == F.col("kb_id"))
    status = ladder((F.col("c_acctbal") < -900, "DELETED"), (F.col("c_acctbal") < -500, "DELETING"), otherwise="ACTIVE")
    return base.join(v, F.col("c_custkey") == F.col("document_id")).select(F.col("c_custkey").alias("document_id"), "tenant_id", "kb_id", F.col("c_name").alias("name"), status.alias("doc_status"), "active_version_id", "latest_version_id")


def jobs(spark, d) -> DataFrame:
    """``job_id, version_id, attempt_no, job_status, retryable, lease_owner, lease_until``."""
    l = table(spark, d, "lineitem")
    status = ladder(
        ((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N"), "RUNNING"), (F.col("l_returnflag") == "R", "FAILED"), (F.col("l_returnflag") == "A", "SUCCEEDED"), otherwise="PENDING"
    )
    return l.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("job_id"), F.col("l_orderkey").alias("version_id"), F.col("l_linenumber").cast("long").alias("attempt_no"),
        status.alias("job_status"), (F.col("l_suppkey") % 3 != 0).alias("retryable"), F.concat(F.lit("w"), (F.col("l_suppkey") % 4).cast("string")).alias("lease_owner"), F.col("l_shipdate").alias("lease_until"),
    )


def audits(spark, d) -> DataFrame:
    """``id, application_id, kb_id, operation, outcome, duration_ms, started_at, props``."""
    e = table(spark, d, "events")
    outcome = ladder((F.col("event_type") == "click", "STARTED"), (F.col("event_type") == "error", "FAILED"), otherwise="SUCCEEDED")
    operation = ladder((F.col("event_type").isin("view", "click"), "RETRIEVE"), otherwise="ANSWER")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("application_id"), (F.col("event_id") % 7).alias("kb_id"), operation.alias("operation"), outcome.alias("outcome"), F.col("value").alias("duration_ms"), F.col("ts").alias("started_at"), "props")


#: The same tables for the oracles.
SQL = """
kbs AS (SELECT n_nationkey AS kb_id, n_regionkey AS tenant_id, n_name AS kb_name FROM nation),
versions AS (
  SELECT o_orderkey AS version_id, o_custkey AS document_id,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version_no,
         CASE o_orderstatus WHEN 'F' THEN 'READY' WHEN 'O' THEN 'PROCESSING' ELSE 'FAILED' END AS status,
         sha256(o_orderpriority) AS sha, o_orderdate AS created_at
  FROM orders),
latest AS (
  SELECT document_id, arg_max(version_id, version_no) FILTER (WHERE status = 'READY') AS active_version_id,
         arg_max(version_id, version_no) AS latest_version_id
  FROM versions GROUP BY document_id),
docs AS (
  SELECT c_custkey AS document_id, tenant_id, kb_id, c_name AS name,
         CASE WHEN c_acctbal < -900 THEN 'DELETED' WHEN c_acctbal < -500 THEN 'DELETING' ELSE 'ACTIVE' END AS doc_status,
         active_version_id, latest_version_id
  FROM customer JOIN kbs ON c_nationkey = kb_id JOIN latest ON document_id = c_custkey),
jobs AS (
  SELECT l_orderkey * 10 + l_linenumber AS job_id, l_orderkey AS version_id, CAST(l_linenumber AS BIGINT) AS attempt_no,
         CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN 'RUNNING' WHEN l_returnflag = 'R' THEN 'FAILED'
              WHEN l_returnflag = 'A' THEN 'SUCCEEDED' ELSE 'PENDING' END AS job_status,
         l_suppkey % 3 <> 0 AS retryable, 'w' || CAST(l_suppkey % 4 AS VARCHAR) AS lease_owner, l_shipdate AS lease_until
  FROM lineitem),
audits AS (
  SELECT event_id AS id, user_id AS application_id, event_id % 7 AS kb_id,
         CASE WHEN event_type IN ('view', 'click') THEN 'RETRIEVE' ELSE 'ANSWER' END AS operation,
         CASE event_type WHEN 'click' THEN 'STARTED' WHEN 'error' THEN 'FAILED' ELSE 'SUCCEEDED' END AS outcome,
         value AS duration_ms, ts AS started_at, props
  FROM events)
"""


def oracle(body: str) -> str:
    """SQL over the adapters: ``body`` continues the WITH list or is a SELECT."""
    glue = "," if not body.lstrip().upper().startswith("SELECT") else ""
    return f"WITH {SQL}{glue}{body}"
