"""Streaming queries over ``events``, run to the end of the input; their SQL is that of the batch twin."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.adapters import shared_dir, table
from strandline.sources import bulk as U
from strandline.streaming import outbox as O
from strandline.streaming import pipelines as P
from strandline.streaming import stateful as W

Q, S = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


def _stream(s, d, ts=True):
    """The events table as a stream. It is one file or a folder of files."""
    schema = table(s, d, "events").schema
    rows = s.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet" if _is_dir(s, f"{d}/events.parquet") else f"{d}/event[s].parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if ts else rows


def _is_dir(s, path):
    p = s.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def run_to_end(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Write all that is there to a Parquet folder beside the checkpoint, and read that."""
    s = df.sparkSession
    path = f"{shared_dir(s)}/strandline/stream-{name}-{uuid.uuid4().hex}"
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
    else:
        write = lambda b, n: b.write.mode("overwrite").parquet(f"{path}/out/batch={n}")
        q = df.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.schema(df.schema).parquet(f"{path}/out") if mode == "append" else s.read.schema(df.schema).parquet(f"{path}/out").select(*df.columns)


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_deduplicate(s, d):
    return run_to_end(P.deduplicate(_stream(s, d), ["user_id", "event_type"], "ts", "60 days").select("user_id", "event_type"), "dedup")


@query("""WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT start, start + INTERVAL 1 HOUR AS "end", event_type, n FROM w""")
def stream_windows(s, d):
    found = run_to_end(P.windowed_counts(_stream(s, d), "ts", "event_type", "1 hour"), "windows", "complete")
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS "end", user_id, count(*) AS beats FROM s GROUP BY user_id, k""")
def stream_sessions(s, d):
    found = run_to_end(P.sessions(_stream(s, d), "ts", "user_id", "6 hours"), "sessions", "complete")
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "user_id", "beats")


@query("""SELECT event_id AS job_id, event_id % 5 AS attempt, CASE WHEN event_id % 11 = 0 OR event_id % 5 > 3 THEN 'DEAD_LETTER' ELSE 'RETRY' END AS route,
CASE WHEN NOT (event_id % 11 = 0 OR event_id % 5 > 3) THEN date_trunc('second', ts) + to_seconds(CASE event_id % 5 WHEN 2 THEN 30 WHEN 3 THEN 300 ELSE 5 END) END AS due_at FROM events WHERE event_type = 'error'""")
def stream_retries(s, d):
    k = F.col("event_id")
    failures = _stream(s, d).where("event_type = 'error'").select(k.alias("job_id"), (k % 5).alias("attempt"), F.col("ts").alias("failed_at"), (k % 11 != 0).alias("retryable"))
    return run_to_end(P.retry_step(failures), "retries").withColumn("due_at", F.col("due_at").cast("timestamp_ntz"))


@query("""SELECT user_id AS request_id, arg_min(event, (ts, event)) AS terminal FROM (SELECT *, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' WHEN 'click' THEN 'cancelled' ELSE 'delta' END AS event FROM events) WHERE event <> 'delta' GROUP BY user_id""")
def stream_terminal_events(s, d):
    t = F.col("event_type")
    event = F.when(t == "purchase", "done").when(t == "error", "error").when(t == "click", "cancelled").otherwise("delta")
    return run_to_end(P.first_terminal(_stream(s, d).select(F.col("user_id").alias("request_id"), event.alias("event"), "ts"), "ts"), "terminal", "complete")


@query()
def stream_idempotency(s, d):
    """The streaming twin of ``idempotency_claims`` (a test compares the two)."""
    at = F.unix_seconds(F.col("ts"))
    rows = _stream(s, d).select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("key"), F.col("event_id").alias("seq"), at.alias("at"), F.when(F.col("value") >= 10, at + F.col("value").cast("long")).alias("done_at"), F.pmod("event_id", F.lit(2)).cast("string").alias("fingerprint"), (F.col("event_id") / 5000).cast("long").cast("string").alias("context"))
    return run_to_end(P.idempotency(rows, 86_400, 432_000, expire=False), "claims")


@query("""SELECT DISTINCT user_id AS document_id FROM events WHERE event_type = 'error' AND user_id % 3 = 0""")
def stream_deletions(s, d):
    """Deletion messages, delivered more than once, of documents that are still being deleted."""
    messages = _stream(s, d).where("event_type = 'error'").select(F.col("user_id").alias("document_id"), "ts")
    facts = table(s, d, "events").select(F.col("user_id").alias("document_id"), F.when(F.col("user_id") % 3 == 0, "DELETING").otherwise("DELETED").alias("state")).distinct()
    return run_to_end(P.consume(messages, facts, "document_id", "ts", "DELETING", "60 days").select("document_id"), "deletions")


@query("""WITH a AS (SELECT doc_id AS request_id, text, CASE WHEN doc_id % 10 = 0 THEN 'ANSWER_MODEL_UNAVAILABLE' END AS error, CAST(ceil(length(text) / 500) AS INTEGER) AS n FROM documents)
SELECT request_id, 0 AS seq, 'start' AS event, '' AS data FROM a UNION ALL SELECT request_id, 1, 'progress', 'GENERATING' FROM a UNION ALL SELECT request_id, i + 1, 'delta', substr(text, (i - 1) * 500 + 1, 500) FROM a, unnest(range(1, n + 1)) t(i)
UNION ALL SELECT request_id, n + 2, CASE WHEN error IS NULL THEN 'done' ELSE 'error' END, coalesce(error, CAST(length(text) AS VARCHAR)) FROM a""")
def stream_answer_events(s, d):
    """Texts as streamed answers in pieces of 500 characters."""
    schema = table(s, d, "documents").schema
    path = f"{d}/documents.parquet"
    rows = s.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_dir(s, path) else f"{d}/document[s].parquet")
    answers = rows.select(F.col("doc_id").alias("request_id"), F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("doc_id") % 10 == 0, "ANSWER_MODEL_UNAVAILABLE").alias("error"))
    return run_to_end(P.answer_events(answers, 500), "answer-events")


_MARKED = "regexp_replace(x, '([A-Za-z0-9]+)', chr(1) || '\\1' || chr(2), 'g')"


@query(f"""SELECT doc_id, CAST(length(v) AS BIGINT) AS n, md5(v) AS digest FROM (
SELECT doc_id, replace(replace(regexp_replace({_MARKED}, '\\x01[ERSers][1-9][0-9]*\\x02', '', 'g'), chr(1), ''), chr(2), '') AS v FROM (
SELECT doc_id, regexp_replace('See e1  [E2, e33] s4: ' || text || ' R5', '\\[\\s*[Ee][1-9][0-9]*(\\s*[,，]\\s*[Ee][1-9][0-9]*)*\\s*\\]', '', 'g') AS x FROM documents))""")
def answer_deltas(s, d):
    """Every document's text as a streamed JSON answer in fragments of 64 characters; what of it shows."""
    answer = F.concat(F.lit("See e1  [E2, e33] s4: "), "text", F.lit(" R5"))
    rows = table(s, d, "documents").select("doc_id", F.to_json(F.struct(F.lit("ANSWERED").alias("status"), answer.alias("answer"))).alias("json"))

    def run(batches):
        import pyarrow as pa

        from strandline.streaming.deltas import visible_text

        for b in batches:
            for k in range(0, b.num_rows, 64):
                few = b.slice(k, 64)
                yield pa.RecordBatch.from_arrays([few.column(0), pa.array([visible_text(x) for x in few.column(1).to_pylist()], pa.string())], names=["doc_id", "v"])

    shown = rows.mapInArrow(run, "doc_id long, v string")
    return shown.select("doc_id", F.length("v").cast("long").alias("n"), F.md5("v").alias("digest"))


#: Timers fire when the watermark has passed them: an hour behind the latest event.
_PASSED = "(SELECT max(epoch_ms(ts)) - 3600000 FROM events)"


@query(f"""WITH f AS (SELECT user_id % 500 AS job_id, event_id AS seq, CAST(floor(epoch(ts)) AS BIGINT) AS "at", event_id % 11 <> 0 AS ok FROM events WHERE event_type IN ('error', 'click')),
n AS (SELECT *, count(*) FILTER (WHERE ok) OVER w AS k, count(*) FILTER (WHERE NOT ok) OVER w AS bad FROM f WINDOW w AS (PARTITION BY job_id ORDER BY "at", seq ROWS UNBOUNDED PRECEDING)),
r AS (SELECT job_id, CASE WHEN bad > 0 OR k > 3 THEN 'DEAD_LETTER' ELSE 'RETRY' END AS route, k, "at" FROM n)
SELECT job_id, CAST(k AS INTEGER) AS attempt, route, "at" + CASE k WHEN 1 THEN 5 WHEN 2 THEN 30 ELSE 300 END AS "at" FROM r WHERE route = 'RETRY' AND ("at" + CASE k WHEN 1 THEN 5 WHEN 2 THEN 30 ELSE 300 END) * 1000 <= {_PASSED}
UNION ALL SELECT job_id, CAST(CASE WHEN row_number() OVER (PARTITION BY job_id ORDER BY "at", seq) = 1 THEN (SELECT count(*) FROM r x WHERE x.job_id = n.job_id AND x.route = 'RETRY') ELSE 3 END + 1 AS INTEGER), 'DEAD_LETTER', "at" FROM n WHERE bad > 0 OR k > 3""")
def stream_due_retries(s, d):
    """Failures of jobs; the stream itself emits each retry when it is due."""
    k = F.col("event_id")
    failures = _stream(s, d).where("event_type IN ('error', 'click')").select((F.col("user_id") % 500).alias("job_id"), k.alias("seq"), F.col("ts").alias("failed_at"), (k % 11 != 0).alias("retryable"))
    return run_to_end(W.retries(failures, "1 hour"), "due-retries")


@query(f"""WITH RECURSIVE m AS (SELECT user_id % 200 AS resource, event_id AS seq, CAST(floor(epoch(ts)) AS BIGINT) AS "at", 'w' || (event_id % 3) AS owner, event_type IN ('click', 'purchase') AS claim FROM events),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY resource ORDER BY "at", seq) AS n FROM m),
t AS (
  SELECT resource, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS holder, CAST(0 AS BIGINT) AS fence, CAST(0 AS BIGINT) AS ends, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS owner, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS BIGINT) AS "at", CAST(NULL AS VARCHAR) AS gone, CAST(0 AS BIGINT) AS gone_fence, CAST(0 AS BIGINT) AS gone_at FROM (SELECT DISTINCT resource FROM o)
  UNION ALL
  SELECT t.resource, o.n, CASE WHEN o.claim AND (t.holder IS NULL OR o."at" >= t.ends) THEN o.owner WHEN o."at" < t.ends THEN t.holder END,
    t.fence + CASE WHEN o.claim AND (t.holder IS NULL OR o."at" >= t.ends) THEN 1 ELSE 0 END,
    CASE WHEN o.claim AND (t.holder IS NULL OR o."at" >= t.ends) OR NOT o.claim AND t.holder = o.owner AND o."at" < t.ends THEN o."at" + 21600 WHEN t.holder IS NOT NULL AND o."at" < t.ends THEN t.ends ELSE 0 END,
    o.seq, o.owner, CASE WHEN o.claim AND (t.holder IS NULL OR o."at" >= t.ends) THEN 'GRANTED' WHEN NOT o.claim AND coalesce(t.holder = o.owner, false) AND o."at" < t.ends THEN 'EXTENDED' ELSE 'REFUSED' END, o."at",
    CASE WHEN o."at" >= t.ends THEN t.holder END, t.fence, t.ends
  FROM t JOIN o ON o.resource = t.resource AND o.n = t.n + 1),
z AS (SELECT resource, arg_max(holder, n) AS holder, arg_max(fence, n) AS fence, arg_max(ends, n) AS ends FROM (SELECT resource, n, coalesce(holder, '') AS holder, fence, ends FROM t) GROUP BY resource)
SELECT resource, seq, owner, outcome, fence, "at" FROM t WHERE n > 0
UNION ALL SELECT resource, -1, gone, 'EXPIRED', gone_fence, gone_at FROM t WHERE gone IS NOT NULL
UNION ALL SELECT resource, -1, holder, 'EXPIRED', fence, ends FROM z WHERE holder <> '' AND ends * 1000 <= {_PASSED}""")
def stream_leases(s, d):
    """Claims and heartbeats of workers on resources, with fencing numbers and leases of six hours."""
    k = F.col("event_id")
    messages = _stream(s, d).select((F.col("user_id") % 200).alias("resource"), k.alias("seq"), F.col("ts").alias("sent_at"), F.concat(F.lit("w"), (k % 3).cast("string")).alias("owner"), F.col("event_type").isin("click", "purchase").alias("claim"))
    return run_to_end(W.leases(messages, "1 hour", 21_600), "leases").fillna(-1, ["seq"])


@query("""SELECT event_id AS id, coalesce(props, '') AS payload FROM events""")
def outbox_published(s, d):
    """Every event through the outbox source and the sink that writes each batch once."""
    path = f"{shared_dir(s)}/strandline/outbox-{uuid.uuid4().hex}"
    O.append(table(s, d, "events").select(F.col("event_id").alias("id"), F.coalesce("props", F.lit("")).alias("payload")), f"{path}/queue")
    O.register(s)
    q = O.publisher(O.pending(s, f"{path}/queue", 100_000), f"{path}/sent", f"{path}/state").start()
    q.processAllAvailable()
    q.stop()
    return O.published(s, f"{path}/sent", "id long, payload string")


@query("""SELECT o_orderkey AS id, md5(o_orderpriority || o_orderstatus) AS source FROM orders""")
def bulk_written(s, d):
    """Orders as index actions through the bulk writer, and read back."""
    path = f"{shared_dir(s)}/strandline/bulk-{uuid.uuid4().hex}"
    rows = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.md5(F.concat("o_orderpriority", "o_orderstatus")).alias("source"))
    U.write(rows, path)
    return U.read(s, path, "id long, source string").select("id", "source")


QUERIES, SQL = Q, S
