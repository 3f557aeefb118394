"""Queries of the control plane."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline import adapters as A
from strandline.adapters import ladder, oracle
from strandline.operators import control as C

NOW = "2024-02-01 00:00:00"
Q, S = {}, {}


def query(sql: str):
    def add(f):
        Q[f.__name__] = f
        S[f.__name__] = sql
        return f

    return add


@query(oracle("""SELECT tenant_id, kb_id, d.document_id, v.version_id, v.version_no FROM docs d
JOIN versions v ON v.version_id = d.active_version_id AND v.document_id = d.document_id WHERE doc_status = 'ACTIVE' AND v.status = 'READY'"""))
def snapshot_active_versions(s, d):
    return C.active_snapshot(A.documents(s, d), A.versions(s, d))


@query(oracle("""SELECT d.document_id, d.name, v.version_no, v.status FROM docs d JOIN versions v ON v.version_id = d.latest_version_id
WHERE contains(d.name, '1') AND v.status = 'PROCESSING' ORDER BY d.document_id DESC LIMIT 20 OFFSET 10"""))
def documents_page(s, d):
    v = A.versions(s, d).select(F.col("version_id").alias("latest_version_id"), "version_no", "status")
    rows = C.where_all(A.documents(s, d).join(v, "latest_version_id"), F.contains("name", F.lit("1")), F.col("status") == "PROCESSING", None)
    return C.page(rows, F.desc("document_id"), limit=20, offset=10).select("document_id", "name", "version_no", "status")


@query(oracle("""SELECT j.job_id, j.attempt_no, j.job_status, v.version_no, d.name, k.kb_name FROM jobs j JOIN versions v ON v.version_id = j.version_id
JOIN docs d ON d.document_id = v.document_id JOIN kbs k ON k.kb_id = d.kb_id WHERE j.job_status = 'FAILED' ORDER BY j.job_id DESC LIMIT 50"""))
def jobs_page_joined(s, d):
    v = A.versions(s, d).select("version_id", "document_id", "version_no")
    docs = A.documents(s, d).select("document_id", "kb_id", "name")
    rows = A.jobs(s, d).where(F.col("job_status") == "FAILED").join(v, "version_id").join(docs, "document_id").join(A.kbs(s, d).select("kb_id", "kb_name"), "kb_id")
    return C.page(rows, F.desc("job_id"), limit=50).select("job_id", "attempt_no", "job_status", "version_no", "name", "kb_name")


@query(oracle("""SELECT version_id, attempt_no, job_id, job_status FROM jobs QUALIFY row_number() OVER (PARTITION BY version_id ORDER BY attempt_no DESC, job_id DESC, job_status DESC) = 1"""))
def latest_attempt_per_version(s, d):
    return C.latest_attempt(A.jobs(s, d)).select("version_id", "attempt_no", "job_id", "job_status")


@query("""SELECT c_custkey AS admin_id, c_name AS admin_name, n_name AS tenant_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey = 1""")
def admin_left_tenant(s, d):
    n = A.table(s, d, "nation").where("n_regionkey = 1").select("n_nationkey", F.col("n_name").alias("tenant_name"))
    return A.table(s, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("c_custkey").alias("admin_id"), F.col("c_name").alias("admin_name"), "tenant_name")


@query(oracle("""SELECT v.document_id, count(*) AS in_progress FROM jobs j JOIN versions v USING (version_id) WHERE j.job_status IN ('PENDING', 'RUNNING') GROUP BY v.document_id"""))
def jobs_in_progress(s, d):
    j = A.jobs(s, d).where(F.col("job_status").isin("PENDING", "RUNNING")).groupBy("version_id").agg(F.count(F.lit(1)).alias("n"))
    return j.join(A.versions(s, d).select("version_id", "document_id"), "version_id").groupBy("document_id").agg(F.sum("n").alias("in_progress"))


@query("""
WITH req AS (
  SELECT event_id, user_id AS application, CAST(event_id % 40 AS INTEGER) AS kb, CASE WHEN event_type = 'purchase' THEN 'WRITE' ELSE 'READ' END AS required FROM events),
j AS (
  SELECT event_id, required, c_custkey AS application_id,
         CASE WHEN c_acctbal < 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS application_status,
         CASE WHEN a.n_regionkey = 4 THEN 'INACTIVE' ELSE 'ACTIVE' END AS tenant_status, a.n_regionkey AS tenant_id,
         k.n_nationkey AS kb_id, k.n_regionkey AS kb_tenant_id, CASE WHEN k.n_nationkey % 5 = 3 THEN 'INACTIVE' ELSE 'ACTIVE' END AS kb_status,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'READ' WHEN 'MACHINERY' THEN 'WRITE' WHEN 'AUTOMOBILE' THEN 'READ_WRITE' WHEN 'FURNITURE' THEN 'OTHER' END AS permission
  FROM req LEFT JOIN customer ON c_custkey = application LEFT JOIN nation a ON a.n_nationkey = c_nationkey LEFT JOIN nation k ON k.n_nationkey = kb)
SELECT event_id, CASE
  WHEN application_id IS NULL THEN 'CREDENTIAL_UNKNOWN' WHEN application_status <> 'ACTIVE' THEN 'APPLICATION_INACTIVE' WHEN tenant_status <> 'ACTIVE' THEN 'TENANT_INACTIVE'
  WHEN kb_id IS NULL OR kb_tenant_id <> tenant_id THEN 'KB_NOT_FOUND' WHEN kb_status <> 'ACTIVE' THEN 'KB_INACTIVE' WHEN permission IS NULL THEN 'GRANT_MISSING'
  WHEN NOT (permission IN ('READ', 'WRITE', 'READ_WRITE') AND (permission = 'READ_WRITE' OR permission = required)) THEN 'PERMISSION_DENIED' ELSE 'GRANTED' END AS reason
FROM j""")
def authorize_reason(s, d):
    req = A.table(s, d, "events").select("event_id", F.col("user_id").alias("application"), (F.col("event_id") % 40).cast("int").alias("kb"), F.when(F.col("event_type") == "purchase", "WRITE").otherwise("READ").alias("required"))
    nation = A.table(s, d, "nation").select("n_nationkey", "n_regionkey")
    seg = F.col("c_mktsegment")
    permission = F.when(seg == "BUILDING", "READ").when(seg == "MACHINERY", "WRITE").when(seg == "AUTOMOBILE", "READ_WRITE").when(seg == "FURNITURE", "OTHER")
    app = A.table(s, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("application_id"), F.when(F.col("c_acctbal") < 0, "INACTIVE").otherwise("ACTIVE").alias("application_status"),
        F.when(F.col("n_regionkey") == 4, "INACTIVE").otherwise("ACTIVE").alias("tenant_status"), F.col("n_regionkey").alias("tenant_id"), permission.alias("permission"),
    )
    kb = nation.select(F.col("n_nationkey").alias("kb_id"), F.col("n_regionkey").alias("kb_tenant_id"), F.when(F.col("n_nationkey") % 5 == 3, "INACTIVE").otherwise("ACTIVE").alias("kb_status"))
    joined = req.join(app, F.col("application") == F.col("application_id"), "left").join(kb, F.col("kb") == F.col("kb_id"), "left")
    return C.authorize(joined).select("event_id", "reason")


@query(oracle("""SELECT id, application_id, operation, outcome FROM audits WHERE started_at >= TIMESTAMP '2024-01-10' AND started_at < TIMESTAMP '2024-01-20'
AND operation = 'RETRIEVE' AND outcome = 'SUCCEEDED' ORDER BY started_at DESC, id DESC LIMIT 100 OFFSET 50"""))
def audit_page_filtered(s, d):
    rows = C.filter_audits(A.audits(s, d), started_from="2024-01-10", started_to="2024-01-20", operation="RETRIEVE", outcome="SUCCEEDED")
    return C.page(rows, F.desc("started_at"), F.desc("id"), limit=100, offset=50).select("id", "application_id", "operation", "outcome")


@query(oracle("""SELECT v.version_id, v.status FROM versions v WHERE v.version_id IN (SELECT active_version_id FROM docs WHERE kb_id IN (3, 7) AND doc_status = 'ACTIVE')"""))
def scope_filter(s, d):
    scope = A.documents(s, d).where(F.col("kb_id").isin(3, 7) & (F.col("doc_status") == "ACTIVE")).select(F.col("active_version_id").alias("version_id"))
    return A.versions(s, d).join(scope, "version_id", "left_semi").select("version_id", "status")


@query(oracle("""SELECT version_id, document_id, version_no FROM versions WHERE document_id IN (1, 4, 7, 10, 100)"""))
def in_list_fetch(s, d):
    return A.versions(s, d).where(F.col("document_id").isin(1, 4, 7, 10, 100)).select("version_id", "document_id", "version_no")


@query("""SELECT g AS granted, r AS required, count(*) AS n, g IN ('READ', 'WRITE', 'READ_WRITE') AND r IN ('READ', 'WRITE') AND (g = 'READ_WRITE' OR g = r) AS allowed
FROM (SELECT CASE l_linenumber WHEN 1 THEN 'READ' WHEN 2 THEN 'WRITE' WHEN 3 THEN 'READ_WRITE' ELSE 'X' END AS g, CASE l_returnflag WHEN 'A' THEN 'READ' WHEN 'N' THEN 'WRITE' ELSE 'Y' END AS r FROM lineitem) GROUP BY g, r""")
def permission_lattice(s, d):
    n, f = F.col("l_linenumber"), F.col("l_returnflag")
    g = F.when(n == 1, "READ").when(n == 2, "WRITE").when(n == 3, "READ_WRITE").otherwise("X").alias("granted")
    r = F.when(f == "A", "READ").when(f == "N", "WRITE").otherwise("Y").alias("required")
    return A.table(s, d, "lineitem").select(g, r).groupBy("granted", "required").agg(F.count(F.lit(1)).alias("n")).withColumn("allowed", C.allows(F.col("granted"), F.col("required")))


@query("""SELECT p_partkey AS object_key FROM part WHERE TIMESTAMP '2024-01-01' + to_hours(p_size * 24) < TIMESTAMP '2024-02-01' - INTERVAL 24 HOURS
AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_linenumber > 6 AND l_quantity > 40)""")
def orphan_objects(s, d):
    modified = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("p_size"))
    objects = A.table(s, d, "part").select(F.col("p_partkey").alias("object_key"), modified.alias("modified_at"))
    refs = A.table(s, d, "lineitem").where("l_linenumber > 6 AND l_quantity > 40").select(F.col("l_partkey").alias("object_key"))
    return C.orphans(objects, refs, "object_key", NOW).select("object_key")


@query(oracle("""m AS (SELECT version_id, min(attempt_no) AS a, max(attempt_no) AS b, count(*) AS n FROM jobs GROUP BY version_id)
SELECT v.version_id, v.status, m.b AS expected, m.n AS actual FROM versions v JOIN m USING (version_id) WHERE NOT (m.b = m.n AND m.a = 1 AND v.status <> 'FAILED')"""))
def lineage_drift(s, d):
    m = A.jobs(s, d).groupBy("version_id").agg(F.min("attempt_no").alias("a"), F.max("attempt_no").alias("expected"), F.count(F.lit(1)).alias("actual"))
    same = (F.col("expected") == F.col("actual")) & (F.col("a") == 1) & (F.col("status") != "FAILED")
    return A.versions(s, d).join(m, "version_id").where(~same).select("version_id", "status", "expected", "actual")


@query(oracle("""SELECT tenant_id, count(*) AS documents, count(*) FILTER (WHERE doc_status = 'ACTIVE') AS active, count(DISTINCT kb_id) AS kbs, count(active_version_id) AS with_active FROM docs GROUP BY tenant_id"""))
def tenant_counts(s, d):
    return C.tenant_counts(A.documents(s, d))


@query("""SELECT s_suppkey AS application_id, s_name AS application_name FROM supplier WHERE s_nationkey < 12 ORDER BY s_suppkey LIMIT 10 OFFSET 5""")
def entity_page(s, d):
    rows = A.table(s, d, "supplier").where("s_nationkey < 12").select(F.col("s_suppkey").alias("application_id"), F.col("s_name").alias("application_name"))
    return C.page(rows, F.col("application_id"), limit=10, offset=5)


@query(oracle("""SELECT version_id, document_id, version_no FROM versions QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY version_no DESC, version_id DESC) <= 3"""))
def versions_newest_first(s, d):
    v = A.versions(s, d)
    return v.withColumn("r", C.window_rank("document_id", F.desc("version_no"), F.desc("version_id"))).where("r <= 3").select("version_id", "document_id", "version_no")


@query(oracle("""SELECT id, 'INTERRUPTED' AS outcome, CAST(floor(date_diff('microsecond', started_at, TIMESTAMP '2024-02-01') / 1000) AS BIGINT) AS duration_ms
FROM audits WHERE outcome = 'STARTED' AND started_at < TIMESTAMP '2024-02-01' - INTERVAL 15 MINUTES ORDER BY id LIMIT 200"""))
def audit_mark_interrupted(s, d):
    return C.interrupted(A.audits(s, d), NOW)


@query(oracle("""SELECT id FROM audits WHERE outcome <> 'STARTED' AND started_at < TIMESTAMP '2024-04-10' - INTERVAL 90 DAYS ORDER BY id LIMIT 200"""))
def audit_retention_delete(s, d):
    return C.expired(A.audits(s, d), "2024-04-10 00:00:00")


QUEUE_SQL = """SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'PENDING' WHEN 'click' THEN 'LOCKED' ELSE 'SENT' END AS state, ts + INTERVAL 2 HOURS AS available_at, ts + INTERVAL 5 MINUTES AS locked_until, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS payload_k FROM events"""


def _queue(s, d):
    e = A.table(s, d, "events")
    state = F.when(F.col("event_type") == "view", "PENDING").when(F.col("event_type") == "click", "LOCKED").otherwise("SENT")
    return e.select(F.col("event_id").alias("id"), state.alias("state"), (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("available_at"), (F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("locked_until"))


@query(f"""WITH q AS ({QUEUE_SQL}) SELECT id, 'LOCKED' AS state, 'w1' AS owner, TIMESTAMP '2024-01-15 00:02:00' AS locked_until FROM q
WHERE (state = 'PENDING' AND available_at <= TIMESTAMP '2024-01-15') OR (state = 'LOCKED' AND locked_until < TIMESTAMP '2024-01-15') ORDER BY id LIMIT 50""")
def outbox_claim(s, d):
    return C.claim(_queue(s, d), "2024-01-15 00:00:00", "w1")


@query("""SELECT l_orderkey, l_linenumber AS attempt, CAST(CASE WHEN l_linenumber <= 1 THEN 1 WHEN l_linenumber = 2 THEN 5 WHEN l_linenumber = 3 THEN 30 WHEN l_linenumber = 4 THEN 120 ELSE 600 END AS BIGINT) AS seconds FROM lineitem""")
def outbox_backoff(s, d):
    return A.table(s, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("attempt"), C.backoff_seconds(F.col("l_linenumber")).alias("seconds"))


@query(oracle("""x AS (SELECT job_id, job_status, lease_owner, CASE job_id % 4 WHEN 3 THEN 'w2' ELSE 'w1' END AS r_owner, ['RELEASE', 'SUCCEED', 'FAIL'][job_id % 3 + 1] AS action FROM jobs),
y AS (SELECT *, CASE WHEN action = 'FAIL' THEN job_status IN ('PENDING', 'RUNNING') AND (lease_owner IS NULL OR lease_owner = r_owner) ELSE job_status = 'RUNNING' AND coalesce(lease_owner = r_owner, false) END AS ok FROM x)
SELECT job_id, ok AS changed, CASE WHEN ok THEN CASE action WHEN 'RELEASE' THEN 'PENDING' WHEN 'SUCCEED' THEN 'SUCCEEDED' ELSE 'FAILED' END ELSE job_status END AS status, CASE WHEN NOT ok THEN lease_owner END AS lease_owner,
  CASE WHEN ok AND action = 'FAIL' THEN 'PARSE' END AS code, CASE WHEN ok AND action = 'FAIL' THEN job_id % 2 = 0 END AS retryable, CASE WHEN ok AND action <> 'RELEASE' THEN TIMESTAMP '1996-01-01' END AS finished_at FROM y"""))
def job_outcomes(s, d):
    k = F.col("job_id")
    jobs = A.jobs(s, d).select("job_id", "job_status", "lease_owner")
    requests = jobs.select("job_id", F.when(k % 4 == 3, "w2").otherwise("w1").alias("owner"), F.get(F.array(F.lit("RELEASE"), F.lit("SUCCEED"), F.lit("FAIL")), (k % 3).cast("int")).alias("action"), F.lit("PARSE").alias("code"), (k % 2 == 0).alias("retryable")).distinct()
    return C.job_after(jobs, requests, "1996-01-01 00:00:00")


_QUEUE = """q AS (SELECT o_orderkey AS id, ['PENDING', 'LOCKED', 'SENT'][o_orderkey % 3 + 1] AS state, CASE WHEN o_orderkey % 3 = 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END END AS owner, o_orderdate AS locked_until, o_orderdate AS available_at, o_orderkey % 7 AS attempts FROM orders)"""


@query(f"""WITH {_QUEUE}, x AS (SELECT *, state = 'LOCKED' AND owner = 'a' AND id % 5 < 4 AS mine, state = 'LOCKED' AND locked_until < TIMESTAMP '1996-06-01' AS old, id % 5 < 2 AS sent FROM q), y AS (SELECT *, old AND NOT coalesce(mine, false) AS stale FROM x)
SELECT id, CASE WHEN mine AND sent THEN 'SENT' WHEN mine OR stale THEN 'PENDING' ELSE state END AS state, CASE WHEN NOT (coalesce(mine, false) OR stale) THEN owner END AS owner,
  CASE WHEN mine AND NOT sent THEN TIMESTAMP '1996-06-01' + to_seconds([1, 1, 5, 30, 120, 600, 600][attempts + 1]) WHEN stale THEN TIMESTAMP '1996-06-01' ELSE CAST(available_at AS TIMESTAMP) END AS available_at, CASE WHEN mine AND NOT sent THEN 'BROKER' END AS error FROM y""")
def outbox_results(s, d):
    k = F.col("o_orderkey")
    queue = A.table(s, d, "orders").select(k.alias("id"), F.get(F.array(F.lit("PENDING"), F.lit("LOCKED"), F.lit("SENT")), (k % 3).cast("int")).alias("state"), F.when(k % 3 == 1, F.when(k % 2 == 0, "a").otherwise("b")).alias("owner"), F.col("o_orderdate").cast("timestamp_ntz").alias("locked_until"), F.col("o_orderdate").cast("timestamp_ntz").alias("available_at"), (k % 7).alias("attempts"))
    results = queue.where("id % 5 < 4").select("id", F.lit("a").alias("owner"), (F.col("id") % 5 < 2).alias("sent"), F.lit("BROKER").alias("error"))
    return C.outbox_after(queue, results, "1996-06-01 00:00:00")


@query(oracle("""a AS (SELECT version_id, version_id % 4 AS n FROM versions WHERE version_id % 4 > 0), h AS (SELECT v.document_id, CAST(sum(a.n) AS BIGINT) AS held FROM versions v JOIN a USING (version_id) WHERE v.document_id % 3 > 0 GROUP BY v.document_id)
SELECT d.document_id, CASE WHEN d.document_id % 5 = 0 THEN 'ALREADY_DELETED' WHEN d.document_id % 5 < 3 THEN 'NOT_DELETING' WHEN coalesce(held, 0) > 0 THEN 'PURGE' ELSE 'DELETED' END AS action, coalesce(held, 0) AS "left" FROM docs d LEFT JOIN h ON h.document_id = d.document_id"""))
def deletion_complete(s, d):
    k, v = F.col("document_id"), F.col("version_id")
    documents = A.documents(s, d).select("document_id", F.when(k % 5 == 0, "DELETED").when(k % 5 < 3, "ACTIVE").otherwise("DELETING").alias("doc_status"))
    versions = A.versions(s, d).select("version_id", "document_id")
    artifacts = versions.where((k % 3 > 0) & (v % 4 > 0)).select("version_id", F.explode(F.sequence(F.lit(1), (v % 4).cast("int"))).alias("n"))
    return C.complete_deletion(documents, versions, artifacts)


@query("""WITH r AS (SELECT o_orderkey AS request_id, 'k' || (o_orderkey % 700) AS key, o_orderstatus AS fp, o_custkey % 5 AS kb, 'n' || (o_orderkey % 350) AS name FROM orders), a AS (SELECT DISTINCT key, 'F' AS fp, -CAST(substr(key, 2) AS BIGINT) AS doc FROM r WHERE CAST(substr(key, 2) AS BIGINT) % 4 = 0),
n AS (SELECT DISTINCT kb, name FROM r WHERE CAST(substr(name, 2) AS BIGINT) % 6 = 0), x AS (SELECT r.*, a.fp AS afp, a.doc, n.name IS NOT NULL AS taken FROM r LEFT JOIN a USING (key) LEFT JOIN n ON n.kb = r.kb AND n.name = r.name),
y AS (SELECT *, row_number() OVER (PARTITION BY kb, name, afp IS NULL ORDER BY request_id) AS i, row_number() OVER (PARTITION BY key, afp IS NULL ORDER BY request_id) AS j, first(fp) OVER (PARTITION BY key ORDER BY request_id) AS twin FROM x),
z AS (SELECT *, CASE WHEN afp = fp THEN 'REPLAY' WHEN afp IS NOT NULL OR (j > 1 AND twin <> fp) THEN 'IDEMPOTENCY_CONFLICT' WHEN j > 1 THEN 'IN_PROGRESS' WHEN taken OR i > 1 THEN 'DOCUMENT_NAME_CONFLICT' ELSE 'ACCEPTED' END AS action FROM y)
SELECT request_id, action, CASE WHEN action = 'REPLAY' THEN doc END AS document_id FROM z""")
def accept_upload(s, d):
    k = F.col("o_orderkey")
    r = A.table(s, d, "orders").select(k.alias("request_id"), F.concat(F.lit("k"), (k % 700).cast("string")).alias("key"), F.col("o_orderstatus").alias("fingerprint"), (F.col("o_custkey") % 5).alias("kb_id"), F.concat(F.lit("n"), (k % 350).cast("string")).alias("name"))
    number = lambda c: F.substring(c, F.lit(2), F.length(c)).cast("long")
    accepted = r.where(number(F.col("key")) % 4 == 0).select("key").distinct().select("key", F.lit("F").alias("fingerprint"), (-number(F.col("key"))).alias("document_id"))
    return C.accept_upload(r, accepted, r.where(number(F.col("name")) % 6 == 0).select("kb_id", "name"))


_KINDS = ["ACCESS", "IDEMPOTENCY", "RETRIEVE", "ANSWER", "BUSINESS", "OTHER"]
_REASONS = [
    "APPLICATION_CREDENTIAL_INVALID", "KNOWLEDGE_BASE_NOT_AVAILABLE", "INVALID_REQUEST", "IDEMPOTENCY_CONFLICT", "CONTEXT_CHANGED", "UNAVAILABLE", "OWNERSHIP_LOST", "RESULT_TOO_LARGE",
    "CORRUPTED_STATE", "REQUEST_IN_PROGRESS", "QUERY_EMBEDDING_UNAVAILABLE", "SEARCH_UNAVAILABLE", "EVIDENCE_UNAVAILABLE", "MODEL_REQUEST_INVALID", "MODEL_UNAVAILABLE", "OUTPUT_INVALID",
    "EXECUTION_LIMIT_EXCEEDED", "EXECUTION_TIMEOUT", "VALIDATION", "NOT_FOUND", "CONFLICT", "FORBIDDEN", "TOO_LARGE", "UNSUPPORTED_MEDIA_TYPE",
]


@query(f"""WITH v AS (SELECT event_id, {_KINDS}[event_id % 6 + 1] AS kind, {_REASONS}[event_id // 6 % 24 + 1] AS reason, CASE WHEN event_id % 5 = 0 THEN 'QUERY_AUDIT_UNAVAILABLE' ELSE 'SOME_CODE' END AS code FROM events),
c AS (SELECT *, CASE
  WHEN kind = 'ACCESS' AND reason = 'APPLICATION_CREDENTIAL_INVALID' THEN '401 AUTHENTICATION ' || reason WHEN kind = 'ACCESS' AND reason = 'KNOWLEDGE_BASE_NOT_AVAILABLE' THEN '404 AUTHORIZATION ' || reason
  WHEN kind IN ('IDEMPOTENCY', 'RETRIEVE', 'ANSWER') AND reason = 'INVALID_REQUEST' THEN '400 VALIDATION INVALID_' || CASE kind WHEN 'IDEMPOTENCY' THEN 'QUERY' ELSE kind END || '_REQUEST'
  WHEN kind = 'IDEMPOTENCY' AND reason = 'IDEMPOTENCY_CONFLICT' THEN '409 IDEMPOTENCY ' || reason WHEN kind = 'IDEMPOTENCY' AND reason = 'CONTEXT_CHANGED' THEN '409 IDEMPOTENCY IDEMPOTENCY_CONTEXT_CHANGED'
  WHEN kind = 'IDEMPOTENCY' AND reason IN ('UNAVAILABLE', 'OWNERSHIP_LOST', 'RESULT_TOO_LARGE', 'CORRUPTED_STATE') THEN '503 IDEMPOTENCY QUERY_IDEMPOTENCY_UNAVAILABLE'
  WHEN kind IN ('RETRIEVE', 'ANSWER') AND reason = 'REQUEST_IN_PROGRESS' THEN '409 IDEMPOTENCY ' || reason
  WHEN kind = 'RETRIEVE' AND reason IN ('QUERY_EMBEDDING_UNAVAILABLE', 'SEARCH_UNAVAILABLE', 'EVIDENCE_UNAVAILABLE') THEN '503 ' || replace(reason, '_UNAVAILABLE', '') || ' ' || reason
  WHEN kind = 'ANSWER' AND reason IN ('MODEL_REQUEST_INVALID', 'MODEL_UNAVAILABLE') THEN '503 ANSWER_MODEL ANSWER_' || reason
  WHEN kind = 'ANSWER' AND reason IN ('OUTPUT_INVALID', 'EXECUTION_LIMIT_EXCEEDED') THEN '503 ANSWER_POLICY ANSWER_' || reason
  WHEN kind = 'ANSWER' AND reason = 'EXECUTION_TIMEOUT' THEN '503 TIMEOUT ANSWER_' || reason
  WHEN kind = 'BUSINESS' AND reason = 'UNAVAILABLE' THEN '503 ' || CASE code WHEN 'QUERY_AUDIT_UNAVAILABLE' THEN 'AUDIT_STORAGE' ELSE 'DEPENDENCY' END || ' ' || code
  WHEN kind = 'BUSINESS' AND reason IN ('VALIDATION', 'NOT_FOUND', 'CONFLICT', 'FORBIDDEN', 'TOO_LARGE', 'UNSUPPORTED_MEDIA_TYPE') THEN
    CASE reason WHEN 'VALIDATION' THEN '400' WHEN 'NOT_FOUND' THEN '404' WHEN 'CONFLICT' THEN '409' WHEN 'FORBIDDEN' THEN '403' WHEN 'TOO_LARGE' THEN '413' ELSE '415' END || CASE code WHEN 'QUERY_AUDIT_UNAVAILABLE' THEN ' AUDIT_STORAGE ' ELSE ' VALIDATION ' END || code
  ELSE '500 INTERNAL INTERNAL_ERROR' END AS f FROM v)
SELECT event_id, kind, reason, code, CASE WHEN f < '500' THEN 'REJECTED' ELSE 'FAILED' END AS outcome, CAST(split_part(f, ' ', 1) AS INTEGER) AS http_status, split_part(f, ' ', 2) AS category, split_part(f, ' ', 3) AS audit_code FROM c""")
def failure_classify(s, d):
    """Every kind with every reason."""
    k = F.col("event_id")
    kind = F.get(F.array(*[F.lit(x) for x in _KINDS]), (k % 6).cast("int"))
    reason = F.get(F.array(*[F.lit(x) for x in _REASONS]), (F.floor(k / 6) % 24).cast("int"))
    return C.classify_failures(A.table(s, d, "events").select("event_id", kind.alias("kind"), reason.alias("reason"), F.when(k % 5 == 0, "QUERY_AUDIT_UNAVAILABLE").otherwise("SOME_CODE").alias("code")))


@query(oracle("""SELECT a.id, coalesce(f.outcome, a.outcome) AS outcome, f.id IS NOT NULL AS changed FROM audits a
LEFT JOIN (SELECT id - 1 AS id, outcome FROM audits WHERE outcome <> 'STARTED') f ON f.id = a.id AND a.outcome = 'STARTED'"""))
def audit_finish(s, d):
    a = A.audits(s, d).select("id", "outcome")
    finish = a.where(F.col("outcome") != "STARTED").select((F.col("id") - 1).alias("fid"), F.col("outcome").alias("new"))
    joined = a.join(finish, (F.col("id") == F.col("fid")) & (F.col("outcome") == "STARTED"), "left")
    return joined.select("id", F.coalesce("new", "outcome").alias("outcome"), F.col("fid").isNotNull().alias("changed"))


@query(oracle("""SELECT job_id, action, CASE WHEN action IN ('ACQUIRED', 'RENEWED') THEN 'w1' ELSE lease_owner END AS owner, CASE WHEN action IN ('ACQUIRED', 'RENEWED') THEN TIMESTAMP '1996-01-01 00:15:00' ELSE lease_until END AS until
FROM (SELECT *, CASE WHEN job_status = 'PENDING' THEN 'ACQUIRED' WHEN job_status = 'RUNNING' AND lease_owner = 'w1' THEN 'RENEWED' WHEN job_status = 'RUNNING' AND lease_until < TIMESTAMP '1996-01-01' THEN 'ACQUIRED' WHEN job_status = 'RUNNING' THEN 'HELD' ELSE 'TERMINAL' END AS action FROM jobs)"""))
def job_lease(s, d):
    return C.lease(A.jobs(s, d), "w1", "1996-01-01 00:00:00")


ACTIVATION_SQL = """a AS (SELECT version_id, count(*) FILTER (WHERE job_status = 'RUNNING' AND lease_owner = 'w1') AS mine, max(attempt_no) AS expected, count(*) AS actual FROM jobs GROUP BY version_id)
SELECT d.document_id, v.version_id, CASE WHEN v.version_id <> d.latest_version_id THEN 'SUPERSEDED' WHEN v.status <> 'PROCESSING' THEN 'NOT_PROCESSING' WHEN a.mine = 0 THEN 'LEASE_LOST' WHEN a.expected <> a.actual THEN 'COUNT_MISMATCH' ELSE 'ACTIVATED' END AS action
FROM docs d JOIN versions v USING (document_id) JOIN a ON a.version_id = v.version_id"""


@query(oracle(ACTIVATION_SQL))
def version_activation(s, d):
    a = A.jobs(s, d).groupBy("version_id").agg(F.count_if((F.col("job_status") == "RUNNING") & (F.col("lease_owner") == "w1")).alias("mine"), F.max("attempt_no").alias("expected"), F.count(F.lit(1)).alias("actual"))
    rows = A.documents(s, d).select("document_id", "latest_version_id").join(A.versions(s, d), "document_id").join(a, "version_id")
    action = ladder(
        (F.col("version_id") != F.col("latest_version_id"), "SUPERSEDED"), (F.col("status") != "PROCESSING", "NOT_PROCESSING"), (F.col("mine") == 0, "LEASE_LOST"),
        (F.col("expected") != F.col("actual"), "COUNT_MISMATCH"), otherwise="ACTIVATED",
    )
    return rows.select("document_id", "version_id", action.alias("action"))


@query(oracle("""u AS (SELECT o_orderkey AS request, o_custkey AS document_id, sha256(CAST(o_orderkey % 5 + 1 AS VARCHAR) || CASE o_orderkey % 5 WHEN 0 THEN '-URGENT' WHEN 1 THEN '-HIGH' WHEN 2 THEN '-MEDIUM' WHEN 3 THEN '-NOT SPECIFIED' ELSE '-LOW' END) AS sha FROM orders),
f AS (SELECT u.*, d.document_id AS doc, d.doc_status, l.status, l.sha AS latest_sha, l.version_no, a.sha AS active_sha FROM u LEFT JOIN docs d USING (document_id)
      LEFT JOIN versions l ON l.version_id = d.latest_version_id LEFT JOIN versions a ON a.version_id = d.active_version_id)
SELECT request, action, CASE WHEN action = 'ACCEPTED' THEN version_no + 1 END AS new_version_no FROM (SELECT *, CASE WHEN doc IS NULL OR doc_status <> 'ACTIVE' THEN 'DOCUMENT_NOT_ACTIVE'
  WHEN status = 'PROCESSING' THEN 'DOCUMENT_VERSION_IN_PROGRESS' WHEN status = 'FAILED' AND latest_sha = sha THEN 'FAILED_VERSION_RETRY_REQUIRED'
  WHEN status = 'READY' AND latest_sha = sha THEN 'UNCHANGED' WHEN active_sha = sha THEN 'UNCHANGED' ELSE 'ACCEPTED' END AS action FROM f)"""))
def accept_new_version(s, d):
    names = F.array(*[F.lit(x) for x in ("-URGENT", "-HIGH", "-MEDIUM", "-NOT SPECIFIED", "-LOW")])
    k = F.pmod(F.col("o_orderkey"), F.lit(5)).cast("int")
    u = A.table(s, d, "orders").select(F.col("o_orderkey").alias("request"), F.col("o_custkey").alias("document_id"), F.sha2(F.concat((k + 1).cast("string"), F.get(names, k)), 256).alias("sha"))
    v = A.versions(s, d)
    latest = v.select(F.col("version_id").alias("latest_version_id"), "status", F.col("sha").alias("latest_sha"), "version_no")
    active = v.select(F.col("version_id").alias("active_version_id"), F.col("sha").alias("active_sha"))
    docs = A.documents(s, d).join(latest, "latest_version_id", "left").join(active, "active_version_id", "left").withColumn("there", F.lit(True))
    rows = u.join(docs, "document_id", "left")
    same = F.coalesce(F.col("latest_sha") == F.col("sha"), F.lit(False))
    action = ladder(
        (F.col("there").isNull() | (F.col("doc_status") != "ACTIVE"), "DOCUMENT_NOT_ACTIVE"), (F.col("status") == "PROCESSING", "DOCUMENT_VERSION_IN_PROGRESS"),
        ((F.col("status") == "FAILED") & same, "FAILED_VERSION_RETRY_REQUIRED"), ((F.col("status") == "READY") & same, "UNCHANGED"), (F.col("active_sha") == F.col("sha"), "UNCHANGED"), otherwise="ACCEPTED",
    )
    return rows.select("request", action.alias("action"), F.when(action == "ACCEPTED", F.col("version_no") + 1).alias("new_version_no"))


@query(oracle("""m AS (SELECT version_id, max(attempt_no) AS latest FROM jobs GROUP BY version_id)
SELECT j.job_id, CASE WHEN d.kb_id % 6 = 5 THEN 'KB_INACTIVE' WHEN d.doc_status <> 'ACTIVE' THEN 'DOCUMENT_INACTIVE' WHEN j.version_id <> d.latest_version_id THEN 'VERSION_SUPERSEDED'
  WHEN j.job_status IN ('PENDING', 'RUNNING') THEN 'RETRY_IN_PROGRESS' WHEN j.attempt_no <> m.latest THEN 'JOB_SUPERSEDED' WHEN j.job_status <> 'FAILED' THEN 'JOB_NOT_FAILED' WHEN NOT j.retryable THEN 'NOT_RETRYABLE' ELSE 'RETRY' END AS action
FROM jobs j JOIN m USING (version_id) JOIN versions v USING (version_id) JOIN docs d ON d.document_id = v.document_id"""))
def job_retry(s, d):
    j = A.jobs(s, d).withColumn("latest", F.max("attempt_no").over(Window.partitionBy("version_id")))
    rows = j.join(A.versions(s, d).select("version_id", "document_id"), "version_id").join(A.documents(s, d), "document_id")
    action = ladder(
        (F.col("kb_id") % 6 == 5, "KB_INACTIVE"), (F.col("doc_status") != "ACTIVE", "DOCUMENT_INACTIVE"), (F.col("version_id") != F.col("latest_version_id"), "VERSION_SUPERSEDED"),
        (F.col("job_status").isin("PENDING", "RUNNING"), "RETRY_IN_PROGRESS"), (F.col("attempt_no") != F.col("latest"), "JOB_SUPERSEDED"), (F.col("job_status") != "FAILED", "JOB_NOT_FAILED"),
        (~F.col("retryable"), "NOT_RETRYABLE"), otherwise="RETRY",
    )
    return rows.select("job_id", action.alias("action"))


@query(oracle("""p AS (SELECT v.document_id, count(*) AS busy FROM versions v WHERE v.status = 'PROCESSING' GROUP BY v.document_id)
SELECT d.document_id, CASE WHEN doc_status = 'DELETED' THEN 'ALREADY_DELETED' WHEN doc_status <> 'ACTIVE' THEN 'DELETE_IN_PROGRESS' WHEN coalesce(busy, 0) > 2 THEN 'INGESTION_IN_PROGRESS' ELSE 'DELETING' END AS action,
  CASE WHEN doc_status = 'ACTIVE' AND coalesce(busy, 0) <= 2 THEN name END AS freed_name FROM docs d LEFT JOIN p USING (document_id)"""))
def deletion_begin(s, d):
    p = A.versions(s, d).where(F.col("status") == "PROCESSING").groupBy("document_id").agg(F.count(F.lit(1)).alias("busy"))
    rows = A.documents(s, d).join(p, "document_id", "left")
    action = ladder((F.col("doc_status") == "DELETED", "ALREADY_DELETED"), (F.col("doc_status") != "ACTIVE", "DELETE_IN_PROGRESS"), (F.col("busy") > 2, "INGESTION_IN_PROGRESS"), otherwise="DELETING")
    return rows.select("document_id", action.alias("action"), F.when(action == "DELETING", F.col("name")).alias("freed_name"))


@query("""SELECT coalesce(a.k, b.k) AS version_id, CASE WHEN b.k IS NOT NULL THEN b.digest ELSE a.digest END AS digest, coalesce(a.created_at, b.created_at) AS created_at
FROM (SELECT o_orderkey AS k, md5(o_orderstatus) AS digest, o_orderdate AS created_at FROM orders WHERE o_orderkey % 3 <> 0) a
FULL JOIN (SELECT o_orderkey AS k, md5(o_orderpriority) AS digest, o_orderdate + INTERVAL 1 DAY AS created_at FROM orders WHERE o_orderkey % 2 = 0) b ON a.k = b.k""")
def upsert_manifest(s, d):
    o = A.table(s, d, "orders")
    old = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("version_id"), F.md5("o_orderstatus").alias("digest"), F.col("o_orderdate").alias("created_at"))
    new = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("version_id"), F.md5("o_orderpriority").alias("digest"), (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("created_at"))
    return C.upsert(old, new, "version_id", keep=("created_at",))


@query(oracle("""SELECT l.version_id, l.kept, r.written FROM (SELECT version_id, count(*) AS kept FROM jobs WHERE version_id % 4 <> 0 GROUP BY version_id) l FULL JOIN (SELECT version_id, count(*) AS written FROM jobs WHERE version_id % 4 = 0 GROUP BY version_id) r USING (version_id)
WHERE l.version_id IS NOT NULL"""))
def scope_overwrite(s, d):
    """Rows that stay when the scope (versions divisible by four) is deleted and written anew."""
    j = A.jobs(s, d)
    kept = j.where("version_id % 4 <> 0").groupBy("version_id").agg(F.count(F.lit(1)).alias("kept"))
    written = j.where("version_id % 4 = 0").groupBy("version_id").agg(F.count(F.lit(1)).alias("written"))
    return kept.join(written, "version_id", "left").select("version_id", "kept", "written")


_CODES = ["ANSWER_MODEL_REQUEST_INVALID", "ANSWER_OUTPUT_INVALID", "IDEMPOTENCY_CONFLICT", "IDEMPOTENCY_CONTEXT_CHANGED", "ANSWER_MODEL_UNAVAILABLE", "ANSWER_EXECUTION_TIMEOUT"]


@query(f"""SELECT code, code <> 'ANSWER_MODEL_REQUEST_INVALID' AS retryable, code LIKE 'ANSWER_%_INVALID' AS clear_preview, code LIKE 'IDEMPOTENCY_CON%' AS restart, count(*) AS n
FROM (SELECT {_CODES}[event_id % 6 + 1] AS code FROM events) GROUP BY code""")
def answer_failure_policy(s, d):
    code = F.get(F.array(*[F.lit(x) for x in _CODES]), (F.col("event_id") % 6).cast("int"))
    counted = A.table(s, d, "events").groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("code", C.failure_policy(F.col("code")).alias("p"), "n").select("code", "p.*", "n")


@query("""SELECT event_type, count(*) AS n, count(json_extract_string(props, '$.k')) AS with_k, max(CAST(json_extract_string(props, '$.k') AS VARCHAR)) AS max_k FROM events GROUP BY event_type""")
def json_payload(s, d):
    k = F.get_json_object("props", "$.k")
    return A.table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(k).alias("with_k"), F.max(k).alias("max_k"))


def idempotency_claims(s, d):
    """Claims of ``events`` keyed by user and type (tested against a plain loop)."""
    e = A.table(s, d, "events")
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    rows = e.select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("key"), F.col("event_id").alias("seq"), at.alias("at"), F.when(F.col("value") >= 10, at + F.col("value").cast("long")).alias("done_at"), F.pmod("event_id", F.lit(2)).cast("string").alias("fingerprint"), (F.col("event_id") / 5000).cast("long").cast("string").alias("context"))
    return C.idempotency(rows, running_ttl=86_400, result_ttl=432_000)


Q["idempotency_claims"] = idempotency_claims
QUERIES, SQL = Q, S
