"""Control-plane operators: snapshots, pages, lifecycle decisions, audit maintenance.

All are set-based: a decision ladder is one conditional column over joined facts,
a compare-and-set is a projection of the rows it would change.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.adapters import ladder, stream_fold


def active_snapshot(docs: DataFrame, versions: DataFrame) -> DataFrame:
    """Documents that are active with their active version, if that is ready."""
    v = versions.select(F.col("version_id").alias("active_version_id"), "document_id", "version_no", "status")
    return docs.where(F.col("doc_status") == "ACTIVE").join(v, ["active_version_id", "document_id"]).where(F.col("status") == "READY").select("tenant_id", "kb_id", "document_id", F.col("active_version_id").alias("version_id"), "version_no")


def where_all(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """Rows that meet every condition given; absent ones (None) are left out of the plan."""
    present = [c for c in conditions if c is not None]
    return df.where(reduce(lambda a, b: a & b, present)) if present else df


def in_scope(df: DataFrame, tenant_id, kb_id, versions: list) -> DataFrame:
    """Rows of a tenant's knowledge base and of the given versions; no versions is an error, never "all of them"."""
    if not versions:
        raise ValueError("a search needs at least one version")
    return df.where((F.col("tenant_id") == tenant_id) & (F.col("kb_id") == kb_id) & F.col("version_id").isin(*versions))


def filter_jobs(jobs: DataFrame, status=None, version_id=None, retryable=None, attempt_from=None, owner=None) -> DataFrame:
    """Processing jobs by the predicates that are given."""
    c = F.col
    return where_all(
        jobs,
        None if status is None else c("job_status") == status,
        None if version_id is None else c("version_id") == version_id,
        None if retryable is None else c("retryable") == retryable,
        None if attempt_from is None else c("attempt_no") >= attempt_from,
        None if owner is None else c("lease_owner") == owner,
    )


def lineage_errors(versions: DataFrame, canonical: DataFrame, retrieval: DataFrame) -> DataFrame:
    """``version_id, error``: whether the manifests of a version belong together.

    ``versions``: ``version_id, source_sha``; ``canonical``: ``version_id, source_sha, canonical_sha``; ``retrieval``:
    ``version_id, canonical_sha, fingerprint``.  The first thing that is amiss, or null.
    """
    c = canonical.select("version_id", F.col("source_sha").alias("c_source"), "canonical_sha")
    r = retrieval.select("version_id", F.col("canonical_sha").alias("r_canonical"), "fingerprint")
    rows = versions.join(c, "version_id", "left").join(r, "version_id", "left")
    error = ladder(
        (F.col("canonical_sha").isNull(), "NO_CANONICAL"), (F.col("fingerprint").isNull() | F.col("r_canonical").isNull(), "NO_RETRIEVAL"),
        (F.col("c_source") != F.col("source_sha"), "SOURCE_DRIFT"), (F.col("r_canonical") != F.col("canonical_sha"), "CANONICAL_DRIFT"), otherwise=None,
    )
    return rows.select("version_id", error.alias("error"))


def replace_scope(existing: DataFrame, incoming: DataFrame, *scope: str) -> DataFrame:
    """A table after the scopes of the incoming rows were deleted and written anew."""
    return existing.join(incoming.select(*scope).distinct(), list(scope), "left_anti").select(*existing.columns).unionByName(incoming)


def count_errors(table: DataFrame, expected: DataFrame, *scope: str) -> DataFrame:
    """Scopes that do not hold exactly as many rows as expected (``scope, n``): ``scope, expected, actual``."""
    there = table.groupBy(*scope).agg(F.count(F.lit(1)).alias("actual"))
    rows = expected.select(*scope, F.col("n").alias("expected")).join(there, list(scope), "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return rows.where(F.col("expected") != F.col("actual"))


def filter_audits(audits: DataFrame, started_from=None, started_to=None, application_id=None, kb_id=None, operation=None, outcome=None, request_id=None, execution_id=None, trace_id=None) -> DataFrame:
    """Optional predicates; the time range includes its start and excludes its end."""
    c = F.col
    return where_all(
        audits,
        None if started_from is None else c("started_at") >= F.lit(started_from).cast("timestamp_ntz"),
        None if started_to is None else c("started_at") < F.lit(started_to).cast("timestamp_ntz"),
        None if application_id is None else c("application_id") == application_id,
        None if kb_id is None else c("kb_id") == kb_id,
        None if operation is None else c("operation") == operation,
        None if outcome is None else c("outcome") == outcome,
        None if request_id is None else c("request_id") == request_id,
        None if execution_id is None else c("execution_id") == execution_id,
        None if trace_id is None else c("trace_id") == trace_id,
    )


def page(df: DataFrame, *order: Column, limit: int, offset: int = 0) -> DataFrame:
    """One page of a total order: a distributed top-k of offset + limit rows."""
    return df.orderBy(*order).offset(offset).limit(limit)


def latest_attempt(jobs: DataFrame) -> DataFrame:
    """The job with the greatest attempt of each version (the greater id on a tie)."""
    best = F.max(F.struct("attempt_no", "job_id", *[c for c in jobs.columns if c not in ("attempt_no", "job_id", "version_id")])).alias("b")
    return jobs.groupBy("version_id").agg(best).select("version_id", "b.*")


def authorize(requests: DataFrame) -> DataFrame:
    """First failing reason of the chain credential, application, tenant, knowledge base, grant, permission."""
    reason = ladder(
        (F.col("application_id").isNull(), "CREDENTIAL_UNKNOWN"),
        (F.col("application_status") != "ACTIVE", "APPLICATION_INACTIVE"),
        (F.col("tenant_status") != "ACTIVE", "TENANT_INACTIVE"),
        (F.col("kb_id").isNull() | (F.col("kb_tenant_id") != F.col("tenant_id")), "KB_NOT_FOUND"),
        (F.col("kb_status") != "ACTIVE", "KB_INACTIVE"),
        (F.col("permission").isNull(), "GRANT_MISSING"),
        (~allows(F.col("permission"), F.col("required")), "PERMISSION_DENIED"),
        otherwise="GRANTED",
    )
    return requests.withColumn("reason", reason)


def allows(granted: Column, required: Column) -> Column:
    """READ_WRITE allows all, READ and WRITE themselves; an unknown code denies."""
    known = granted.isin("READ", "WRITE", "READ_WRITE") & required.isin("READ", "WRITE", "READ_WRITE")
    return F.coalesce(known & ((granted == "READ_WRITE") | (granted == required)), F.lit(False))


def orphans(objects: DataFrame, referenced: DataFrame, key: str, now: str, grace_hours: int = 24) -> DataFrame:
    """Objects older than the grace time that no row refers to."""
    old = objects.where(F.col("modified_at") < F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {grace_hours} HOURS"))
    return old.join(referenced.select(key), key, "left_anti")


def duration_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds between two timestamps."""
    return F.floor((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1000).cast("long")


def interrupted(audits: DataFrame, now: str, minutes: int = 15, batch: int = 200) -> DataFrame:
    """The first ``batch`` started rows older than the limit, as they are to become."""
    at = F.lit(now).cast("timestamp_ntz")
    stale = audits.where((F.col("outcome") == "STARTED") & (F.col("started_at") < at - F.expr(f"INTERVAL {minutes} MINUTES")))
    return stale.orderBy("id").limit(batch).select("id", F.lit("INTERRUPTED").alias("outcome"), duration_ms(F.col("started_at"), at).alias("duration_ms"))


def expired(audits: DataFrame, now: str, days: int = 90, batch: int = 200) -> DataFrame:
    """Ids of the first ``batch`` terminal rows beyond retention."""
    return audits.where((F.col("outcome") != "STARTED") & (F.col("started_at") < F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS"))).orderBy("id").limit(batch).select("id")


#: Seconds before the n-th retry.
BACKOFF = [1, 5, 30, 120, 600]


def jittered_seconds(attempt: Column, key: Column, share: float = 0.2) -> Column:
    """The same with up to ``share`` more, by a hash of the row's key, so that rows that failed together come back apart."""
    return (backoff_seconds(attempt) * (1 + F.lit(share) * F.pmod(F.xxhash64(key), F.lit(1000)) / 1000)).cast("double")


def backoff_seconds(attempt: Column) -> Column:
    """Seconds before the next try; from the fifth failure on the last step holds."""
    return F.element_at(F.array(*[F.lit(s) for s in BACKOFF]), F.least(F.greatest(attempt, F.lit(1)), F.lit(len(BACKOFF))).cast("int")).cast("long")


def claim(queue: DataFrame, now: str, owner: str, lease_minutes: int = 2, batch: int = 50) -> DataFrame:
    """Pending rows that are due (or whose lease ran out), oldest id first, with their new lease."""
    at = F.lit(now).cast("timestamp_ntz")
    due = ((F.col("state") == "PENDING") & (F.col("available_at") <= at)) | ((F.col("state") == "LOCKED") & (F.col("locked_until") < at))
    return queue.where(due).orderBy("id").limit(batch).select("id", F.lit("LOCKED").alias("state"), F.lit(owner).alias("owner"), (at + F.expr(f"INTERVAL {lease_minutes} MINUTES")).alias("locked_until"))


def lease(jobs: DataFrame, owner: str, now: str, minutes: int = 15) -> DataFrame:
    """Outcome of a lease request on each job: acquired if pending or run out, renewed by its owner, else refused."""
    at = F.lit(now).cast("timestamp_ntz")
    action = ladder(
        (F.col("job_status") == "PENDING", "ACQUIRED"),
        ((F.col("job_status") == "RUNNING") & (F.col("lease_owner") == owner), "RENEWED"),
        ((F.col("job_status") == "RUNNING") & (F.col("lease_until") < at), "ACQUIRED"),
        (F.col("job_status") == "RUNNING", "HELD"),
        otherwise="TERMINAL",
    )
    got = action.isin("ACQUIRED", "RENEWED")
    return jobs.select("job_id", action.alias("action"), F.when(got, F.lit(owner)).otherwise(F.col("lease_owner")).alias("owner"), F.when(got, at + F.expr(f"INTERVAL {minutes} MINUTES")).otherwise(F.col("lease_until")).alias("until"))


def job_after(jobs: DataFrame, requests: DataFrame, now: str) -> DataFrame:
    """``job_id, owner, action, code, retryable`` → the jobs as they are after it: ``job_id, changed, status, lease_owner, code, retryable, finished_at``.

    RELEASE and SUCCEED need a running job of that owner, FAIL one that is pending or
    running and held by that owner or by nobody; anything else changes nothing.
    """
    r = requests.select("job_id", F.col("owner").alias("r_owner"), "action", F.col("code").alias("r_code"), F.col("retryable").alias("r_retryable"))
    rows = jobs.join(r, "job_id")
    mine = F.coalesce(F.col("lease_owner") == F.col("r_owner"), F.lit(False))
    held = (F.col("job_status") == "RUNNING") & mine
    may_fail = F.col("job_status").isin("PENDING", "RUNNING") & (mine | F.col("lease_owner").isNull())
    ok = F.when(F.col("action").isin("RELEASE", "SUCCEED"), held).when(F.col("action") == "FAIL", may_fail).otherwise(False)
    to = F.when(F.col("action") == "RELEASE", "PENDING").when(F.col("action") == "SUCCEED", "SUCCEEDED").otherwise("FAILED")
    failed, ended = ok & (F.col("action") == "FAIL"), ok & F.col("action").isin("FAIL", "SUCCEED")
    return rows.select(
        "job_id", ok.alias("changed"), F.when(ok, to).otherwise(F.col("job_status")).alias("status"), F.when(~ok, F.col("lease_owner")).alias("lease_owner"),
        F.when(failed, F.col("r_code")).alias("code"), F.when(failed, F.col("r_retryable")).alias("retryable"), F.when(ended, F.lit(now).cast("timestamp_ntz")).alias("finished_at"),
    )


def outbox_after(queue: DataFrame, results: DataFrame, now: str) -> DataFrame:
    """The queue after a round of publishing: ``id, state, owner, available_at, error``.

    ``results``: ``id, owner, sent, error``.  A row that is locked by the owner is sent, or pending again
    after its backoff with the error; other locks that ran out are pending at once; results of another owner count for nothing.
    """
    at = F.lit(now).cast("timestamp_ntz")
    r = results.select("id", F.col("owner").alias("r_owner"), "sent", F.col("error").alias("r_error"))
    rows = queue.join(r, "id", "left")
    mine = (F.col("state") == "LOCKED") & F.coalesce(F.col("owner") == F.col("r_owner"), F.lit(False))
    stale = (F.col("state") == "LOCKED") & (F.col("locked_until") < at) & ~mine
    sent, failed = mine & F.col("sent"), mine & ~F.col("sent")
    later = F.timestamp_seconds(F.unix_seconds(at.cast("timestamp")) + backoff_seconds(F.col("attempts"))).cast("timestamp_ntz")
    return rows.select(
        "id", F.when(sent, "SENT").when(failed | stale, "PENDING").otherwise(F.col("state")).alias("state"), F.when(~(mine | stale), F.col("owner")).alias("owner"),
        F.when(failed, later).when(stale, at).otherwise(F.col("available_at")).alias("available_at"), F.when(failed, F.col("r_error")).alias("error"),
    )


def complete_deletion(documents: DataFrame, versions: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Deleting documents of whose versions nothing is stored any more: ``document_id, action, left``.

    ``artifacts``: ``version_id`` of what the stores and indices still hold.  The name is
    free from the beginning of the deletion; only with the last artifact gone is the document deleted.
    """
    held = versions.join(artifacts.groupBy("version_id").agg(F.count(F.lit(1)).alias("n")), "version_id").groupBy("document_id").agg(F.sum("n").alias("left"))
    rows = documents.join(held, "document_id", "left").select("document_id", "doc_status", F.coalesce("left", F.lit(0)).alias("left"))
    action = ladder((F.col("doc_status") == "DELETED", "ALREADY_DELETED"), (F.col("doc_status") != "DELETING", "NOT_DELETING"), (F.col("left") > 0, "PURGE"), otherwise="DELETED")
    return rows.select("document_id", action.alias("action"), "left")


def accept_upload(requests: DataFrame, accepted: DataFrame, names: DataFrame) -> DataFrame:
    """``request_id, key, fingerprint, kb_id, name`` → what becomes of an upload of a new document.

    ``accepted``: ``key, fingerprint, document_id`` of requests done before: an equal one is
    replayed with its document, another one under the key is a conflict.  ``names``: the
    active ``kb_id, name``, which no second document may have; of new requests for one
    name the first wins.  The comparison is exact, letter case included.
    """
    known = accepted.select("key", F.col("fingerprint").alias("a_fingerprint"), F.col("document_id").alias("replayed"))
    rows = requests.join(known, "key", "left").join(names.select("kb_id", "name", F.lit(True).alias("taken")).distinct(), ["kb_id", "name"], "left")
    fresh = F.col("a_fingerprint").isNull()
    first = F.row_number().over(Window.partitionBy("kb_id", "name", fresh).orderBy("request_id"))
    again = F.row_number().over(Window.partitionBy("key", fresh).orderBy("request_id"))
    twin = F.first("fingerprint").over(Window.partitionBy("key").orderBy("request_id"))
    rows = rows.withColumn("n", first).withColumn("k", again).withColumn("twin", twin)
    action = ladder(
        (~fresh & (F.col("a_fingerprint") == F.col("fingerprint")), "REPLAY"), (~fresh, "IDEMPOTENCY_CONFLICT"),
        ((F.col("k") > 1) & (F.col("twin") != F.col("fingerprint")), "IDEMPOTENCY_CONFLICT"), (F.col("k") > 1, "IN_PROGRESS"), (F.col("taken"), "DOCUMENT_NAME_CONFLICT"), (F.col("n") > 1, "DOCUMENT_NAME_CONFLICT"), otherwise="ACCEPTED",
    )
    return rows.select("request_id", action.alias("action"), F.when(action == "REPLAY", F.col("replayed")).alias("document_id"))


def upsert(existing: DataFrame, incoming: DataFrame, key: str, keep: tuple = ()) -> DataFrame:
    """Merge by key: incoming values win, but columns in ``keep`` stay as they were."""
    a, b = existing.alias("a"), incoming.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    new = F.col(f"b.{key}").isNotNull()
    cols = [F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key)]
    cols += [(F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")) if c in keep else F.when(new, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))).alias(c) for c in existing.columns if c != key]
    return both.select(*cols)


def claim_one(state: tuple | None, at: int, done: int | None, fingerprint: str, context: str, running_ttl: int, result_ttl: int) -> tuple[str, tuple]:
    """Outcome of one claim and the state after it."""
    if state is not None:
        s_at, s_done, s_fp, s_ctx = state
        completed = s_done is not None and s_done <= at
        if at < (s_done + result_ttl if completed else s_at + running_ttl):
            if s_fp != fingerprint:
                return "CONFLICT", state
            if not completed:
                return "IN_PROGRESS", state
            return ("CONTEXT_CHANGED" if s_ctx != context else "REPLAY"), state
    return "OWNER", (at, done, fingerprint, context)


def idempotency(events: DataFrame, running_ttl: int = 600, result_ttl: int = 300) -> DataFrame:
    """``key, seq, at, done_at, fingerprint, context`` → the outcome of each claim.

    A claim owns its key if nothing lives under it; an owner's run counts as running
    for ``running_ttl`` seconds (from ``at`` to ``done_at``) and its result lives for
    ``result_ttl`` after.  ``done_at`` null: never completed.
    """

    def step(state, r):
        done = None if r["done_at"] is None else int(r["done_at"])
        outcome, state = claim_one(state, int(r["at"]), done, r["fingerprint"], r["context"], running_ttl, result_ttl)
        return state, (int(r["seq"]), outcome)

    return stream_fold(events.select("key", "seq", "at", "done_at", "fingerprint", "context"), ["key"], ["seq"], lambda: None, step, "seq long, outcome string")


def tenant_counts(documents: DataFrame) -> DataFrame:
    """Documents of each tenant: all, active ones, knowledge bases that have any, and those with an active version."""
    return documents.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("doc_status") == "ACTIVE").alias("active"), F.countDistinct("kb_id").alias("kbs"), F.count("active_version_id").alias("with_active"))


#: Fixed values: (kind of error, reason) → (outcome, http status, category, code).
FAILURES = [
    ("ACCESS", "APPLICATION_CREDENTIAL_INVALID", "REJECTED", 401, "AUTHENTICATION", "APPLICATION_CREDENTIAL_INVALID"),
    ("ACCESS", "KNOWLEDGE_BASE_NOT_AVAILABLE", "REJECTED", 404, "AUTHORIZATION", "KNOWLEDGE_BASE_NOT_AVAILABLE"),
    ("IDEMPOTENCY", "INVALID_REQUEST", "REJECTED", 400, "VALIDATION", "INVALID_QUERY_REQUEST"),
    ("IDEMPOTENCY", "IDEMPOTENCY_CONFLICT", "REJECTED", 409, "IDEMPOTENCY", "IDEMPOTENCY_CONFLICT"),
    ("IDEMPOTENCY", "CONTEXT_CHANGED", "REJECTED", 409, "IDEMPOTENCY", "IDEMPOTENCY_CONTEXT_CHANGED"),
    ("IDEMPOTENCY", "UNAVAILABLE", "FAILED", 503, "IDEMPOTENCY", "QUERY_IDEMPOTENCY_UNAVAILABLE"),
    ("IDEMPOTENCY", "OWNERSHIP_LOST", "FAILED", 503, "IDEMPOTENCY", "QUERY_IDEMPOTENCY_UNAVAILABLE"),
    ("IDEMPOTENCY", "RESULT_TOO_LARGE", "FAILED", 503, "IDEMPOTENCY", "QUERY_IDEMPOTENCY_UNAVAILABLE"),
    ("IDEMPOTENCY", "CORRUPTED_STATE", "FAILED", 503, "IDEMPOTENCY", "QUERY_IDEMPOTENCY_UNAVAILABLE"),
    ("RETRIEVE", "INVALID_REQUEST", "REJECTED", 400, "VALIDATION", "INVALID_RETRIEVE_REQUEST"),
    ("RETRIEVE", "REQUEST_IN_PROGRESS", "REJECTED", 409, "IDEMPOTENCY", "REQUEST_IN_PROGRESS"),
    ("RETRIEVE", "QUERY_EMBEDDING_UNAVAILABLE", "FAILED", 503, "QUERY_EMBEDDING", "QUERY_EMBEDDING_UNAVAILABLE"),
    ("RETRIEVE", "SEARCH_UNAVAILABLE", "FAILED", 503, "SEARCH", "SEARCH_UNAVAILABLE"),
    ("RETRIEVE", "EVIDENCE_UNAVAILABLE", "FAILED", 503, "EVIDENCE", "EVIDENCE_UNAVAILABLE"),
    ("ANSWER", "INVALID_REQUEST", "REJECTED", 400, "VALIDATION", "INVALID_ANSWER_REQUEST"),
    ("ANSWER", "REQUEST_IN_PROGRESS", "REJECTED", 409, "IDEMPOTENCY", "REQUEST_IN_PROGRESS"),
    ("ANSWER", "MODEL_REQUEST_INVALID", "FAILED", 503, "ANSWER_MODEL", "ANSWER_MODEL_REQUEST_INVALID"),
    ("ANSWER", "MODEL_UNAVAILABLE", "FAILED", 503, "ANSWER_MODEL", "ANSWER_MODEL_UNAVAILABLE"),
    ("ANSWER", "OUTPUT_INVALID", "FAILED", 503, "ANSWER_POLICY", "ANSWER_OUTPUT_INVALID"),
    ("ANSWER", "EXECUTION_LIMIT_EXCEEDED", "FAILED", 503, "ANSWER_POLICY", "ANSWER_EXECUTION_LIMIT_EXCEEDED"),
    ("ANSWER", "EXECUTION_TIMEOUT", "FAILED", 503, "TIMEOUT", "ANSWER_EXECUTION_TIMEOUT"),
]
#: Http status of a business error, whose own code is the code.
BUSINESS_STATUS = {"VALIDATION": 400, "NOT_FOUND": 404, "CONFLICT": 409, "FORBIDDEN": 403, "TOO_LARGE": 413, "UNSUPPORTED_MEDIA_TYPE": 415, "UNAVAILABLE": 503}


def classify_failures(df: DataFrame, kind: str = "kind", reason: str = "reason", code: str = "code") -> DataFrame:
    """``df`` with ``outcome, http_status, category, audit_code``; what no row of the tables knows is an internal error."""
    of = lambda outcome, status, category, name: F.struct(outcome.alias("outcome"), status.alias("http_status"), category.alias("category"), name.alias("audit_code"))
    known = F.create_map(*[v for k, r, o, h, c, n in FAILURES for v in (F.lit(f"{k}/{r}"), of(F.lit(o), F.lit(h), F.lit(c), F.lit(n)))])
    status = F.try_element_at(F.create_map(*[F.lit(v) for pair in BUSINESS_STATUS.items() for v in pair]), F.col(reason))
    low = status < 500
    business = of(F.when(low, "REJECTED").otherwise("FAILED"), status, F.when(F.col(code) == "QUERY_AUDIT_UNAVAILABLE", "AUDIT_STORAGE").when(low, "VALIDATION").otherwise("DEPENDENCY"), F.col(code))
    internal = of(F.lit("FAILED"), F.lit(500), F.lit("INTERNAL"), F.lit("INTERNAL_ERROR"))
    found = F.when((F.col(kind) == "BUSINESS") & status.isNotNull(), business).otherwise(F.coalesce(F.try_element_at(known, F.concat_ws("/", kind, reason)), internal))
    return df.select("*", found.alias("__f")).select(*df.columns, "__f.*")


#: Codes of a failed answer that cannot be repeated, whose preview must go, and that need a new start.
NOT_RETRYABLE = ("ANSWER_MODEL_REQUEST_INVALID",)
CLEAR_PREVIEW = ("ANSWER_OUTPUT_INVALID", "ANSWER_MODEL_REQUEST_INVALID")
RESTART = ("IDEMPOTENCY_CONFLICT", "IDEMPOTENCY_CONTEXT_CHANGED")


def failure_policy(code: Column) -> Column:
    """What a client does about a failed answer: struct (retryable, clear_preview, restart)."""
    return F.struct((~code.isin(*NOT_RETRYABLE)).alias("retryable"), code.isin(*CLEAR_PREVIEW).alias("clear_preview"), code.isin(*RESTART).alias("restart"))


def window_rank(partition: str, *order) -> Column:
    return F.row_number().over(Window.partitionBy(partition).orderBy(*order))
