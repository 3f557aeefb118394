"""Timers, leases, the outbox and bulk writes: what is due, what is refused, what stays exactly once."""

from __future__ import annotations

import json
import uuid

import pytest
from pyspark.sql import functions as F

from strandline.adapters import shared_dir
from strandline.sources import bulk
from strandline.streaming import outbox
from strandline.streaming import stateful as W


def folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def fed(spark, batches, schema, time_col, operator):
    """Each list of rows as a batch of its own; the rows that the operator emitted in each run."""
    path = folder(spark, "stream")
    out = []
    for rows in batches:
        spark.createDataFrame(rows, schema).withColumn(time_col, F.timestamp_seconds(time_col)).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = operator(spark.readStream.schema(schema.replace(f"{time_col} long", f"{time_col} timestamp")).parquet(f"{path}/in"))
        q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        seen = sorted(map(tuple, spark.read.parquet(f"{path}/out").collect()), key=str)
        out.append([x for x in seen if x not in [y for o in out for y in o]])
    return out


def test_retries_come_when_they_are_due(spark):
    schema = "job_id long, seq long, failed_at long, retryable boolean"
    first = [(1, 1, 1000, True), (2, 2, 1000, False), (3, 3, 1000, True)]
    second = [(1, 4, 1006, True), (9, 5, 1010, True)]
    third = [(1, 6, 1040, True), (2, 7, 1041, True), (9, 8, 1100, True)]
    fourth = [(1, 9, 1400, True), (8, 10, 2000, True)]
    got = fed(spark, [first, second, third, fourth], schema, "failed_at", lambda s: W.retries(s, "0 seconds"))
    assert got[0] == [(2, 1, "DEAD_LETTER", 1000)]
    assert got[1] == [(1, 1, "RETRY", 1005), (3, 1, "RETRY", 1005)]
    assert got[2] == [(1, 2, "RETRY", 1036), (2, 4, "DEAD_LETTER", 1041), (9, 1, "RETRY", 1015)]
    assert got[3] == [(1, 3, "RETRY", 1340), (1, 4, "DEAD_LETTER", 1400), (9, 2, "RETRY", 1130)]


def test_a_former_owner_is_refused(spark):
    assert W.lease_step(None, 0, "a", False, 60) == ((None, 0, 0), "REFUSED", False)
    state, outcome, _ = W.lease_step(None, 0, "a", True, 60)
    assert (state, outcome) == (("a", 1, 60), "GRANTED")
    assert W.lease_step(state, 59, "b", True, 60)[1] == "REFUSED" and W.lease_step(state, 59, "a", False, 60) == (("a", 1, 119), "EXTENDED", False)
    state, outcome, ended = W.lease_step(state, 60, "b", True, 60)
    assert (state, outcome, ended) == (("b", 2, 120), "GRANTED", True)
    assert W.lease_step(state, 61, "a", False, 60) == (state, "REFUSED", False)
    schema = "resource string, seq long, sent_at long, owner string, claim boolean"
    batches = [[("r", 1, 100, "a", True), ("r", 2, 110, "a", False)], [("x", 3, 300, "a", True)], [("r", 4, 400, "a", False), ("r", 5, 401, "b", True), ("r", 6, 402, "a", False)]]
    got = fed(spark, batches, schema, "sent_at", lambda s: W.leases(s, "0 seconds", 60))
    assert got[0] == [("r", 1, "a", "GRANTED", 1, 100), ("r", 2, "a", "EXTENDED", 1, 110)]
    # nobody has to ask: the timer ends the lease at the end that its last beat gave it
    assert got[1] == [("r", None, "a", "EXPIRED", 1, 170), ("x", 3, "a", "GRANTED", 1, 300)]
    assert got[2] == [("r", 4, "a", "REFUSED", 1, 400), ("r", 5, "b", "GRANTED", 2, 401), ("r", 6, "a", "REFUSED", 2, 402), ("x", None, "a", "EXPIRED", 1, 360)]


def test_outbox_after_a_crash_is_published_once(spark):
    path = folder(spark, "outbox")
    spark.range(230).select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("payload")).repartition(3).write.parquet(f"{path}/queue")
    outbox.register(spark)
    seen = []

    def dying(rows, n):
        seen.append((n, rows.count()))
        outbox.to_folder(f"{path}/sent")(rows.limit(20) if n == 2 and len(seen) == 3 else rows, n)
        if n == 2 and len(seen) == 3:
            raise RuntimeError("killed midway")

    start = lambda publish: outbox.publisher(outbox.pending(spark, f"{path}/queue"), f"{path}/sent", f"{path}/state", publish, "0 seconds").start()
    q = start(dying)
    with pytest.raises(Exception, match="killed midway"):
        q.awaitTermination()
    assert [n for n, _ in seen] == [0, 1, 2] and all(c == 50 for _, c in seen)
    spark.createDataFrame([(230, "late"), (231, None)], "id long, payload string").write.mode("append").parquet(f"{path}/queue")
    q = start(dying)
    q.processAllAvailable()
    q.stop()
    assert [n for n, _ in seen[3:]] == [2, 3, 4] and seen[-1][1] == 32
    got = sorted((r["id"], r["payload"]) for r in outbox.published(spark, f"{path}/sent", "id long, payload string").collect())
    assert got == [*[(i, f"p{i}") for i in range(230)], (230, "late"), (231, None)]


def test_bulks_follow_the_packing_rule(spark):
    path = folder(spark, "bulk")
    rows = spark.createDataFrame([(i, "ä" * (i % 90)) for i in range(400)] + [(1000, "x" * 3000)], "id long, text string").repartition(3)
    bulk.write(rows, path, most_actions=25, most_bytes=2000)
    m = bulk.manifest(spark, path).collect()
    assert [(r["id"], r["actions"]) for r in m if r["file"] is None] == [("1000", 0)]
    got = bulk.read(spark, path, "id long, text string").collect()
    assert sorted((r["id"], r["text"]) for r in got) == [(i, "ä" * (i % 90)) for i in range(400)]
    for r in (r for r in m if r["file"]):
        own = [x for x in got if x["file"] == r["file"]]
        assert r["actions"] == len(own) <= 25 and r["bytes"] == sum(len(json.dumps({"id": x["id"], "text": x["text"]}, ensure_ascii=False).encode()) + 1 for x in own) <= 2000
    lines = [(i, b"x" * (i % 37)) for i in range(300)]
    plain, now = [], []
    for _, x in lines:
        if now and (len(now) == 10 or sum(map(len, now)) + len(now) + len(x) + 1 > 200):
            plain.append(now)
            now = []
        now.append(x)
    assert list(bulk.packed(lines, 10, 200)) == [*plain, now]
    # an aborted job leaves no manifest and none of its objects
    bad = rows.select(F.when(F.col("id") == 399, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("id"), "text")
    with pytest.raises(Exception, match="broken"):
        bulk.write(bad, f"{path}-bad")
    with pytest.raises(Exception):
        bulk.manifest(spark, f"{path}-bad").collect()
    bulk.write(rows.limit(0), f"{path}-none")
    assert bulk.manifest(spark, f"{path}-none").count() == 0


def test_reduced_texts_equal_a_plain_loop(spark):
    import random

    from strandline.functions.text import split_tokens
    from strandline.operators import artifacts

    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["word", "größer", "检索服务", "x"]) for _ in range(rng.randrange(0, 400)))) for i in range(40)] + [(90, None), (91, ""), (92, "keep " * 300), (93, "ab" * 20000)]
    estimate = lambda t: max(1, (sum(ord(c) < 128 for c in t) + 3) // 4 + sum(ord(c) >= 128 for c in t))
    models = {"halve": (lambda c: F.substr(c, F.lit(1), F.floor(F.length(c) / 2).cast("int")), lambda t: t[: len(t) // 2]), "same": (lambda c: c, lambda t: t), "blank": (lambda c: F.lit(" "), lambda t: " ")}
    for column, plain in models.values():
        got = {r["id"]: (r["text"], r["error"]) for r in artifacts.reduce_texts(spark.createDataFrame(rows, "id long, text string"), 60, column).collect()}
        assert len(got) == len(rows)
        for i, t in rows:
            try:
                assert got[i] == (artifacts.reduced(t or "", 60, split_tokens, plain, estimate), None)
            except ValueError:
                assert got[i][1] == "RETRIEVAL_GENERATION_LIMIT_EXCEEDED"
    assert artifacts.reduce_texts(spark.createDataFrame(rows, "id long, text string").limit(0), 60, models["halve"][0]).count() == 0
