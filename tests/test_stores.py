"""Projections and objects as storage: what a stopped, repeated or failing run leaves behind."""

from __future__ import annotations

import hashlib
import os
import uuid

import pytest
from pyspark.sql import functions as F

from strandline.adapters import shared_dir
from strandline.operators import projection_store as T
from strandline.sources import objects
from strandline.sources.readers import ObjectStore

ROWS = "scope string, k long, value string"


def folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def test_a_stopped_run_leaves_the_old_scope_readable(spark):
    path = folder(spark, "projection")
    made = lambda value, n=4: spark.createDataFrame([(f"s{i % 3}", i, value) for i in range(3 * n)], ROWS)
    named = lambda fingerprint, scopes=("s0", "s1", "s2"): spark.createDataFrame([(x, fingerprint) for x in scopes], "scope string, fingerprint string")
    seen = lambda: sorted({(r["scope"], r["value"], r["n"]) for r in T.current(spark, path, "k long, value string").groupBy("scope", "value").agg(F.count("*").alias("n")).collect()})
    assert T.project(named("a"), made("one"), path, 1).count() == 0
    assert seen() == [("s0", "one", 4), ("s1", "one", 4), ("s2", "one", 4)]
    # written but never finished
    T.write_rows(named("b", ["s0"]), made("two", 9), path)
    assert seen() == [("s0", "one", 4), ("s1", "one", 4), ("s2", "one", 4)]
    # the repeated run replaces what that left; an empty scope is a projection too; the third is unchanged and not written
    written = T.write_rows(spark.createDataFrame([("s0", "b"), ("s1", "b"), ("s2", "a"), (None, "b")], "scope string, fingerprint string"), made("three", 5).where("scope <> 's1'"), path)
    assert sorted(map(tuple, written.collect())) == [("s0", "b", 5), ("s1", "b", 0)]
    assert T.finish(written, "k long, value string", path, 2).count() == 0
    assert seen() == [("s0", "three", 5), ("s2", "one", 4)]
    assert sorted((r["scope"], r["fingerprint"], r["n"], r["run"]) for r in T.manifest(spark, path).collect()) == [("s0", "b", 5, 2), ("s1", "b", 0, 2), ("s2", "a", 4, 1)]
    # a count that does not fit keeps the old rows
    short = T.write_rows(named("c", ["s2"]), made("four"), path).withColumn("n", F.col("n") + 1)
    assert [tuple(r) for r in T.finish(short, "k long, value string", path, 3).collect()] == [("s2", "COUNT_MISMATCH")]
    assert seen() == [("s0", "three", 5), ("s2", "one", 4)]
    assert T.sweep(spark, path) == 2 and seen() == [("s0", "three", 5), ("s2", "one", 4)]
    with pytest.raises(ValueError):
        T.write_rows(named("x").union(named("y")), made("five"), path)


def test_uploads_in_parts(spark):
    root = folder(spark, "objects")
    parts = [("a/one", 1, b"he"), ("a/one", 2, b"llo"), ("a/one", 3, None), ("big", 1, b"x" * 60), ("big", 2, b"x" * 60), ("empty", 1, b""), ("../out", 1, b"x"), (None, 1, b"x")]
    rows = spark.createDataFrame(parts, "key string, n int, part binary")
    got = {r["key"]: (r["size"], r["sha256"], r["error"]) for r in objects.put_parts(rows, root, most_bytes=100).collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert got == {"a/one": (5, sha(b"hello"), None), "empty": (0, sha(b""), None), "big": (None, None, "OBJECT_TOO_LARGE"), "../out": (None, None, "BAD_KEY")}
    at = root.removeprefix("file://")
    assert sorted(os.path.join(d, f).removeprefix(at) for d, _, fs in os.walk(at) for f in fs) == ["/a/one", "/empty"]
    again = {r["key"]: r["error"] for r in objects.put_parts(spark.createDataFrame([("a/one", 1, b"hello"), ("empty", 1, b"other")], "key string, n int, part binary"), root).collect()}
    assert again == {"a/one": None, "empty": "OBJECT_EXISTS"} and ObjectStore(spark, root).open("empty") == b""
    assert objects.put_parts(rows.limit(0), root).count() == 0


def test_the_reaper_goes_on_where_it_stopped(spark):
    root, state = folder(spark, "objects"), folder(spark, "state")
    store = ObjectStore(spark, root)
    for i in range(7):
        store.put(f"o{i}", b"x")
    paths = {i: f"{root.replace('file:///', 'file:/')}/o{i}" for i in range(7)}
    used = spark.createDataFrame([(paths[1],), (paths[5],), (paths[5],)], "path string")

    def failing(path):
        if path.endswith("o2"):
            raise OSError("no answer")
        return store.fs.delete(store.jvm.org.apache.hadoop.fs.Path(path), False)

    run = lambda **more: [(r["path"][-2:], r["outcome"]) for r in objects.reap(spark, root, used, "2999-01-01", state, 4, **more).collect()]
    assert run(delete=failing) == [("o0", "REMOVED"), ("o1", "REFERENCED"), ("o2", "RETAINED"), ("o3", "REMOVED")]
    assert run() == [("o4", "REMOVED"), ("o5", "REFERENCED"), ("o6", "REMOVED")]
    # the scan begins anew, and what failed is looked at again
    assert run() == [("o1", "REFERENCED"), ("o2", "REMOVED"), ("o5", "REFERENCED")]
    store.put("o9", b"x")
    assert [r["outcome"] for r in objects.reap(spark, root, used, "2000-01-01", state).collect()] == ["YOUNG"] * 3
    broken = used.select(F.raise_error(F.lit("no database")).cast("string").alias("path"))
    got = [r["outcome"] for r in objects.reap(spark, root, broken, "2999-01-01", state).collect()]
    assert got == ["RETAINED"] * 3 and store.exists("o9")
