"""Stored indexes: keyword search by blocks of postings, vector search by cells."""

from __future__ import annotations

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.adapters import shared_dir
from strandline.functions.text import bigram_tokens, tokens
from strandline.operators import keyword_index, search, vector_index


def folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    d = spark.createDataFrame([(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 60))), f"w{i % 7} w{i % 3}") for i in range(800)], "doc_id long, text string, title string")
    q = spark.createDataFrame([(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 12)))) for i in range(40)], "query_id long, text string")
    return d, q


@pytest.mark.parametrize(("block_docs", "first"), [(16, 1), (100, 2), (5000, 2)])
def test_blocks_give_what_all_documents_give(spark, corpus, block_docs, first):
    d, q = corpus
    fields = (("text", tokens, 1.0),)
    every = sorted(map(tuple, search.top_k(search.bm25(d, q), 7).collect()))
    path = folder(spark, "keywords")
    keyword_index.build(d, fields, path, block_docs=block_docs)
    assert sorted(map(tuple, keyword_index.search(spark, path, q, fields, 7, first).collect())) == every


def test_one_index_serves_other_queries_and_fields(spark, corpus):
    d, q = corpus
    fields = (("text", tokens, 2.0), ("title", tokens, 1.5), ("text", bigram_tokens, 0.5))
    path = folder(spark, "keywords")
    keyword_index.build(d, fields, path, block_docs=64)
    for some in (q, q.where("query_id < 5"), q.where("query_id = 7").selectExpr("query_id + 100 AS query_id", "'w1 w2' AS text")):
        want = None
        for column, analyzer, boost in fields:
            one = search.bm25(d.select("doc_id", F.col(column).alias("text")), some, analyzer=analyzer).select("query_id", "doc_id", F.round(F.col("score") * boost, 6).alias("score"))
            want = one if want is None else want.unionByName(one)
        want = search.top_k(want.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")), 9)
        assert sorted(map(tuple, keyword_index.search(spark, path, some, fields, 9).collect())) == sorted(map(tuple, want.collect()))


def test_rare_terms_let_blocks_be_skipped(spark):
    d = spark.createDataFrame([(i, "the of and " + (f"rare{i}" if i < 8 else "common")) for i in range(2000)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "the rare1 rare2 rare3 rare4")], "query_id long, text string")
    bounds = spark.createDataFrame([(1, 0, b, 9.0 if b < 3 else 0.2) for b in range(50)], "query_id long, part int, block int, reach double")
    first = search.top_k(bounds.select("query_id", "part", "block", F.col("reach").alias("score")), 2, "block")
    head = spark.createDataFrame([(1, 5, 3.0), (1, 6, 2.0)], "query_id long, doc_id long, score double")
    assert [r["block"] for r in keyword_index.surviving(bounds, first, head, 2).collect()] == [2]
    assert keyword_index.surviving(bounds, first, head, 3).count() == 48
    path = folder(spark, "keywords")
    keyword_index.build(d, (("text", tokens, 1.0),), path, block_docs=20)
    got = [r["doc_id"] for r in keyword_index.search(spark, path, q, (("text", tokens, 1.0),), 4, 4).orderBy("rank").collect()]
    assert got == [1, 2, 3, 4]


def test_keyword_index_of_odd_texts(spark):
    fields = (("text", tokens, 1.0),)
    schema = "doc_id long, text string, term string, block int"
    d = spark.createDataFrame([(1, None, "x", 1), (2, "", "x", 1), (3, "a", "x", 1), (3, "a b", "x", 1), (None, "a", "x", 1), (4, "a " * 20000, "x", 1)], schema)
    q = spark.createDataFrame([(1, "a"), (2, None), (3, ""), (4, "zzz")], "query_id long, text string")
    for k, rows in (("some", d), ("none", d.limit(0))):
        path = folder(spark, k)
        keyword_index.build(rows, fields, path)
        got = keyword_index.search(spark, path, q, fields, 5).collect()
        assert sorted({(r["query_id"], r["doc_id"]) for r in got}) == ([(1, 3), (1, 4)] if k == "some" else [])


def test_vector_recall_and_share_scanned(spark):
    """Vectors around 60 centres: recall over 0.9, of the vectors of a scope under a third scanned."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 32))
    rows = [(i, i % 4, (centres[rng.integers(60)] + 0.45 * rng.normal(size=32)).tolist()) for i in range(6000)]
    e = spark.createDataFrame(rows, "vec_id long, scope int, embedding array<double>").cache()
    path = folder(spark, "vectors")
    vector_index.build(e, path, k=10)
    q = e.where("vec_id % 60 = 0").withColumnRenamed("vec_id", "query_id")
    exact = {(r["query_id"], r["vec_id"]): r["score"] for r in search.knn(e, q, 10).collect()}
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in vector_index.search(spark, path, q, 10).collect()}
    assert len(exact) == 1000 and len(exact.keys() & got.keys()) >= 0.9 * len(exact)
    assert all(got[k] == exact[k] for k in exact.keys() & got.keys())
    probes = spark.read.parquet(f"{path}/meta").first()["probes"]
    facts = spark.read.parquet(f"{path}/facts")
    scanned = vector_index.probed(spark, path, q, probes).join(facts, ["scope", "cell"]).agg(F.sum("n").alias("n")).first()["n"]
    assert scanned < len(rows) / 4 * 100 / 3
    everything = vector_index.search(spark, path, q, 10, probes=10**6, candidates=2000)
    assert {(r["query_id"], r["vec_id"]): r["score"] for r in everything.collect()} == exact


def test_vector_filter_keeps_rare_scopes(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "rare" if i < 3 else "common", rng.normal(size=8).tolist()) for i in range(900)] + [(1000, "rare", None), (1001, None, [1.0] * 8), (1002, "rare", [0.0] * 8), (None, "rare", [1.0] * 8)]
    e = spark.createDataFrame(rows, "vec_id long, scope string, embedding array<double>")
    path = folder(spark, "vectors")
    vector_index.build(e, path)
    q = spark.createDataFrame([(1, "rare", [1.0] * 8), (2, "nowhere", [1.0] * 8), (3, "common", None), (4, "rare", [0.0] * 8)], "query_id long, scope string, embedding array<double>")
    got = vector_index.search(spark, path, q, 5, probes=50).collect()
    assert sorted((r["query_id"], r["vec_id"]) for r in got) == [(a, b) for a in (1, 4) for b in (0, 1, 2, 1002)]
    assert all(r["score"] == 0 for r in got if r["query_id"] == 4)


def test_registered_vectors_reach_recall(spark):
    from strandline import catalog

    d, queries = "/root/testdata/sf0.01", catalog.queries()
    exact = {(r["query_id"], r["vec_id"]) for r in queries["knn_cosine_topk"](spark, d).collect()}
    got = {(r["query_id"], r["vec_id"]) for r in queries["knn_approximate"](spark, d).collect()}
    assert len(got) == len(exact) and len(exact & got) >= 0.9 * len(exact)
