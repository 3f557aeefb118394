"""Stages of the corpus pipeline, and the whole, against plain versions."""

from __future__ import annotations

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import decontaminate as B
from strandline.llm import simhash as H
from strandline.llm import stages as P

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mix_pass string, key int, __t string, extra map<string,int>"


def prose(rng, n, words=100_000):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def table(spark, rows):
    """Rows of (id, text[, source]); the other columns have names that stages use themselves, and one is a map."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "p", 1, "t", {"a": 1}) for r in rows], SCHEMA)


ODD = [(1, None), (2, ""), (3, " \n "), (4, "a"), (4, "a"), (None, "b c"), (None, "b c"), (5, "word " * 20000)]


@pytest.fixture
def folder(spark, tmp_path):
    def write(documents, labels=(), benchmark=()):
        documents.write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
        spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
        return str(tmp_path)

    return write


@pytest.mark.parametrize("rows", [ODD, []])
def test_stages_with_odd_rows(spark, folder, rows):
    d = table(spark, rows)
    at = folder(d)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, at)
        assert out.columns == d.columns and out.schema.simpleString() == d.schema.simpleString(), name
        got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
        want = {"near copies": [(1, None), (4, "a"), (5, "word " * 20000), (None, "b c"), (None, "b c")]}.get(name, rows) if rows else []
        assert got == sorted(want, key=str), name
    out = P.mix_sources(spark, d, at)
    assert out.columns == [c for c in d.columns if c != "mix_pass"] + ["mix_pass", "mix_shard", "mix_position"]
    assert {r["doc_id"] for r in out.where(F.length(F.trim("text")) > 2).collect()} == ({5, None} if rows else set())


def test_near_copies_match_brute_force(spark, folder):
    rng = random.Random(30)
    rows = [(i, prose(rng, rng.choice([3, 8, 60, 200]))) for i in range(60)]
    for i in range(60, 160):
        words = rng.choice(rows[:60])[1].split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 30])):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(7, prose(rng, 50)), rows[9], rows[9]]
    shingles = lambda t: {tuple(w[k : k + 5]) for w in [t.split()] for k in range(max(1, len(w) - 4))}
    sets = [shingles(t) for _, t in rows]
    pairs = [(i, j, len(sets[i] & sets[j]) / len(sets[i] | sets[j])) for i, j in itertools.combinations(range(len(rows)), 2)]
    d = table(spark, rows)
    for chunk in (8, 1024):
        root = {(r["doc_id"], r["t"]): r["root"] for r in H.similar_documents(d, chunk=chunk).collect()}
        hashes = [r["t"] for r in d.select(F.xxhash64("text").alias("t")).collect()]
        of = [root[i, t] for (i, _), t in zip(rows, hashes, strict=True)]
        near = [(i, j) for i, j, s in pairs if s >= 0.8]
        assert sum(of[i] == of[j] for i, j in near) >= 0.9 * len(near) and len(near) > 60
        assert not [(i, j, s) for i, j, s in pairs if of[i] == of[j] and s < 0.3]
    out = P.drop_near_copies(spark, d, "").collect()
    groups = {}
    for (i, t), g in zip(rows, of, strict=True):
        groups.setdefault(g, []).append((i, t))
    assert len(out) == len(groups) and all(min(i for i, _ in g) in {r["doc_id"] for r in out} for g in groups.values())


def test_wide_links_match_brute_force(spark):
    rng = random.Random(31)
    base = rng.getrandbits(128)
    fps = {rng.getrandbits(128) for _ in range(40)}
    for _ in range(200):
        x = base
        for b in rng.sample(range(128), rng.randrange(2, 34)):
            x ^= 1 << b
        fps.add(x)
    fps = sorted(fps)
    root = list(range(len(fps)))
    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 25 and root[i] != root[j]:
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    df = spark.createDataFrame([(i, H._signed(x & (1 << 64) - 1), H._signed(x >> 64)) for i, x in enumerate(fps)], "node long, a long, b long")
    # no sampled bits: one bucket holds all, so every pair is a candidate
    masks = H.table_masks
    H.table_masks = lambda *_: [(0, 0)]
    try:
        for chunk in (16, 4096):
            got = {r["node"]: r["root"] for r in H.components(H.wide_links(df, chunk=chunk)).collect()}
            assert [got.get(i, i) for i in range(len(fps))] == root, chunk
    finally:
        H.table_masks = masks
    assert len(set(root)) > 40


def test_pipeline_matches_stage_by_stage(spark, folder, tmp_path):
    rng = random.Random(32)
    item = prose(rng, 30)
    passage = prose(rng, 60)
    rows = [(i, prose(rng, 80), "ab"[i % 2]) for i in range(120)]
    labels = []
    for i in range(120, 320):
        toxic = i % 4 == 0
        rows.append((i, prose(rng, 60) + (" zorgful zorging zorgest" * 3 if toxic else ""), "a"))
        labels.append((i, 1, int(toxic)))
    rows += [(400, rows[3][1], "b"), (401, rows[5][1].replace("w1", "w2", 1), "b"), (402, prose(rng, 40) + " " + item + " " + prose(rng, 40), "a"), (403, prose(rng, 50) + " " + passage, "a"), (404, prose(rng, 50) + " " + passage + " " + prose(rng, 9), "b")]
    d = table(spark, rows)
    at = folder(d, labels, [(1, item)])
    out = corpus_pipeline.run(spark, at, folder=f"{tmp_path}/work").collect()
    again = corpus_pipeline.run(spark, at).collect()
    key = lambda r: (r["doc_id"], r["mix_pass"], r["mix_shard"], r["mix_position"], r["text"])
    assert sorted(map(key, out)) == sorted(map(key, again))
    resumed = corpus_pipeline.run(spark, at, folder=f"{tmp_path}/work").collect()
    assert sorted(map(key, out)) == sorted(map(key, resumed))
    # what a plain reading of the stages keeps, before the mix
    toxic = {i for i, _, t in labels if t}
    left = spark.read.parquet(f"{tmp_path}/work/pipeline-3")
    kept = {r["doc_id"]: r["text"] for r in left.collect()}
    assert set(kept) == {i for i, *_ in rows} - toxic - {400, 401, 402}
    assert kept[403] == rows[-2][1] and WORD.findall(kept[404]) == WORD.findall(rows[-1][1].replace(passage, ""))
    assert all(kept[i] == t for i, t, _ in rows if i in kept and i != 404)
    # the mix takes what it keeps up to three times, near each source's target
    size = {i: len(WORD.findall(t)) for i, t in kept.items()}
    words = {s: sum(size[i] for i, _, x in rows if i in kept and x == s) for s in "ab"}
    target = {"a": sum(words.values()) / 3, "b": sum(words.values()) * 2 / 3}
    if target["b"] > 3 * words["b"]:
        target = {"b": 3 * words["b"], "a": sum(words.values()) - 3 * words["b"]}
    for s in "ab":
        assert abs(sum(size[r["doc_id"]] for r in out if r["source"] == s) - target[s]) <= max(size.values())
    assert B.find_leaks(left, spark.read.parquet(f"{at}/benchmark.parquet")).count() == 0
