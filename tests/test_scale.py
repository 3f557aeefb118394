"""What a step must not do as its input grows: whole groups in a row, pairs that nothing needs, all rows in one place."""

from __future__ import annotations

import random
import re
import time
import uuid

from pyspark.sql import functions as F

from strandline import adapters, catalog
from strandline.adapters import shared_dir
from strandline.functions.text import tokens
from strandline.operators import artifacts, control, geometry, keyword_index, layout, session, vector_index
from strandline.plans import structure
from strandline.streaming import outbox, pipelines


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_folds_get_their_rows_as_a_stream(spark):
    rows = spark.range(30_000).select((F.col("id") % 2).alias("k"), F.col("id").alias("n"), F.when(F.col("id") % 3 > 0, F.col("id").cast("double")).alias("v"))
    fold = lambda rows: ((r["n"], iter(rows) is rows, r["v"] is None) for r in rows)
    got = geometry._folded(rows, ["k"], ["n"], fold, "n long, lazy boolean, none boolean")
    assert "collect_list" not in plan(got)
    got = got.collect()
    assert len(got) == 30_000 and all(r["lazy"] and r["none"] == (r["n"] % 3 == 0) for r in got)
    assert [r["n"] for r in got if r["k"] == 1] == list(range(1, 30_000, 2))


def test_captions_meet_few_boxes(spark):
    tables = spark.createDataFrame([("d", 1, i, 0.0, 100.0, 100.0) for i in range(1, 301)], "doc string, page int, table_id long, x0 double, x1 double, y0 double")
    # two are as near as can be and bear the ids of tables; of the many in one place the least ids count
    box = lambda i, y1, text: ("d", 1, i, 0.0, 90.0, y1 - 10, y1, "Text", text)
    boxes = [box(1, 101.0, "one"), box(2, 101.0, "two"), *[box(1000 + i, 90.0, f"near {i}") for i in range(500)], box(1, 300.0, "far")]
    boxes = spark.createDataFrame(boxes, "doc string, page int, box_id long, x0 double, x1 double, y0 double, y1 double, kind string, text string")
    got = geometry.captions(tables, boxes)
    joins = [x for x in plan(got).splitlines() if "Join" in x and "doc" in x]
    # tables meet boxes by band, and only once a place
    assert any("band" in x for x in joins) and all("band" in x or "y0" in x for x in joins)
    found = {r["table_id"]: r["caption"] for r in got.collect()}
    assert len(found) == 300 and found[1] == "near 0\ntwo" and found[2] == "near 0\none" and found[3] == "two\none"


def test_final_packages_equal_the_plain_version(spark):
    """Pages, windows and documents with both, packages that shrink or do not fit; no session in one row."""
    rng = random.Random(7)
    kinds = {1: lambda o: o // 5, 2: lambda o: None, 3: lambda o: o // 4 if o % 11 < 6 else None}
    blocks = [(doc, o, o // 7, kinds[doc](o), rng.randrange(0, 9)) for doc in kinds for o in range(60)]
    table = {(doc, o): (heading, page, tokens) for doc, o, heading, page, tokens in blocks}
    cases = []
    for s in range(12):
        picked = [(rng.choice([1, 2, 3]), rng.randrange(60)) for _ in range(rng.randrange(1, 40))]
        cases += [(s, n, f"E{n}", doc, o) for n, (doc, o) in enumerate(dict.fromkeys(picked))]
    evidence = spark.createDataFrame(cases, "session long, n int, evidence string, doc_id long, ordinal int")
    frame = spark.createDataFrame(blocks, "doc_id long, ordinal int, heading int, page int, tokens long")
    held = lambda keep: [{"ordinal": o, "tokens": t} for _, o, t in sorted(keep)]
    for budget in (40, 150, 10_000):
        want = set()
        for s in range(12):
            rows = []
            for _, n, name, doc, o in (c for c in cases if c[0] == s):
                heading, page, _ = table[doc, o]
                near = held((d, x, t) for (d, x), (h, _, t) in table.items() if d == doc and h == heading and abs(x - o) <= 3)
                whole = held((d, x, t) for (d, x), (_, p, t) in table.items() if d == doc and p == page) if page is not None else None
                rows.append({"n": n, "evidence": name, "doc_id": doc, "ordinal": o, "page": page, "whole": whole, "near": near})
            want |= {(s, n, scope, doc, tuple(names), tuple(x), t) for n, scope, doc, names, x, t in session.pack(rows, budget)}
        got = session.final_packages(evidence, frame, budget)
        assert {(r["session"], r["package"], r["scope"], r["doc_id"], tuple(r["anchors"]), tuple(r["blocks"]), r["tokens"]) for r in got.collect()} == want
        assert "MapInPandas" in plan(got) and all("rows#" not in x for x in plan(got).splitlines())


def test_postings_are_written_where_their_block_is(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("common"), F.col("id") % 7, F.col("id")).alias("text"))
    path = f"{shared_dir(spark)}/postings-{uuid.uuid4().hex}"
    keyword_index.build(docs, (("text", tokens, 1.0),), path, block_docs=50)
    rows = spark.read.parquet(f"{path}/postings").withColumn("file", F.input_file_name())
    spread = rows.groupBy("folder", "block").agg(F.countDistinct("file").alias("files")).groupBy().agg(F.max("files").alias("most")).first()
    assert spread["most"] == 1 and rows.groupBy("folder").agg(F.countDistinct("file").alias("n")).agg(F.max("n")).first()[0] > 1
    common = rows.where("term = 'common'").select(F.sum("n"), F.sum(F.size("docs")), F.countDistinct("block"), F.max(F.size("peak_tfs"))).first()
    assert tuple(common) == (400, 400, 8, 1)


def test_tables_of_customers_are_parsed_by_all_cores(spark):
    rows = catalog.queries()["html_table_fixture"](spark, "/root/testdata/sf0.001")
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_artifact_rules_need_no_windows_over_all_cards(spark):
    got = catalog.queries()["artifact_violations"](spark, "/root/testdata/sf0.001")
    assert "windowspecdefinition(version" not in "".join(x for x in plan(got).splitlines() if "count(1)" in x)
    card = lambda n, i, node, parent, depth, part=None, end=0: (1, n, f"1:{'rn' if part is None else 'rsp'}:{i}", "HEADING_NODE" if part is None else "HEADING_SUBPARTITION", node, parent, depth, 0, part, "t", "p", n, end or n + 1, 0, 1, "x", "x")
    rows = [card(1, 1, 1, 0, 1), card(2, 1, 2, 1, 2), card(3, 3, 3, 9, 2), card(4, 4, 4, 5, 1), card(5, 5, 5, 1, 2, 0, 9), card(6, 6, 5, 1, 2, 1), card(7, 7, 5, 1, 2, None)]
    kinds = "version long, n int, card_id string, card_type string, node int, parent int, depth int, sibling int, part int, title string, path string, start int, end int, canonical_start int, canonical_end int, embedding_text string, wanted_text string"
    out = {r["rule"]: r["n"] for r in artifacts.artifact_violations(spark.createDataFrame(rows, kinds)).collect()}
    assert out == {"CARD_ID_REPEATED": 2, "MIXED_CARDS": 3, "PARTS_NOT_CONTIGUOUS": 1, "SEVERAL_ROOTS": 1, "PARENT_AFTER_CHILD": 1}


def test_titles_know_their_document_after_one_shuffle(spark):
    box = lambda n, kind, text, page=1, top=50.0: ("d", n, kind, text, page, top, top + 5)
    boxes = [box(1, "text", "before"), box(2, "Title", "Own"), box(3, "Title", "Weak one"), box(4, "text", "x" * 40), box(5, "Title", "Bare"), box(6, "Title", "Again", 2), box(7, "Title", "again", 3), box(8, "text", "y" * 50, 3, 10.0), box(9, None, "z", 3), box(10, "Title", "Last one", 3), box(11, "text", "w" * 40, 3)]
    boxes = spark.createDataFrame(boxes, "doc string, n int, kind string, text string, page int, top double, bottom double")
    outline = spark.createDataFrame([("d", 1, "bare", 1)], "doc string, page int, text string, depth int")
    got = layout.govern_titles(boxes, outline)
    assert sum("Join" in x for x in plan(got).splitlines()) == 1 and not any(x.lstrip(" :+-").startswith("Union") for x in plan(got).splitlines())
    assert {tuple(r)[1:] for r in got.collect()} == {(2, "DOCUMENT_TITLE", None), (3, "WEAK", None), (5, "ACCEPT_OUTLINE", 2), (6, "REPEATED_LABEL", None), (7, "REPEATED_LABEL", None), (10, "WEAK", None)}


def test_claims_come_row_by_row_and_their_state_lasts(spark, tmp_path):
    kind = "key string, seq long, at long, done_at long, fingerprint string, context string"
    rows = [(f"k{i % 5}", i, i * 7, i * 7 + 9 if i % 3 else None, str(i % 2), str(i // 10)) for i in range(60)]
    for n in (0, 1):
        spark.createDataFrame(rows[n * 30 : n * 30 + 30], kind).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    for expire in (False, True):
        stream = pipelines.idempotency(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in"), 40, 20, expire)
        assert "TransformWithState" in stream._jdf.queryExecution().logical().toString()
        out = f"file://{tmp_path}/out{expire}"
        sink = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state")
        q = sink.start() if expire else sink.trigger(availableNow=True).start()
        # state that expires keeps its stream going
        end = time.time() + 40
        while q.isActive and time.time() < end and not (expire and sum(p["numInputRows"] for p in q.recentProgress) >= 60):
            time.sleep(0.5)
        assert q.isActive == expire
        q.stop()
        want = {tuple(r) for r in control.idempotency(spark.createDataFrame(rows, kind), 40, 20).select("key", "seq", "outcome").collect()}
        got = {tuple(r) for r in spark.read.parquet(out).select("key", "seq", "outcome").collect()}
        assert got == want and len(got) == 60


def test_vectors_of_queries_are_not_sent_for_each_cell(spark, monkeypatch):
    rng = random.Random(3)
    e = spark.createDataFrame([(i, i % 2, [rng.gauss(0, 1) for _ in range(48)]) for i in range(1200)], "vec_id long, scope int, embedding array<double>").cache()
    path = f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup("vector-build", "")
    vector_index.build(e, path, cells=160, k=5)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    status = spark.sparkContext.statusTracker()
    stages = [status.getStageInfo(x) for j in status.getJobIdsForGroup("vector-build") for x in status.getJobInfo(j).stageIds]
    # k-means sends no distances between all centres to the driver
    assert not any(x is not None and "DistanceMeasure" in x.name for x in stages)
    q = e.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    made, keep = {}, vector_index.stored
    monkeypatch.setattr(vector_index, "stored", lambda df, name: made.setdefault(name, keep(df, name)))
    got = vector_index.search(spark, path, q, 5, probes=160)
    # a query's vector is there once, not for each cell, and the join with vectors is no broadcast, small as they are here
    assert made["vectors-probes"].count() == 120 and "rightHint=(strategy=merge)" in plan(got)
    want = {(r["query_id"], r["vec_id"]): r["score"] for r in vector_index.knn(e, q, 5).collect()}
    assert {(r["query_id"], r["vec_id"]): r["score"] for r in got.collect()} == want


def test_slices_and_parts_of_a_scope_give_the_same(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, "ab"[i % 7 > 4], [float(rng.randrange(-2, 3)) for _ in range(4)]) for i in range(900)]
    e = spark.createDataFrame(rows, "vec_id long, scope string, embedding array<double>").cache()
    path = f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
    vector_index.build(e, path, cells=6, list_rows=40)
    q = e.where("vec_id % 9 = 0").withColumnRenamed("vec_id", "query_id")
    rows = lambda: sorted(map(tuple, vector_index.search(spark, path, q, 7, probes=3, candidates=20).collect()))
    whole = rows()
    monkeypatch.setattr(vector_index, "SLICE_ROWS", 50)
    monkeypatch.setattr(vector_index, "QUERY_PART", 8)
    assert rows() == whole and len(whole) == 700


def test_lines_of_a_task_stay_few(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    names = ["visible_headings", "document_titles", "layout_paragraphs", "outline_hints", "unresolved_hints", "lines_without_margins"]
    rows = lambda: {n: sorted(str(r) for r in catalog.queries()[n](spark, d).collect()) for n in names}
    whole = rows()
    physical = lambda: catalog.queries()["visible_headings"](spark, d)._jdf.queryExecution().executedPlan().toString()
    # lines are shuffled by the document once, not by its key and then again
    assert "hashpartitioning(l_suppkey" not in physical() and "REPARTITION_BY_NUM" not in physical()
    monkeypatch.setattr(adapters, "TASK_ROWS", 400)
    n = structure.table(spark, d, "lineitem").count()
    assert structure._lines(spark, d).rdd.getNumPartitions() == -(-n // 400) > 4
    assert physical().count("REPARTITION_BY_NUM") == 1 and rows() == whole and all(whole.values())
    # what is counted by document is counted where it is read
    assert "REPARTITION_BY_NUM" not in catalog.queries()["dominant_font"](spark, d)._jdf.queryExecution().executedPlan().toString()


def test_headings_are_sorted_without_other_texts(spark):
    line = lambda n, font, text, bold=False, y=None: ("d", 1, n, n / 10 if y is None else y, 0.1, font, bold, text)
    rows = [line(0, 20.0, "Large"), line(1, 10.0, "body " * 20), line(2, 15.0, "Ends."), line(3, 11.0, "Bold", True), line(4, 11.0, "Plain"), line(5, 15.0, "Near", y=0.41), line(6, 15.0, "Far", y=0.6), line(7, 15.0, None), line(8, None, "None")]
    lines = spark.createDataFrame(rows, "doc string, page int, line int, y double, height double, font double, bold boolean, text string")
    got = layout.headings(lines)
    assert re.search(r"THEN text#\d+ END", plan(got).split("lag(")[1])
    assert sorted((r["line"], r["text"], r["level"]) for r in got.collect()) == [(0, "Large", 1), (3, "Bold", 3), (6, "Far", 2)]


def test_polls_do_not_go_through_the_queue_again(tmp_path, monkeypatch):
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = random.Random(9)
    put = lambda name, ids: pq.write_table(pa.table({"payload": [f"p{i}" for i in ids], "id": pa.array(ids, pa.int64())}), f"{tmp_path}/{name}.parquet", row_group_size=70)
    first = [*range(3000), *(rng.randrange(3000) for _ in range(600)), -1, -5, None]
    rng.shuffle(first)
    late = [*range(2000, 2900, 3), *range(5000, 5200)]
    seen, keep = [0], outbox.OutboxReader._rows

    def counted(self, *args):
        for b in keep(self, *args):
            seen[0] += b.num_rows
            yield b

    monkeypatch.setattr(outbox.OutboxReader, "_rows", counted)
    for ahead in (outbox.__dict__.get("AHEAD", 0), 250):
        monkeypatch.setattr(outbox, "AHEAD", ahead, raising=False)
        folder = tmp_path / str(ahead)
        (folder / "_temporary").mkdir(parents=True)
        (folder / "_temporary" / "part.parquet").write_bytes(b"not yet whole")
        for k in range(3):
            put(f"{ahead}/f{k}", first[k::3])
        reader, at, polls, n = outbox.OutboxReader(str(folder), 100), {"id": -1}, 0, 0
        left = sorted(i for i in first if i is not None and i >= 0)
        while True:
            seen[0] = 0
            end = reader.latestOffset()
            polls += seen[0]
            if end == at:
                break
            got = sorted(zip(*[[x for p in reader.partitions(at, end) for b in reader.read(p) for x in b.column(c).to_pylist()] for c in (0, 1)], strict=True))
            want = [i for i in left if i <= left[99]] if len(left) > 99 else left
            assert got == [(i, f"p{i}") for i in want] and end == {"id": want[-1]}
            left, at, n = left[len(want) :], end, n + 1
            if n == 15:
                put(f"{ahead}/late", late)
                left = sorted(left + late)
        assert not left and n > 35
        # one look for the first files and one for the late one, not one for each of the polls
        assert ahead == 250 or polls < 2 * (len(first) + len(late))


def test_a_task_of_the_outbox_reads_few_rows_beside_its_own(spark, monkeypatch):
    import pyarrow.parquet as pq

    monkeypatch.setattr(outbox, "GROUP_ROWS", 50)
    monkeypatch.setattr(outbox, "TASK_ROWS", 120)
    path = f"{shared_dir(spark)}/queue-{uuid.uuid4().hex}"
    outbox.append(spark.range(4000).select(((F.col("id") * 1237) % 4000).alias("id"), F.lit("p").alias("payload")).repartition(3), path)
    reader = outbox.OutboxReader(path, 300)
    parts = reader.partitions({"id": -1}, reader.latestOffset())
    system, _ = outbox.opened(path)
    rows = [sum(pq.read_metadata(system.open_input_file(f)).row_group(k).num_rows for f, k in p.groups) for p in parts]
    assert sum(rows) <= 350 and max(rows) <= 120 and len(rows) >= 3
    assert sorted(x for p in parts for b in reader.read(p) for x in b.column(0).to_pylist()) == list(range(300))
