"""Steps over long texts: linear, outside Python where they can be, and equal to their plain versions."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import functions as F

from strandline.functions import text
from strandline.operators import canonical, evaluation
from strandline.streaming import deltas

LETTERS = ["a", "B", "é", "ß", "中", "\U0001f600", " ", "\n", "\r", "\t", "\x1c", "\x85", " ", " ", "﻿", ".", "。", "!", "&amp;", "ﬁ", "x" * 7]


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def texts(n: int, letters=LETTERS, most: int = 40):
    rng = random.Random(11)
    return [None, "", *["".join(rng.choice(letters) for _ in range(rng.randrange(most))) for _ in range(n)]]


def test_blocks_are_stripped_and_measured_without_patterns_over_their_text(spark):
    rows = spark.createDataFrame([(t,) for t in texts(400)], "t string")
    got = rows.select("t", text.strip(F.col("t")).alias("s"), text.normalize_block(F.col("t"), F.lit("PARAGRAPH")).alias("n"), text.utf16_len(F.col("t")).alias("u"))
    assert "regexp_replace" not in plan(rows.select(text.strip(F.col("t"))))
    for r in got.collect():
        t = r["t"]
        if t is None:
            assert r["s"] is None and r["n"] is None and r["u"] is None
            continue
        assert r["s"] == t.strip(text._SPACES) and r["u"] == len(t.encode("utf-16-le")) // 2
        assert r["n"] == t.replace("\r\n", "\n").replace("\r", "\n").replace("﻿", "").strip(text._SPACES)


def test_texts_are_split_outside_python(spark):
    rows = spark.createDataFrame([(t,) for t in texts(300, most=90)], "t string")
    for limit in (1, 2, 3, 4, 9, 20):
        for r in rows.select("t", text.safe_split(limit)("t").alias("p")).collect():
            assert r["p"] == text.split_text(r["t"], limit), (limit, r)
    # Python is given only the texts whose units must be counted
    x = plan(rows.select(text.safe_split(9)("t").alias("p")))
    assert "regexp_extract_all" in x and "safe_split" not in x and "CASE WHEN" in next(y for y in x.splitlines() if "ArrowEvalPython" in y or "CASE WHEN" in y)


def test_folding_leaves_plain_texts_out_of_python(spark):
    rows = spark.createDataFrame([(t,) for t in texts(400)], "t string")
    got = rows.select("t", text.nfkc_fold()(F.col("t")).alias("f"))
    assert all(r["f"] == text.fold_text(r["t"]) for r in got.collect())
    # a batch is held as objects a few rows at a time, and plain texts are null there
    held = []
    text._sliced(lambda x: held.append(x), pa.null(), "void").func(pa.array(["a"] * 200))
    assert len(held) == 200 and "CASE WHEN" in next(y for y in plan(got).splitlines() if "ArrowEvalPython" in y or "CASE WHEN" in y)


def test_a_named_column_is_folded_like_its_column(spark):
    rows = spark.createDataFrame([(t,) for t in texts(100)], "t string")
    assert all(r["f"] == text.fold_text(r["t"]) for r in rows.select("t", text.nfkc_fold()("t").alias("f")).collect())
    # citations and anchors whose texts go through Python: entities, wide letters, both, none
    said = ["ORDER 1 &amp; \u00e9t\u00e9", "order1&\u00c9t\u00c9!", "\uff2frder 1 now", "nothing \u00e9", None]
    cases = spark.createDataFrame([(1, True, "ANSWERED"), (2, False, "INSUFFICIENT_EVIDENCE")], "case_id long, answerable boolean, status string")
    citations = spark.createDataFrame([(c, n, "a", t) for c in (1, 2) for n, t in enumerate(said)], "case_id long, n long, document string, text string")
    anchors = spark.createDataFrame([(1, "a", "Order\u00a01 &amp; \u00e9T\u00e9"), (2, "a", "ORDER 1")], "case_id long, document string, anchor string")
    got = evaluation.answer_checks(cases, citations, anchors).collect()
    assert {(r["case_id"], r["citations"], r["valid_citations"], r["relevant_document"], r["fabricated"]) for r in got} == {(1, 5, 2, True, False), (2, 5, 3, True, True)}
    ranked = spark.createDataFrame([(1, i, i, t) for i, t in enumerate(said)], "query_id long, item long, rank long, text string")
    wanted = spark.createDataFrame([(1, i, "order 1 &amp; \u00e9t\u00e9") for i in range(4)], "query_id long, item long, anchor string")
    assert evaluation.anchor_recall(wanted, ranked, 10).first()["anchor_recall_10"] == 0.5


def test_answers_are_read_in_runs():
    """A character is looked at alone only where it may change the state."""
    seen = []

    class Counted(deltas.AnswerDeltas):
        def _one(self, c):
            seen.append(c)
            super()._one(c)

    answer = "plain words E1, [E2, e3] and \\u00e9 " * 200
    reader = Counted()
    line = '{"answer":"' + answer + '"}'
    shown = "".join(reader.feed(line[k : k + 64]) for k in range(0, len(line), 64)) + reader.close()
    assert shown == "plain words ,  and \xe9 " * 200 and len(seen) < len(line) / 4


def test_letters_are_counted_not_sorted(spark):
    rng = random.Random(5)
    pairs = [("ab", "ba", True), ("ab", "abb", False), ("ab", "ac", False), ("", "", True), (None, "a", None), ("a\U0001f600é", "é\U0001f600a", True)]
    pairs += [(t, "".join(rng.sample(t, len(t))), True) for t in texts(50)[2:]]
    assert all(text.letters_equal(x, y) is want for x, y, want in pairs)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id int, position int, text string")
    got = canonical.text_preserved(frame([(1, 0, "a b"), (2, 0, "ab"), (3, 1, "d"), (3, 0, "c"), (4, 0, "x"), (6, 0, "aab")]), frame([(1, 0, "ab"), (2, 0, "b"), (2, 1, "a"), (3, 0, "cd"), (5, 0, "x"), (6, 0, "abb")]))
    assert {tuple(r) for r in got.collect()} == {(1, True, True), (2, False, True), (3, True, True), (4, False, False), (5, False, False), (6, False, False)}
    assert "split(" not in plan(got)
