"""Golden values of the retrieval service's behaviour, and registry checks against the oracles."""

from __future__ import annotations

import glob
import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline import catalog
from strandline.functions import hashing, text, vectors
from strandline.operators import artifacts, canonical, cards, control, evaluation, geometry, projection, search, session
from strandline.sources import docx, html_table, markdown, readers
from strandline.streaming.deltas import AnswerDeltas, DeltaError, chunks, visible_text

SF = "/root/testdata/sf0.001"


def one(spark, col, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(col.alias("x")).first()["x"]


def test_ranking_golden(spark):
    ranked = spark.createDataFrame([(1, "noise", 1), (1, "a", 2), (1, "b", 3), (2, "x", 1)], "query_id long, item string, rank int")
    gold = spark.createDataFrame([(1, "a"), (1, "b")], "query_id long, item string")
    got = {r["query_id"]: r for r in evaluation.ranking_metrics(ranked, gold).collect()}
    assert (got[1]["recall_5"], got[1]["rr_10"], got[1]["ndcg_10"]) == (1.0, 0.5, 0.693426)
    assert got[2]["recall_5"] is None and got[2]["rr_10"] is None


def test_latency_golden(spark):
    r = evaluation.latency_summary(spark.createDataFrame([(1, float(i)) for i in (1, 2, 3, 4)], "g long, v double"), "v", "g").first()
    assert (r["p50"], r["p95"], r["p99"], r["mean"]) == (2.0, 4.0, 4.0, 2.5)
    assert text.fold_text(' A \n B\tC ') == "abc" and text.fold_text("&amp;Ａ") == "&a"


def test_rrf_golden(spark):
    kw = spark.createDataFrame([(1, 41, 1, 1)], "query_id long, version long, heading int, rank int")
    sem = spark.createDataFrame([(1, 41, 1, 1, False)], "query_id long, version long, heading int, rank int, is_profile boolean")
    r = search.fuse(kw, sem).first()
    assert r["score"] == round(2 / 61, 9) and r["channels"] == "KEYWORD+SEMANTIC"


def test_coverage_golden(spark):
    rows = [(1, "a-1", "A", 1), (1, "a-2", "A", 2), (1, "a-3", "A", 3), (1, "b", "B", 4), (1, "c", "C", 5)]
    out = search.round_robin(spark.createDataFrame(rows, "query_id long, item string, family string, rank int"), "family", 3).orderBy("position").collect()
    assert [r["item"] for r in out] == ["a-1", "b", "c"]


def test_paragraphs_golden(spark):
    t = "first line\nsecond line\n\nlast paragraph"
    out = one(spark, canonical.paragraphs(text.clean_source(F.col("t"))), t="\ufeff" + t)
    assert [(p["start_line"], p["text"]) for p in out] == [(1, "first line\nsecond line"), (4, "last paragraph")]
    assert one(spark, canonical.paragraphs(F.col("t")), t=" \n") == []


def test_heading_tree_golden(spark):
    rows = [(1, i, "HEADING", lv, f"h{i}") for i, lv in enumerate([1, 3, 3, 2, 4, 1])]
    blocks = canonical.assemble(spark.createDataFrame(rows, "doc_id long, src int, kind string, level int, text string"))
    tree = {r["pos"]: r for r in canonical.heading_tree(blocks).collect()}
    assert [tree[i]["parent"] for i in range(6)] == [-1, 0, 0, 0, 3, -1]
    assert [tree[i]["section_end"] for i in range(6)] == [5, 2, 3, 5, 5, 6] and tree[4]["path"] == "h0 > h3 > h4"
    assert {(r["code"], r["pos"]) for r in canonical.warnings(canonical.heading_tree(blocks), blocks).collect()} == {("HEADING_LEVEL_JUMP", 1), ("HEADING_LEVEL_JUMP", 2), ("HEADING_LEVEL_JUMP", 4)}
    assert canonical.violations(blocks).count() == 0


def test_text_functions(spark):
    assert one(spark, text.utf16_len(F.col("t")), t="a\U0001f600b") == 4 and one(spark, text.estimate_tokens(F.col("t")), t="abcde中") == 3
    assert one(spark, text.sanitize_answer(F.col("t")), t="x [E1, e22] . y [ e3 ]  ") == "x. y"
    levels = {"1.2.3 Title": 2, "1.2 Title": 1, "1 Title": None, "1.2.3. Title": 3, "２．３） x": 2, "iv) x": 1, "Ⅳ. x": 1, "Section B: x": 1, "chapter 2 x": None, "SEMESTER 1: quarter 2": 1, "十二、x": 1, "1.2.3.4.5.6: x": 6, "Plain": None}
    assert {t: one(spark, text.heading_level(F.col("t")), t=t) for t in levels} == levels
    assert one(spark, text.title_key(F.col("t")), t="Ａ 1.25 b") == "a#b"
    units = {("a\U0001f600b", 2): "a", ("a\U0001f600b", 3): "a\U0001f600", ("\U0001f600\U0001f600", 3): "\U0001f600", ("abc", 2): "ab", ("", 3): ""}
    assert {k: one(spark, text.prefix(F.col("t"), k[1]), t=k[0]) for k in units} == units
    assert one(spark, text.plausible_heading(F.col("t")), t="The State of the Art") and not one(spark, text.plausible_heading(F.col("t")), t="this is not one")
    assert text.split_text("aaa. bbb", 5) == ["aaa.", "bbb"] and text.split_text("\U0001f600" * 3, 3) == ["\U0001f600"] * 3 and text.split_tokens("中文字", 2) == ["中文", "字"]
    assert one(spark, text.highlight_segments(F.col("t")), t="x\ue000y\ue001")[1]["matched"] and one(spark, text.highlight_segments(F.col("t"), strict=False), t="x\ue000") is None
    odd = one(spark, text.highlight_fragments(F.array("t", "t", "u", "v")), t="\ue001a\ue000b\ue000c\ue001d", u="\ue000\ue001", v="z")
    assert [[tuple(x) for x in f] for f in odd] == [[("\ue001a", False), ("b\ue000c", True), ("d", False)], [("z", False)]]
    with pytest.raises(Exception, match="a match has no end"):
        one(spark, text.highlight_segments(F.col("t")), t="x\ue000")
    assert one(spark, hashing.fingerprint_prefixed(F.lit("ab"), F.lit("c"))) != one(spark, hashing.fingerprint_prefixed(F.lit("a"), F.lit("bc")))
    assert vectors.decode_vector(vectors.encode_vector([1.5, -2.0])) == [1.5, -2.0] and abs(sum(x * x for x in vectors.embed_text("some words", 64)) - 1) < 1e-6


def test_partition_golden():
    assert cards.best_partition([100] * 6, [(0, 1), (2, 1), (4, 1)], 50, 200, 3, 4) == [0, 2, 4]
    strong = [(i, 5 if i in (0, 64, 128) else 1) for i in range(192)]
    assert cards.best_partition([1000] * 192, strong, 1000, 64000, 3, 4) == [0, 64, 128]
    assert cards.best_partition([10, 10], [(0, 1)], 5, 12, 2, 3) is None


def test_partition_matches_enumeration():
    import itertools
    import random

    rng = random.Random(0)
    for _ in range(60):
        tokens = [rng.randrange(1, 30) for _ in range(rng.randrange(2, 9))]
        cands = [(0, 1)] + [(i, rng.randrange(1, 6)) for i in range(1, len(tokens)) if rng.random() < 0.7]
        want = None
        for n in (2, 3):
            options = []
            for cut in itertools.combinations([c for c in cands if c[0]], n - 1):
                starts = [0, *(c[0] for c in cut)]
                sizes = [sum(tokens[a:b]) for a, b in zip(starts, [*starts[1:], len(tokens)], strict=True)]
                if all(5 <= s <= 60 for s in sizes):
                    options.append((sum(c[1] for c in cut), -round(sum(abs(s - sum(tokens) / n) for s in sizes), 9)))
            if options:
                want = (n, max(options))
                break
        got = cards.best_partition(tokens, cands, 5, 60, 2, 3)
        assert (got is None) == (want is None)
        if got:
            sizes = [sum(tokens[a:b]) for a, b in zip(got, [*got[1:], len(tokens)], strict=True)]
            assert (len(got), (sum(dict(cands)[a] for a in got[1:]), -round(sum(abs(s - sum(tokens) / len(got)) for s in sizes), 9))) == want


def test_markdown_golden():
    md = "# Install\n\nRun the service.\n\n## Verify\n\n```\nhealthy\n```\n\n- item one\n> quoted\n"
    out = markdown.parse(md)
    assert [(b["kind"], b["text"]) for b in out] == [("HEADING", "Install"), ("PARAGRAPH", "Run the service."), ("HEADING", "Verify"), ("CODE_BLOCK", "healthy"), ("LIST_ITEM", "item one"), ("QUOTE", "quoted")]
    assert out[0]["start_line"] == 1 and out[2]["start_line"] == 5 and out[2]["level"] == 2


def test_markdown_containers():
    kinds = lambda md: [(b["kind"], b["text"]) for b in markdown.parse(md)]
    assert kinds("> - a list\n>   in a quote\n>\n> after") == [("LIST_ITEM", "a list in a quote"), ("QUOTE", "after")]
    assert kinds("- one\n\n  second paragraph\n\n  ```\n  code\n  ```\n- two\n  > quoted\n\nout") == [("LIST_ITEM", "one"), ("LIST_ITEM", "second paragraph"), ("CODE_BLOCK", "code"), ("LIST_ITEM", "two"), ("LIST_ITEM", "quoted"), ("PARAGRAPH", "out")]
    assert kinds("a\n***\nb\n- - -\n1. x\n   1) y\nlazy") == [("PARAGRAPH", "a"), ("PARAGRAPH", "b"), ("LIST_ITEM", "x"), ("LIST_ITEM", "y lazy")]
    assert kinds("> lazy\nquote\n\ntext\n2. no list\n\n    code\n\n    more\n\n[x]: http://y\nlast") == [("QUOTE", "lazy quote"), ("PARAGRAPH", "text 2. no list"), ("CODE_BLOCK", "code\n\nmore"), ("PARAGRAPH", "last")]
    raw = markdown.parse("<div>\n*x*\n</div>\n\n<!-- a\n\nb -->\np")
    assert [(b["kind"], b["warning"], b["start_line"], b["end_line"]) for b in raw] == [("RAW_TEXT", "STRUCTURE_FLATTENED", 1, 3), ("RAW_TEXT", "STRUCTURE_FLATTENED", 5, 7), ("PARAGRAPH", None, 8, 8)]
    assert markdown.parse("Title\ngoes on\n===\n\n~~~\n```\n~~~")[0] | {"text": ""} == {"kind": "HEADING", "level": 1, "text": "", "start_line": 1, "end_line": 3, "warning": None}
    assert markdown.parse(None) == [] and kinds("```\nopen") == [("CODE_BLOCK", "open")]


def test_markdown_inline():
    cases = {
        "a **bold _and_ it** `co*de` x": "a bold and it co*de x", "[text](http://x.y/(z) 't') ![alt](i.png)": "text alt", "\\*no\\* &amp; &lt; <b>t</b> <http://a.b>": "*no* & < <b>t</b> http://a.b",
        "snake_case_name 2 * 3 * 4": "snake_case_name 2 * 3 * 4", "[ref][id] [id] [other]": "ref id [other]", "``a ` b``": "a ` b", "hard  \nbreak\\\nand soft\nline": "hard\nbreak\nand soft line",
    }
    for md, want in cases.items():
        assert markdown.parse(md + "\n\n[id]: http://x")[0]["text"] == want, md


def test_html_table_golden():
    cells = html_table.parse("<table><tr><th rowspan=2>A</th><th colspan=2>B &amp; C</th></tr><tr><td> x <td>y</tr></table>")
    assert [(c["row"], c["col"], c["row_span"], c["col_span"], c["header"], c["text"]) for c in cells] == [(0, 0, 2, 1, True, "A"), (0, 1, 1, 2, True, "B & C"), (1, 1, 1, 1, False, "x"), (1, 2, 1, 1, False, "y")]


def test_docx_golden(tmp_path):
    import zipfile

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="", x="": f'<w:p><w:pPr>{f"<w:pStyle w:val={chr(34)}{s}{chr(34)}/>" if s else ""}{x}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    body = p("Doc", "Title") + p("One", "Heading1") + p("text") + p("li", "", "<w:numPr/>") + f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>"
    path = tmp_path / "x.docx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("[Content_Types].xml", "<x/>")
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    out = docx.parse(path.read_bytes())
    assert [(b["kind"], b["text"]) for b in out] == [("TITLE", "Doc"), ("HEADING", "One"), ("PARAGRAPH", "text"), ("LIST_ITEM", "li"), ("TABLE_CELL", "a"), ("TABLE_CELL", "b")]
    assert (out[5]["row"], out[5]["col"]) == (0, 1)
    with pytest.raises(docx.DocumentError):
        docx.parse(b"no zip")


def test_deltas_golden():
    body = '{"meta":{"answer":"decoy"},"answer":"Hi \\"x\\" \\ud83d\\ude00 [E1, E22] end E5 ok.","evidenceIds":["E1"]}'
    for n in range(1, 30):
        d = AnswerDeltas()
        got = "".join(d.feed(body[k : k + n]) for k in range(0, len(body), n)) + d.close()
        assert got == 'Hi "x" \U0001f600  end  ok.'
    shown = {"see [e1] a  b e5": "see  a  b ", "[a [E1] b": "[a [] b", "x_E5-r7,S1a": "x_-,S1a", "E[E1]5 E0 [E1": " E0 [", "[ E1 ，e2 ]": "", "中E5文": "中文"}
    for answer, want in shown.items():
        text_ = json.dumps({"answer": answer})
        assert {visible_text(text_, n) for n in (1, 2, 3, 100)} == {want}
    d = AnswerDeltas()
    assert d.feed('{"answer":"答案[E') + d.feed("12") == "答案" and d.feed("] 完成 E") == " 完成 " and d.feed('1"}') == ""
    for bad in ('{"answer":"\\x"}', '{"answer":"a","answer":"b"}', '{"answer":"\\ud800x"}', '{"answer":"a\nb"}', '{"answer":"[' + "a" * 4096):
        with pytest.raises(DeltaError):
            AnswerDeltas().feed(bad)
    with pytest.raises(DeltaError):
        AnswerDeltas(limit=5).feed('{"answer":"long"}')
    assert list(chunks(["ab" * 3], 4)) == [(1, "abab"), (2, "ab")]


def test_failures_golden(spark):
    rows = [("ACCESS", "KNOWLEDGE_BASE_NOT_AVAILABLE", "-"), ("IDEMPOTENCY", "CORRUPTED_STATE", "-"), ("ANSWER", "EXECUTION_TIMEOUT", "-"), ("BUSINESS", "TOO_LARGE", "UPLOAD"), ("BUSINESS", "UNAVAILABLE", "QUERY_AUDIT_UNAVAILABLE"), ("X", "Y", "Z"), (None, None, None)]
    got = [tuple(r)[3:] for r in control.classify_failures(spark.createDataFrame(rows, "kind string, reason string, code string")).collect()]
    assert got == [
        ("REJECTED", 404, "AUTHORIZATION", "KNOWLEDGE_BASE_NOT_AVAILABLE"), ("FAILED", 503, "IDEMPOTENCY", "QUERY_IDEMPOTENCY_UNAVAILABLE"), ("FAILED", 503, "TIMEOUT", "ANSWER_EXECUTION_TIMEOUT"), ("REJECTED", 413, "VALIDATION", "UPLOAD"),
        ("FAILED", 503, "AUDIT_STORAGE", "QUERY_AUDIT_UNAVAILABLE"), ("FAILED", 500, "INTERNAL", "INTERNAL_ERROR"), ("FAILED", 500, "INTERNAL", "INTERNAL_ERROR"),
    ]


def test_analyzers_golden(spark):
    t = "The Ｔest of 检索服务 a.b 3.5 it's 段 かな カタカナ x_y"
    assert one(spark, text.bigram_tokens(F.col("t")), t=t) == ["test", "检索", "索服", "服务", "a.b", "3.5", "it's", "段", "かな", "カタ", "タカ", "カナ", "x_y"]
    assert one(spark, text.standard_tokens(F.col("t")), t="The 检索 カタカナ 1,000") == ["the", "检", "索", "カタカナ", "1,000"]


def test_search_inside_a_sentence(spark):
    d = spark.createDataFrame([(1, "系统提供文档检索服务"), (2, "完全无关的句子"), (3, "")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "检索")], "query_id long, text string")
    assert [r["doc_id"] for r in search.bm25_top(d, q, 5, analyzer=text.bigram_tokens).collect()] == [1]
    assert search.highlight(d.where("doc_id = 1").selectExpr("1L AS query_id", "*"), q).first()["fragments"] == ["系统提供文档\ue000检索\ue001服务"]


def test_fragments_plain():
    body = "alpha beta " * 40 + "gamma delta " + "alpha beta " * 40
    got = search.fragments(body, {"gamma", "delta", "alpha"}, 160, 3, "<", ">")
    assert len(got) == 3 and any("<gamma> <delta>" in x for x in got) and all(len(x.replace("<", "").replace(">", "")) <= 200 for x in got)
    assert "".join(got).replace("<", "").replace(">", "").replace(" ", "") in body.replace(" ", "") or len(got) == 3
    assert search.fragments("", {"a"}, 10, 3, "<", ">") == [] and search.fragments("b", {"a"}, 10, 3, "<", ">") == [] and search.fragments("中" * 50 + "国家", {"国家"}, 10, 3, "<", ">") == ["<国家>"]


def test_page_mapping_golden(spark):
    pages = spark.createDataFrame([("d", 1, "i"), ("d", 2, "1"), ("d", 3, "2"), ("d", 4, "2")], "document string, physical int, label string")
    wanted = spark.createDataFrame([("d", "1"), ("d", "2"), ("d", "9")], "document string, printed string")
    got = {r["printed"]: (r["physical"], r["error"]) for r in evaluation.page_mapping(pages, wanted).collect()}
    assert got == {"1": (2, None), "2": (None, "label on 2 pages"), "9": (None, "label on 0 pages")}


def test_glyph_lines_golden(spark):
    glyph = lambda y, x, t, w=5.0, size=10.0, font="Serif": (1, y, x, w, 8.0, size, font, t, 100.0)
    rows = [glyph(10.0, 5.0, "b"), glyph(11.0, 0.0, "a"), glyph(13.0, 12.5, "c", font="Serif-Bold"), glyph(14.0, 0.0, "d"), glyph(14.0, 40.0, "e"), glyph(30.0, 0.0, " "), glyph(31.0, 5.2, "f", size=20.0), glyph(50.0, 0.0, " ")]
    out = geometry.glyph_lines(spark.createDataFrame(rows, "page int, y double, x double, width double, height double, font_size double, font string, text string, page_width double"), "page").orderBy("line").collect()
    assert [(r["text"], r["bold"], r["large_gap"], r["font_size"]) for r in out] == [("ab c", True, False, 10.0), ("d e", False, True, 10.0), ("f", False, False, 20.0)]


def test_word_lines_golden(spark):
    rows = [("c", 10.0, 20.0, 25.0, "two", False), ("c", 11.9, 0.0, 5.0, "one", True), ("c", 12.1, 0.0, 5.0, "next", False), ("c", 14.0, 9.0, 12.0, " ", True), ("c", 14.0, 9.0, 12.0, "word", True)]
    out = geometry.word_lines(spark.createDataFrame(rows, "cell string, top double, x0 double, x1 double, text string, bold boolean"), "cell").orderBy("line").collect()
    assert [(r["text"], r["bold"], r["mixed"]) for r in out] == [("one two", True, True), ("next word", False, False)]


def test_two_columns_golden(spark):
    lines = [(t, n) for t in "abcd" for n in range(5)]
    words = [(t, n, x, x + 10.0, f"{t}{n}{side}") for t, n in lines for side, x in (("l", 0.0), ("r", 60.0)) if not (t == "b" and n > 1 and side == "r")] + [("c", 2, 45.0, 55.0, "over")]
    separators = [("a", 50.0, 2, 3), ("b", 50.0, 2, 3), ("c", 50.0, 2, 3), ("d", 50.0, 3, 3)]
    out = geometry.two_columns(spark.createDataFrame(lines, "table_id string, line int"), spark.createDataFrame(words, "table_id string, line int, x0 double, x1 double, text string"), spark.createDataFrame(separators, "table_id string, x double, columns int, rows int")).collect()
    assert {r["table_id"] for r in out} == {"a"} and sorted((r["row"], r["column"], r["text"]) for r in out) == [(n, c, f"a{n}{'lr'[c]}") for n in range(5) for c in (0, 1)]


def test_cell_segments_golden(spark):
    rows = [(0, "Title", True, False), (1, "more title", True, False), (2, "body", False, False), (3, "Next", True, True), (4, "tail", False, False), (5, " ", False, False), (6, "Last", True, False)]
    out = geometry.cell_segments(spark.createDataFrame([(1, *r) for r in rows], "cell int, line int, text string, bold boolean, mixed boolean"), "cell").orderBy("segment").collect()
    assert [(r["text"], r["heading"]) for r in out] == [("Title\nmore title\nbody", "Title\nmore title"), ("Next\ntail", "Next"), ("Last", "Last")]


def test_section_cards_match_recursion(spark):
    rows = [(1, i, "HEADING" if lv else "PARAGRAPH", lv, t) for i, (lv, t) in enumerate([(None, "before"), (1, "A"), (None, "some words here"), (2, "B"), (3, "C"), (None, "deep text"), (None, "again"), (2, "D"), (1, "E")])]
    blocks = canonical.assemble(spark.createDataFrame(rows, "doc_id long, src int, kind string, level int, text string"))
    got = {r["title"]: r for r in artifacts.section_cards(blocks, canonical.heading_tree(blocks)).collect()}
    assert got["C"]["source"] == "deep text\n\nagain" and got["D"]["source"] == "Section title: D" and got["E"]["source"] == "Section title: E"
    render = lambda t: f"Section: {t}\nSummary: {got[t]['card']['summary']}\nTopics: {' | '.join(got[t]['card']['topics'])}\nQuestions: What does {t} say?"
    assert got["B"]["source"] == render("C") and got["A"]["source"] == "some words here\n\n" + render("B") + "\n\n" + render("D")
    assert got["C"]["card"]["summary"] == "deep text\n\nagain"


def test_reduced_sources():
    halve = lambda s: s[: len(s) // 2]
    assert artifacts.reduced("a" * 100, 30, text.split_text, halve, len).count("a") <= 30
    assert artifacts.reduced("short", 30, text.split_text, halve, len) == "short"
    with pytest.raises(ValueError):
        artifacts.reduced("a" * 100, 30, text.split_text, lambda s: s, len)
    with pytest.raises(ValueError):
        artifacts.reduced("a" * 10**5, 1, lambda s, n: [s], lambda s: s[:-1], len)


def test_final_packages_plain():
    block = lambda *os: [{"ordinal": o, "tokens": 10} for o in os]
    row = lambda n, doc, o, page, whole, near: {"n": n, "evidence": f"E{n}", "doc_id": doc, "ordinal": o, "page": page, "whole": whole, "near": near}
    rows = [row(1, 1, 3, 1, block(1, 2, 3, 4), block(2, 3, 4)), row(2, 1, 4, 1, block(1, 2, 3, 4), block(3, 4, 5)), row(3, 2, 9, None, None, block(6, 7, 8, 9)), row(4, 2, 7, None, None, block(4, 5, 6, 7)), row(5, 3, 5, 2, block(*range(9)), block(4, 5, 6))]
    assert list(session.pack(rows, 115)) == [(1, "PAGE", 1, ["E1", "E2"], [1, 2, 3, 4], 40), (2, "CANONICAL_WINDOW", 2, ["E3", "E4"], [6, 7, 8, 9], 40), (3, "ANCHOR_NEIGHBORHOOD", 3, ["E5"], [4, 5, 6], 30)]
    assert [p[0] for p in session.pack(rows, 75)] == [1, 2] and list(session.pack(rows[4:], 20)) == []


def test_normalized_answer():
    assert evaluation.normalized_answer("The  ＡBC [e12], 3.5 % ß_x!") == "theabc3.5%ss_x" and evaluation.normalized_answer(None) == ""


def test_corrected_metrics(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "query_id long, item long, rank int")
    gold = spark.createDataFrame([(1, 12)], "query_id long, item long")
    items = spark.createDataFrame([(10, "x"), (11, "same"), (12, "same")], "item long, sha string")
    assert evaluation.corrected_metrics(ranked, gold, items).first()["rr_10"] == 0.5


def test_case_selection_prefers_new_documents(spark):
    from strandline.functions.hashing import hash_order

    rows = [(i, f"d{i % 4}", "ab"[i % 2], "yn"[i % 3 == 0]) for i in range(60)]
    table_ = spark.createDataFrame(rows, "case long, document string, domain string, label string")
    quotas = {"y": {"a": 3, "b": 1}, "n": {"b": 3, "a": 1}}
    got = [r["case"] for r in evaluation.select_cases(table_, quotas, "s").orderBy("step", "n").collect()]
    scored = {(r["case"], label, domain): r["h"] for label, d in quotas.items() for domain in d for r in table_.select("case", hash_order(f"s|{label}|{domain}", F.col("case"), F.col("document")).alias("h")).collect()}
    want, used = [], set()
    for label, by_domain in quotas.items():
        for domain, quota in by_domain.items():
            order = sorted((r for r in rows if r[2] == domain and r[3] == label), key=lambda r: (scored[r[0], label, domain], r[0]))
            own = []
            for fresh in (True, False):
                for r in order:
                    if len(own) < quota and r[0] not in own and not (fresh and r[1] in used):
                        own.append(r[0])
                        used.add(r[1])
            want += own
    assert got == want
    with pytest.raises(ValueError):
        evaluation.select_cases(table_, {"y": {"a": 99}}, "s")


def test_object_store(spark, tmp_path):
    store = readers.ObjectStore(spark, f"file://{tmp_path}/store")
    digest = store.put("a/b.jsonl", b"one\n")
    assert store.exists("a/b.jsonl") and store.open("a/b.jsonl") == b"one\n" and store.put("a/b.jsonl", b"one\n") == digest
    with pytest.raises(FileExistsError):
        store.put("a/b.jsonl", b"two")
    for bad in ("", "../x", "a//b"):
        with pytest.raises(ValueError):
            store.put(bad, b"")
    store.put("a/c.jsonl", b"three")
    with pytest.raises(ValueError):
        store.open("a/c.jsonl", most_bytes=2)
    listed = readers.stored_objects(spark, f"file://{tmp_path}/store", "*.jsonl", most_bytes=4).orderBy("path").collect()
    assert [(r["error"], r["content"] is None) for r in listed] == [(None, False), ("OBJECT_TOO_LARGE", True)] and listed[0]["sha256"] == digest
    first = readers.object_page(spark, f"file://{tmp_path}/store", limit=1, glob="*.jsonl").collect()
    second = readers.object_page(spark, f"file://{tmp_path}/store", after=first[0]["next"], limit=1, glob="*.jsonl").collect()
    assert [r["path"][-7:] for r in first + second] == ["b.jsonl", "c.jsonl"] and second[0]["next"] is None
    assert store.delete("a/b.jsonl") and not store.delete("a/b.jsonl") and not store.exists("a/b.jsonl")
    with pytest.raises(FileNotFoundError):
        store.open("a/b.jsonl")


def test_gold_cases(spark, tmp_path):
    path = tmp_path / "gold.jsonl"
    path.write_text('{"case":"a","n":1}\n\n  \n{"case":"b","n":2}\n')
    assert sorted((r["case"], r["n"]) for r in readers.gold_cases(spark, f"file://{path}", "case string, n int", "case").collect()) == [("a", 1), ("b", 2)]
    for extra, line in (("nonsense\n", 5), ("[1]\n", 5), ('{"case":"c","n":"x"}\n', 5), ('{"case":"a","n":3}\n', 5), ('{"n":3}\n', 5)):
        path.write_text('{"case":"a","n":1}\n\n  \n{"case":"b","n":2}\n' + extra)
        with pytest.raises(readers.CaseError, match=f"line {line}"):
            readers.gold_cases(spark, f"file://{path}", "case string, n int", "case")


def test_titles_stay_on_the_current_heading(spark):
    rows = [(1, 0, "HEADING", 1, "A"), (1, 1, "TITLE", 1, "The Document"), (1, 2, "PARAGRAPH", None, "x")]
    blocks = canonical.assemble(spark.createDataFrame(rows, "doc_id long, src int, kind string, level int, text string"))
    assert [(r["kind"], r["heading"]) for r in blocks.orderBy("ordinal").collect()] == [("HEADING", 0), ("TITLE", 0), ("PARAGRAPH", 0)] and canonical.heading_tree(blocks).count() == 1


def test_projection_round(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    versions = frame([(i, f"s{i}") for i in range(5)], "version_id long, source_sha string")
    canonical_ = frame([(i, "s1" if i == 0 else f"s{i}", f"c{i}") for i in range(5)], "version_id long, source_sha string, canonical_sha string")
    retrieval = frame([(i, "c9" if i == 1 else f"c{i}", f"f{i}") for i in range(5) if i != 2], "version_id long, canonical_sha string, fingerprint string")
    built = frame([(3, "f3", True), (4, "old", True)], "version_id long, fingerprint string, complete boolean")
    index = frame([(3, "a"), (4, "b"), (4, "c")], "version_id long, block string")
    rows = frame([(i, f"n{i}") for i in range(5)], "version_id long, block string")
    table_, manifest, errors = projection.build(versions, canonical_, retrieval, built, index, rows)
    assert sorted(map(tuple, table_.collect())) == [(3, "a"), (4, "n4")]
    assert sorted(map(tuple, manifest.collect())) == [(3, "f3", True), (4, "f4", True)]
    assert sorted(map(tuple, errors.collect())) == [(0, "SOURCE_DRIFT"), (1, "CANONICAL_DRIFT"), (2, "NO_RETRIEVAL")]


def test_guards(spark):
    hits = spark.createDataFrame([(1,), (2,)], "version long")
    assert search.within_snapshot(hits, hits).count() == 2
    with pytest.raises(search.OutsideSnapshot, match="version 2"):
        search.within_snapshot(hits, hits.where("version = 1"))
    with pytest.raises(ValueError):
        control.in_scope(hits, 1, 2, [])
    cases = spark.createDataFrame([(1,), (2,)], "case long")
    with pytest.raises(evaluation.RepeatedCases, match="case 2"):
        evaluation.combined_population([cases, cases.where("case = 2")], "case")
    assert evaluation.combined_population([cases.where("case = 1"), cases.where("case = 2")], "case").count() == 2


def test_merged_titles_golden(spark):
    box = lambda n, t, x0, x1, y0, kind="title", named=False, page=1: ("d", page, n, kind, t, float(x0), float(x1), float(y0), float(y0 + 10), named)
    rows = [
        box(1, "A long title", 0, 100, 0), box(2, "that goes on", 5, 90, 12), box(3, "far below", 0, 80, 60), box(4, "2.1.", 0, 20, 100), box(5, "Beside It", 25, 90, 101), box(6, "body", 0, 100, 113, "text"),
        box(7, "1. Numbered", 0, 100, 130), box(8, "apart", 0, 100, 141), box(9, "outlined", 0, 100, 160, named=True), box(10, "also apart", 0, 100, 171), box(11, "elsewhere", 300, 400, 182), box(12, "next page", 0, 100, 0, page=2),
    ]
    out = geometry.merge_titles(spark.createDataFrame(rows, "doc string, page int, n int, kind string, text string, x0 double, x1 double, y0 double, y1 double, named boolean")).orderBy("page", "n").collect()
    assert [(r["text"], r["parts"]) for r in out] == [("A long title that goes on", 2), ("far below", 1), ("2.1. Beside It", 2), ("body", 1), ("1. Numbered", 1), ("apart", 1), ("outlined", 1), ("also apart", 1), ("elsewhere", 1), ("next page", 1)]
    assert (out[0]["x0"], out[0]["x1"], out[0]["y0"], out[0]["y1"]) == (0.0, 100.0, 0.0, 22.0)


def test_authorize_and_lease(spark):
    assert one(spark, control.allows(F.lit("READ_WRITE"), F.lit("READ"))) and not one(spark, control.allows(F.lit("X"), F.lit("READ"))) and not one(spark, control.allows(F.lit(None).cast("string"), F.lit("READ")))
    assert [one(spark, control.backoff_seconds(F.lit(n))) for n in (0, 1, 5, 9)] == [1, 1, 600, 600]
    rows = session.accept_budget(spark.createDataFrame([("s", 1, 6), ("s", 2, 6), ("s", 3, 4)], "session string, n int, cost long"), 10).collect()
    assert [r["accepted"] for r in sorted(rows, key=lambda r: r["n"])] == [True, False, True]


def test_stream_claims_equal_batch(spark):
    q = catalog.queries()
    a = {tuple(r) for r in q["idempotency_claims"](spark, SF).select("key", "seq", "outcome").collect()}
    b = {tuple(r) for r in q["stream_idempotency"](spark, SF).select("key", "seq", "outcome").collect()}
    assert a == b and len(a) == 1000


def _value(x):
    if x is None or (not hasattr(x, "__len__") and pd.isna(x)):
        return "-"
    if isinstance(x, float):
        return str(int(x)) if x == int(x) else f"{x:.7g}"
    return str(x)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    want = con.execute(catalog.oracle_sql()[name]).fetchdf()
    got = catalog.queries()[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda d: sorted(tuple(_value(v) for v in r) for r in d[cols].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)
