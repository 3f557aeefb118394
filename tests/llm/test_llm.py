"""Operators of the llm folder against plain versions, and their defined results for odd input."""

from __future__ import annotations

import hashlib
import itertools
import json
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.llm import chat_format as C
from strandline.llm import components as K
from strandline.llm import decontaminate as B
from strandline.llm import license_scan as L
from strandline.llm import mixing as M
from strandline.llm import quality as Y
from strandline.llm import simhash as H
from strandline.llm import substring_dedup as D
from strandline.llm import token_count as N
from strandline.llm import toxicity as T
from strandline.llm import url_filter as U

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, __size long"


def prose(rng, n, words=300):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def docs(spark, rows):
    """Rows of (id, text[, source]); further columns have names that operators use themselves."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 0.5, 1, 2) for r in rows], SCHEMA)


ODD = [(1, None), (2, ""), (3, " \n "), (4, "a"), (4, "a"), (None, "b c"), (5, "word " * 20000), (6, "é\U0001f600 x")]


# chat formatting
def test_layouts_become_turns(spark):
    records = [
        (1, '{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"yo"}],"id":7}'), (2, '{"conversations":[{"from":"human","value":"hi"},{"from":"gpt","value":null}]}'),
        (3, '{"instruction":"do","input":"this","output":"ok"}'), (4, '{"instruction":"do","output":"ok"}'), (5, '{"prompt":"p","response":"r","system":"s"}'), (6, '{"x":1}'), (7, "nonsense"), (8, None), (9, '{"question":"q","answer":"a"}'),
    ]
    out = C.canonical_turns(spark.createDataFrame(records, "id long, rec string"), "id", "rec").orderBy("__conv", "__turn").collect()
    got = {k: [(r["__role"], r["__text"]) for r in g] for k, g in itertools.groupby(out, lambda r: r["__conv"])}
    assert got == {
        1: [("user", "hi"), ("assistant", "yo")], 2: [("user", "hi"), ("assistant", "")], 3: [("user", "do\n\nthis"), ("assistant", "ok")], 4: [("user", "do"), ("assistant", "ok")],
        5: [("system", "s"), ("user", "p"), ("assistant", "r")], 9: [("user", "q"), ("assistant", "a")],
    }


def test_every_message_selects_its_mapping(spark):
    records = [
        (1, '{"messages":[{"role":"user"},{"role":"assistant","content":"yo"}]}'), (2, '{"messages":[{"role":"user","content":"hi"},{"from":"gpt","value":"kept"}]}'), (3, '{"data":{"messages":[{"speaker":"human","text":"deep"}],"id":1}}'),
        (4, '{"messages":[{"role":"user","content":"hi"},{"sender":"x","body":"lost?"}]}'), (5, '{"messages":[{"role":"user","content":"a","value":"b"}]}'), (6, '{"messages":[],"prompt":"p"}'), (7, '{"messages":"text"}'), (8, '{"messages":["bare"]}'),
        (9, '{"messages":[{"role":"user","content":[{"type":"text","text":"part"}],"weight":1}]}'), (10, "[1]"), (11, '{"conversations":[]}'), (12, '{"instruction":"i","context":"c","response":"r","id":3}'),
    ]
    table = spark.createDataFrame(records, "id long, rec string")
    out = C.canonical_turns(table, "id", "rec").orderBy("__conv", "__turn").collect()
    got = {k: [(r["__role"], r["__text"]) for r in g] for k, g in itertools.groupby(out, lambda r: r["__conv"])}
    assert got == {1: [("user", ""), ("assistant", "yo")], 2: [("user", "hi"), ("assistant", "kept")], 3: [("user", "deep")], 9: [("user", '[{"type":"text","text":"part"}]')], 12: [("user", "i\n\nc"), ("assistant", "r")]}
    why = {r["__conv"]: r["__reason"] for r in C.refused_records(table, "id", "rec").collect()}
    assert why == {4: "no mapping for message 2", 5: "no mapping for message 1", 6: "no layout has the fields: messages, prompt", 7: "no list of messages", 8: "no mapping for message 1", 10: "no JSON object"}


def test_further_layouts(spark):
    records = [
        (1, '{"conversations":[{"from":"human","value":"a"}],"system":"s"}'), (2, '{"messages":[{"role":"user","content":"a"}],"system":null,"tools":"[]"}'), (3, '{"system_prompt":"s","question":"q","response":"r"}'), (4, '{"question":"q","context":"c","answer":"a"}'),
        (5, '{"query":"q","response":"r"}'), (6, '{"instruction":"i","input":"n","response":"r"}'), (7, '{"problem":"p","solution":"s"}'), (8, '{"prompt":"p","response":"r","context":"c"}'),
    ]
    out = C.canonical_turns(spark.createDataFrame(records, "id long, rec string"), "id", "rec").orderBy("__conv", "__turn").collect()
    got = {k: [(r["__role"], r["__text"]) for r in g] for k, g in itertools.groupby(out, lambda r: r["__conv"])}
    assert got == {
        1: [("system", "s"), ("user", "a")], 2: [("user", "a")], 3: [("system", "s"), ("user", "q"), ("assistant", "r")], 4: [("user", "q\n\nc"), ("assistant", "a")],
        5: [("user", "q"), ("assistant", "r")], 6: [("user", "i\n\nn"), ("assistant", "r")], 7: [("user", "p"), ("assistant", "s")], 8: [("user", "p\n\nc"), ("assistant", "r")],
    }
    nested = spark.createDataFrame([(1, [("user", "a")], "s"), (2, [("user", "b")], None)], "id long, messages array<struct<role:string,content:string>>, system string")
    assert [(r["__conv"], r["__role"], r["__text"]) for r in C.canonical_nested(nested, "id").orderBy("__conv", "__turn").collect()] == [(1, "system", "s"), (1, "user", "a"), (2, "user", "b")]


def test_record_fingerprints_match_plain(spark):
    rng = random.Random(21)
    known = C._vocabulary(C.LAYOUTS)
    records = [{k: "x" for k in rng.sample([p for p in known if "." not in p] + ["id", "extra"], rng.randrange(5))} for _ in range(300)]
    want = [next((x.name for x in C.LAYOUTS if set(x.paths) <= (p := set(r) & set(known)) <= {*x.paths, *x.optional}), None) for r in records]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "id long, rec string")
    got = {r["id"]: r["l"] for r in df.select("id", C.layout_of(F.col("rec")).alias("l")).collect()}
    assert [got[i] for i in range(300)] == want and len(set(want)) > 5
    assert df.limit(1).select(C.fingerprint(F.array(F.lit("b"), F.lit("a"))).alias("f")).first()["f"] == C._digest(["a", "b"])


def test_schema_fingerprints_select_columns(spark):
    rows = spark.createDataFrame([(7, 0, "user", "hi", "other")], "conv_id long, turn int, role string, text string, content string")
    assert [(r["__conv"], r["__text"]) for r in C.canonical_rows(rows).collect()] == [(7, "hi")]
    other = spark.createDataFrame([(7, 0, "user", "there")], "conversation_id long, turn int, role string, content string")
    assert C.canonical_rows(other).first()["__text"] == "there"
    with pytest.raises(ValueError):
        C.canonical_rows(rows.drop("role"))
    nested = spark.createDataFrame([(1, [("human", "hi"), ("gpt", None)], "z"), (2, None, "z"), (3, [], "z")], "id long, conversations array<struct<`from`:string,value:string>>, extra string")
    assert [(r["__conv"], r["__role"], r["__text"]) for r in C.canonical_nested(nested, "id").orderBy("__turn").collect()] == [(1, "user", "hi"), (1, "assistant", "")]
    flat = spark.createDataFrame([(1, "p", "r", "s"), (2, None, "r", None)], "id long, prompt string, response string, system string")
    assert [(r["__conv"], r["__role"], r["__text"]) for r in C.canonical_nested(flat, "id").orderBy("__conv", "__turn").collect()] == [(1, "system", "s"), (1, "user", "p"), (1, "assistant", "r"), (2, "user", ""), (2, "assistant", "r")]
    with pytest.raises(ValueError):
        C.canonical_nested(nested.withColumnRenamed("conversations", "unknown"), "id")


def test_format_reads_back(spark):
    texts = ["</s>[INST] ok [/INST]", "\\<|turn|>\\\\<", "<|end|><<SYS>>", "", None, "\U0001f600\n<s>", "[\\INST]"]
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(texts)] + [(2, 0, None, "x"), (None, 1, "assistant", "y"), (1, 0, "user", texts[0])]
    turns = C.canonical_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    done = C.format_turns(turns).select("*", C.read_back(F.col("formatted")).alias("back")).collect()
    assert sorted(str(r["conv_id"]) for r in done) == ["1", "2", "None"]
    one = next(r for r in done if r["conv_id"] == 1)
    want = sorted([(i, r or "", t or "") for _, i, r, t in rows if _ == 1])
    assert [(b["role"], b["text"]) for b in one["back"]] == [x[1:] for x in want]
    for control, _ in C.CONTROL_STRINGS[1:]:
        assert control not in one["formatted"]
    spans = "".join(one["formatted"][s["start"] : s["start"] + s["length"]] for s in one["loss_spans"])
    assert re.sub(r"(?s)\\(.)", r"\1", spans) == "".join(t for _, r, t in want if r == "assistant")
    assert C.format_turns(turns.limit(0)).count() == 0


# toxicity
def test_fold_undoes_hiding():
    assert T.fold("1d10t!") == ["idioti"]
    assert T.fold("іdiоt Ｓtupid s​cum") == ["idiot", "stupid", "scum"]
    match = T.matcher(T.Model(lexicon={"trash": 2.0}, exceptions=frozenset(["trash can"])))
    assert match("trash can")[1] == 0 and match("a trash heap, TR4SH")[1] == 2 and match(None) == (0, 0, 0, [])


def test_learns_held_out(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(900):
        words = prose(rng, 60).split()
        toxic = i % 9 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(60), "zorg" + rng.choice(["a", "ing", "ly", "est"]) + str(rng.randrange(9)).replace("1", ""))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    d = docs(spark, [*rows, *ODD[:3], (None, "x")])
    model = T.learn(d, spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int"))
    got = T.score(d, model).withColumn("held", T.held_out()).collect()
    assert len(got) == len(rows) + 4
    held = [r for r in got if r["held"] and r["doc_id"] is not None and r["doc_id"] < 900]
    assert len(held) > 100 and sum((r["score"] >= 0.3) != (r["doc_id"] % 9 == 0) for r in held if r["doc_id"] > 3) <= 2
    assert all(0 <= r["score"] <= 1 for r in got)
    assert T.learn(d.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).lexicon == T.DEFAULT_LEXICON


def test_forms_of_long_toxic_texts_all_count(spark):
    rng = random.Random(13)
    forms = ["zorg" + a + b for a in "abcdefghijklmnopqrstuvwxy" for b in "abc"]
    rows = [(i, prose(rng, 40) + " " + " ".join(rng.sample(forms, 2))) for i in range(60)] + [(100 + i, prose(rng, 40) + " " + " ".join([*forms, "zorgzzz"])) for i in range(6)]
    labels = [(i, 1) for i, _ in rows] + [(1000 + i, 0) for i in range(500)]
    rows += [(1000 + i, prose(rng, 40) + (" zorgzzz" if i < 12 else "")) for i in range(500)]
    model = T.learn(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert "zorg" in model.lexicon and "zorgzzz" not in model.exceptions
    assert T.matcher(model)("a zorgzzz here")[1] == 1


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab c", max_size=40), st.lists(st.text(alphabet="abc", min_size=1, max_size=4), min_size=1, max_size=5), st.lists(st.text(alphabet="ab c", min_size=1, max_size=6), max_size=3))
def test_matcher_matches_brute_force(text, stems, phrases):
    model = T.Model({s: float(i + 1) for i, s in enumerate(stems)}, frozenset(p for p in phrases if p.strip()))
    line = " " + " ".join(T.fold(text)) + " "
    spans = [(i, i + len(p) - 1) for p in {" " + " ".join(T.fold(x)) + " " for x in model.exceptions} for i in range(len(line)) if line.startswith(p, i)]
    hits = []
    for i in range(len(line)):
        found = [s for s in model.lexicon if line.startswith(" " + s, i)]
        # an exception that begins here and is longer takes the entry's place
        longer = max((len(" " + " ".join(T.fold(x)) + " ") for x in model.exceptions if line.startswith(" " + " ".join(T.fold(x)) + " ", i)), default=0)
        if found and longer <= len(best := max(found, key=len)) + 1 and not any(a <= i < b for a, b in spans):
            hits.append(model.lexicon[best])
    got = T.matcher(model)(text)
    assert (round(got[0], 9), got[1]) == (round(sum(hits), 9), len(hits))


def test_matcher_is_linear():
    import time

    match = T.matcher(T.Model({"trash": 1.0}, frozenset(["trash can"])))
    took = []
    for n in (4000, 32000):
        text = "trash can trash " * n
        began = time.process_time()
        assert match(text)[1] == n
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0] + 0.2


# decontamination
def test_leaks(spark):
    rng = random.Random(2)
    items = [(1, "If Anna buys 12 apples and 12 pears for 30 dollars, how much is left from the purse in the end?"), (2, prose(rng, 40)), (3, None), (4, "tiny item"), (5, "")]
    other = "If Bertha buys 7 apples and 7 pears for 90 dollars, how much is left from the purse in the end?"
    clash = "If Bertha buys 7 apples and 8 pears for 90 dollars, how much is left from the purse in the end?"
    edited = items[1][1].split()
    edited[20] = "changed"
    d = docs(spark, [(10, prose(rng, 50) + " " + items[1][1] + " " + prose(rng, 50)), (11, "x. " + other), (12, "x. " + clash), (13, prose(rng, 400)), (14, " ".join(edited)), *ODD])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in B.find_leaks(d, bench).collect()}
    assert {(10, 2), (11, 1), (14, 2)} <= set(got) and (13, 2) not in got and (13, 1) not in got
    assert got[11, 1]["changed_slots"] > 0 and got[10, 2]["changed_slots"] == 0
    # the clash: two equal numbers of the item are two different ones there
    assert 12 not in {d for d, _ in got}
    left = B.drop_leaks(d, bench)
    assert left.columns == d.columns and 10 not in {r["doc_id"] for r in left.collect()} and left.where("doc_id = 13").count() == 1
    assert B.find_leaks(d, bench.limit(0)).count() == 0 and B.find_leaks(d.limit(0), bench).count() == 0


@pytest.mark.parametrize("lead", ["Intro. ", "so it says ", ""])
def test_verbatim_items_of_numbers_and_names(spark, lead):
    items = [
        "In 1998 John Smith and Mary Jones ran 5 km in 20 minutes; Bob Brown ran 10 km in 45 minutes.", "Compute 3, 7, 11, 15, 19, 23. What comes next?", "What is 12 + 15 x 4 - 7?",
        "Tiny item", "Sort 9 8 7 6 5 4 3", "1 22 333 4444 55555 666666 7777777",
    ]
    rng = random.Random(12)
    rows = [(i, prose(rng, 30) + ". " + lead + t + " " + prose(rng, 30)) for i, t in enumerate(items)]
    rows += [(10, "x. In 2001 Anna Weber and Paul Meyer ran 7 km in 31 minutes; Tom Brandt ran 12 km in 52 minutes."), (11, "x 2 4 6 8 10 12 14 16 18 20 22 24 y"), (12, prose(rng, 300))]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in B.find_leaks(docs(spark, rows), bench).collect()}
    assert set(got) == {(i, i) for i in range(len(items))} | {(10, 0)}, got
    assert all(got[i, i]["coverage"] == 1 and got[i, i]["changed_slots"] == 0 for i in range(len(items))) and got[10, 0]["changed_slots"] > 0


def test_one_template_stands_for_many_items(spark):
    names = [a + b for a in ("An", "Ber", "Cor", "Do") for b in ("na", "ta", "sa", "lly", "ri")]
    ask = lambda i, n: f"A shop where {n} works sells {i} red lamps and {i} blue lamps for {2 * i + 1} dollars each, so what does it earn?"
    items = [(i, ask(i, names[i % 20])) for i in range(3000)]
    d = docs(spark, [(1, "so " + ask(77, names[17]) + " yes"), (2, ask(5000, "Zoe")), (2, ask(5000, "Zoe")), (None, ask(9, names[9])), (3, ask(7, "Zoe").replace("7 blue", "8 blue"))])
    got = B.find_leaks(d, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["item_id"], r["changed_slots"] > 0) for r in got) == [("1", 77, False), ("2", 0, True), ("2", 0, True), ("None", 9, False)]
    assert all(r["template_items"] == 3000 for r in got)


def test_leaks_match_brute_force(spark):
    rng = random.Random(22)
    name = lambda: rng.choice(["Ann", "Bob", "Cleo", "Dan"])
    word = lambda: rng.choice([f"w{rng.randrange(60)}", f"w{rng.randrange(60)}", str(rng.randrange(30)), name()])
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 5, 6, 9, 20, 40])))) for i in range(40)] + [(40, None), (41, "..."), (42, "12")]
    rows = []
    for i in range(120):
        words = [word() for _ in range(rng.randrange(60))]
        if i % 3:
            copy = rng.choice(items[:40])[1].split()
            for _ in range(rng.choice([0, 0, 1, 3])):
                copy[rng.randrange(len(copy))] = word()
            words[rng.randrange(len(words) + 1) : 0] = copy
        rows.append((i, " ".join(words)))
    want = {}
    for item, text in items:
        kinds, values = B.canonical(text)
        for exact, tokens, slots, windows in B.templates_of(kinds, values) if kinds else ():
            for doc, there in rows:
                k, v = B.canonical(there)
                seq = v if exact else k
                hits = [(p - a, a, n, [] if exact else [v[j] for j in range(p, p + n) if k[j][0] == "\x01"]) for a, n in windows for p in range(len(seq) - n + 1) if seq[p : p + n] == tokens[a : a + n]]
                if hits and (found := B.judge(hits, slots, values, 0.8, 12)):
                    want.setdefault(doc, {})[item] = (tuple(tokens), tuple(slots))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for r in B.find_leaks(docs(spark, rows), bench).collect():
        got.setdefault(r["doc_id"], set()).add(r["item_id"])
    assert set(got) == set(want) and all(got[d] <= set(want[d]) for d in got) and len(want) > 50
    # each template is there once, whichever of its items names it
    assert all({x for i in got[d] for x in [want[d][i]]} == set(want[d].values()) for d in got)
    left = B.drop_leaks(docs(spark, rows), bench)
    assert {r["doc_id"] for r in left.collect()} == {i for i, _ in rows} - set(want)


def test_ladder_covers():
    assert all(n / 2 <= B.ladder(n) <= n for n in range(1, 3000)) and len({B.ladder(n) for n in range(1, 3000)}) < 30


# URL filter
def test_rules_and_model(spark):
    urls = ["http://A.Example.com/en/7?x", "https://example.com/en/8", "http://x.net/de/1", "http://example.net/de/81", "ftp://a.org/es/", "http://a.org/fr/", "no scheme", None, "http://notexample.com/en/7", "http://com"]
    weights = U.train(U.labelled_table(spark))
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r["page_id"]: r for r in U.judge(pages, weights).collect()}
    assert [got[i]["rule"] for i in range(10)] == ["example.com/en/7", "com/en/", "net/de/", "example.net/de/8", "org/es/", None, None, None, "com/en/", None]
    assert [got[i]["verdict"] for i in range(5)] == ["allow", "block", "allow", "block", "block"]
    assert got[0]["host"] == "a.example.com" and got[7]["host"] == "" and got[9]["path"] == ""
    assert weights == U.train(U.labelled_table(spark)) and len(weights) == U.DIMENSIONS + 1
    fit = U.judge(U.labelled_table(spark).withColumnRenamed("label", "page_id"), weights, rules=[]).collect()
    assert sum((r["verdict"] == "block") == bool(r["page_id"]) for r in fit) >= 0.95 * len(fit)
    fresh = ["https://mega-casino.example.org/bonus", "https://spam-farm.example.net/fr/1", "https://library.example.com/books/9", "https://blog.example.net/2023/1"]
    verdicts = [r["verdict"] for r in U.judge(spark.createDataFrame(list(enumerate(fresh)), "page_id long, url string"), weights, rules=[]).orderBy("page_id").collect()]
    assert verdicts == ["block", "block", "allow", "allow"]
    with pytest.raises(ValueError):
        U.train(U.labelled_table(spark), max_rows=5)


def test_model_score_is_plain(spark):
    weights = [((i * 37) % 101 - 50) / 50 for i in range(U.DIMENSIONS + 1)]
    row = spark.createDataFrame([("a.b", "/x/y")], "h string, p string").select(U.features(F.col("h"), F.col("p")).alias("f"), U.score(F.col("h"), F.col("p"), weights).alias("s")).first()
    import math

    z = sum(weights[i] for i in row["f"]) / math.sqrt(len(row["f"])) + weights[-1]
    assert abs(row["s"] - 1 / (1 + math.exp(-z))) < 1e-12


def test_features_and_training_match_plain(spark):
    import math
    import struct

    import xxhash

    def plain_features(host, path):
        found = []
        for tag, text in ((1, f"^{host}$"), (2, f"^{path}$")):
            for n in (3, 4):
                for i in range(max(1, len(text) - n + 1)):
                    h = xxhash.xxh64_intdigest(text[i : i + n].encode(), xxhash.xxh64_intdigest(struct.pack("<i", tag), 42))
                    found.append((h - (1 << 64) if h >> 63 else h) % U.DIMENSIONS)
        return list(dict.fromkeys(found))

    def split(url):
        _, there, rest = (url or "").partition("://")
        host = re.match(r"[^/?#]*", rest)[0] if there else ""
        return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0] if there else ""

    urls = [u for u, _ in U.LABELLED_URLS] + ["http://X.Y/z?q#f", "a://b://c/d", "no", "", "é://ÀB.C/\U0001f600", "x://h#f/p", "s:///only/path"]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i long, u string").select("i", U.host_of(F.col("u")).alias("h"), U.path_of(F.col("u")).alias("p")).select("*", U.features(F.col("h"), F.col("p")).alias("f")).orderBy("i").collect()
    for r, u in zip(rows, urls, strict=True):
        assert (r["h"], r["p"]) == split(u) and r["f"] == plain_features(*split(u)), u
    key = lambda u: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest(u.encode(), 42))
    data = [(plain_features(*split(u)), float(y)) for u, y in sorted(U.LABELLED_URLS, key=lambda x: (key(x[0]), x[0]))]
    w = [0.0] * (U.DIMENSIONS + 1)
    for _ in range(30):
        for f, y in data:
            x = {i: 1 / math.sqrt(len(f)) for i in f} | {U.DIMENSIONS: 1.0}
            g = 0.5 * (y - 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items()))))
            w = [a * (1 - 0.5 * 1e-4) for a in w]
            for i, v in x.items():
                w[i] += g * v
    assert max(abs(a - b) for a, b in zip(w, U.train(U.labelled_table(spark)), strict=True)) < 1e-9


# substring dedup
def test_passages_and_paragraphs(spark):
    rng = random.Random(3)
    passage = prose(rng, 70, 5000)
    para = prose(rng, 60, 5000).split()
    near = list(para)
    near[30] = "changed"
    rows = [(i, prose(rng, 120, 5000) + "\n" + prose(rng, 40, 5000)) for i in range(20)]
    rows[4] = (4, prose(rng, 33, 5000) + " " + passage + " " + prose(rng, 20, 5000))
    rows[9] = (9, prose(rng, 51, 5000) + "\n" + passage.upper() + " " + prose(rng, 20, 5000))
    rows[6] = (6, prose(rng, 50, 5000) + "\n" + " ".join(para))
    rows[11] = (11, " ".join(near) + "\n" + prose(rng, 50, 5000))
    d = docs(spark, [(100 + (i or 0), t) for i, t in ODD if i != 4] + [(i, t) for i, t in rows] + [(None, rows[0][1])])
    got = {r["doc_id"]: r for r in D.find_repeats(d).collect()}
    assert set(got) == {9, 11} and got[9]["kept_in"] == [4] and got[11]["kept_in"] == [6]
    assert (got[11]["start_word"], got[11]["end_word"]) == (0, 60)
    assert got[9]["end_word"] - got[9]["start_word"] >= 50 and got[9]["start_word"] >= 51 and got[9]["end_word"] <= 121
    cut = {r["doc_id"]: r["text"] for r in D.remove_repeats(d).collect()}
    assert len(WORD.findall(cut[11])) == 50 and cut[4] == rows[4][1] and D.remove_repeats(d).count() == d.count()
    assert D.find_repeats(d.limit(0)).count() == 0


def test_passages_match_brute_force(spark):
    rng = random.Random(10)
    rows = [(i, prose(rng, 19, 10**6) + "\n" + "\n".join(prose(rng, 19, 10**6) for _ in range(8))) for i in range(150)]
    for n in (31, 32, 33, 36, 40, 51) * 12:
        # repeats of repeats too, so that what an anchor's first document holds is not what another needs
        source = rng.choice(rows)[1].split()
        a = rng.randrange(len(source) - n)
        i, old = rng.choice(rows)
        words = old.split()
        at = rng.randrange(len(words))
        words[at:at] = source[a : a + n]
        rows[i] = (i, "\n".join(" ".join(words[k : k + 19]) for k in range(0, len(words), 19)))
    rows += [(150, "same few " * 70), (151, "same few " * 50), (152, rows[3][1].replace(" ", "\n"))]
    first = {}
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 31):
            first.setdefault(tuple(w[k : k + 32]), i)
    want, keeps = set(), {}
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 31):
            if (keep := first[tuple(w[k : k + 32])]) < i:
                want |= {(i, k + j) for j in range(32)}
                keeps.setdefault(i, set()).add(keep)
    got = D.find_repeats(docs(spark, rows)).collect()
    assert {(r["doc_id"], k) for r in got for k in range(r["start_word"], r["end_word"])} == want and len(keeps) > 30
    assert {i: set().union(*(r["kept_in"] for r in got if r["doc_id"] == i)) for i in keeps} == keeps


def test_removals_match_brute_force(spark):
    rng = random.Random(4)
    base = [prose(rng, 80, 10**6).split() for _ in range(12)]
    rows = []
    for i in range(90):
        lines = []
        for _ in range(rng.choice([1, 2])):
            w = list(rng.choice(base)) if rng.random() < 0.7 else prose(rng, 80, 10**6).split()
            for _ in range(rng.choice([0, 1, 1, 2, 9])):
                w[rng.randrange(80)] = f"e{rng.randrange(10**6)}"
            lines.append(w)
        rows.append((i, lines))
    # paragraphs: similar ones are one group; all but those of the document with the smallest id go
    units = [(i, k, tuple(w)) for i, lines in rows for k, w in enumerate(lines)]
    sets = [{w[k : k + 5] for k in range(76)} for _, _, w in units]
    root = list(range(len(units)))
    for i, j in itertools.combinations(range(len(units)), 2):
        if root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    keep = {}
    for (i, _, _), r in zip(units, root, strict=True):
        keep[r] = min(keep.get(r, i), i)
    want = {(i, 80 * k + n) for (i, k, _), r in zip(units, root, strict=True) if keep[r] != i for n in range(80)}
    # passages: words of a window of 32 that a smaller id has
    first = {}
    for i, lines in rows:
        w = [x for line in lines for x in line]
        for k in range(len(w) - 31):
            first.setdefault(tuple(w[k : k + 32]), i)
    for i, lines in rows:
        w = [x for line in lines for x in line]
        want |= {(i, k + n) for k in range(len(w) - 31) if first[tuple(w[k : k + 32])] < i for n in range(32)}
    d = docs(spark, [(i, "\n".join(" ".join(w) for w in lines)) for i, lines in rows])
    got = {(r["doc_id"], k) for r in D.find_repeats(d).collect() for k in range(r["start_word"], r["end_word"])}
    assert got == want and len(want) > 2000 and len(set(root)) < len(root) - 20


# quality
def test_quality_odd_rows(spark):
    rep = "a b c d e f g h " * 3
    out = Y.judge(docs(spark, [*ODD, (7, rep), (8, prose(random.Random(5), 60))])).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == len(ODD) + 2 and by[1]["n_words"] == 0 and by[1]["base_failed"] and by[7]["n_repeat_words"] == 24 and by[7]["base_failed"] and by[8]["kept"]
    assert by[5]["n_repeat_words"] == 20000
    assert Y.judge(docs(spark, ODD).limit(0)).count() == 0


def test_frequent_lines_deplete(spark):
    rng = random.Random(6)
    common = prose(rng, 30)
    rows = [(i, common + "\n" + prose(rng, 25, 10**6)) for i in range(30)] + [(99, common + "\n" + "x"), (98, prose(rng, 40, 10**6))]
    kept = {r["doc_id"]: r["kept"] for r in Y.judge(docs(spark, rows)).collect()}
    assert not kept[99] and kept[98] and all(kept[i] for i in range(30))
    copies = [(i, common + "\nmore words here") for i in range(40)]
    assert all(r["kept"] for r in Y.judge(docs(spark, copies)).collect())


# mixing
def test_mix(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randrange(5, 60)), rng.choice(["a", "a", "a", "b", None])) for i in range(600)] + [(i, t, "b") for i, t in ODD if i != 5] + [(9000, " ", "no words"), (9001, "x", "\U0010ffffnull")]
    out = M.mix(docs(spark, rows), shards=4, shard_blocks=16).collect()
    again = M.mix(docs(spark, rows).repartition(7), shards=4, shard_blocks=16).collect()
    key = lambda r: (str(r["doc_id"]), r["key"], [tuple(x) for x in r["draws"]])
    assert sorted(map(key, out)) == sorted(map(key, again)) and len(out) == len(rows)
    total = sum(r["size"] for r in out)
    by = {}
    for r in out:
        assert len(r["draws"]) <= 3 and [x["pass"] for x in r["draws"]] == list(range(len(r["draws"]))) and all(0 <= x["shard"] < 4 for x in r["draws"])
        s = by.setdefault(r["source"], [0, 0, r["target"], r["source_size"]])
        s[0] += r["size"] * len(r["draws"])
        s[1] += r["size"]
    assert abs(sum(s[2] for s in by.values()) - total) < 1e-6 * total
    for taken, size, target, stated in by.values():
        assert size == stated and abs(taken - target) <= 30 and target <= 3 * size + 1e-9
    assert not next(r for r in out if r["doc_id"] == 9000)["draws"] and len(next(r for r in out if r["doc_id"] == 9001)["draws"]) == 3
    words = [sum(r["size"] for r in out for x in r["draws"] if x["shard"] == k) for k in range(4)]
    assert sum(words) == sum(s[0] for s in by.values()) and max(words) - min(words) < 0.05 * sum(words)
    assert M.mix(docs(spark, rows).limit(0)).count() == 0


def test_offsets_match_plain(spark):
    rng = random.Random(17)
    rows = [(i, prose(rng, rng.randrange(0, 9)), rng.choice(["a", "b", None])) for i in range(400)]
    rows += rows[:40]
    sized = M.sized(docs(spark, rows))
    want = {}
    for r in sorted(sized.collect(), key=lambda r: r["__key"]):
        want.setdefault(r["__source"], {}).setdefault(r["__key"], 0)
        want[r["__source"]][r["__key"]] += r["__size"]
    plain = {(s, k): (sum(list(of.values())[:i]), of[k]) for s, of in want.items() for i, k in enumerate(of)}
    assert {(r["__source"], r["__key"]): (r["__first"], r["__n"]) for r in M.offsets(sized).collect()} == plain


def test_shards_mix_every_source(spark):
    rng = random.Random(18)
    rows = [(i, prose(rng, 20), f"s{min(9, i % 30)}") for i in range(6000)]
    d = [(r["source"], x["pass"], x["shard"], x["position"], r["key"]) for r in M.mix(docs(spark, rows), shards=8).select("source", "key", "draws").collect() for x in r["draws"]]
    # a document is once in a pass, so shards are disjoint within it; the order within a shard is another one in each pass
    assert len({(p, k) for _, p, _, _, k in d}) == len(d) and len({x[3] for x in d}) == len(d)
    for name in {x[0] for x in d}:
        n = [sum(x[0] == name and x[2] == k for x in d) for k in range(8)]
        share = sum(n) / len(d)
        # a shard holds 256 blocks; the spread of a source's blocks among them is hypergeometric
        sd = (256 * share * (1 - share) * (7 / 8)) ** 0.5
        assert max(abs(v - sum(n) / 8) for v in n) <= 4.5 * sd * len(d) / 2048 + 3
    per = [sum(x[2] == k for x in d) for k in range(8)]
    assert max(per) - min(per) <= 0.03 * len(d) / 8 + 12
    first = [x[4] for x in sorted((x for x in d if x[2] == 0), key=lambda x: x[3])]
    assert first != sorted(first)


def test_split_tree_keeps_quotas(spark):
    q = [("a", 1000), ("b", 7), (None, 0), ("c", 333)]
    cuts = {r["__source"]: r["__cut"] for r in M.split_tree(spark.createDataFrame(q, "__source string, __quota long"), 8).collect()}
    assert {k: v[-1] for k, v in cuts.items()} == dict(q) and all(v == sorted(v) and len(v) == 8 for v in cuts.values())
    sizes = [sum(v[i] - (v[i - 1] if i else 0) for v in cuts.values()) for i in range(8)]
    assert max(sizes) - min(sizes) <= 3 and sum(sizes) == 1340


def test_hypergeometric_distribution(spark):
    from math import comb

    good, bad, n = 12, 20, 9
    us = [(i + 0.5) / 4000 for i in range(4000)]
    df = spark.createDataFrame([(u,) for u in us], "u double").select(M._hypergeometric(F.col("u"), F.lit(good).cast("long"), F.lit(bad).cast("long"), F.lit(n).cast("long")).alias("x")).groupBy("x").count()
    got = {r["x"]: r["count"] / 4000 for r in df.collect()}
    for k in range(n + 1):
        assert abs(got.get(k, 0) - comb(good, k) * comb(bad, n - k) / comb(good + bad, n)) < 1e-3


# token counts
def test_counts_and_cache(spark, tmp_path):
    tokenizers = pytest.importorskip("public_tokenizers")
    path = str(tokenizers.path("piece_bpe_32k.model"))
    cache = f"file://{tmp_path}/cache"
    d = docs(spark, [*ODD, (9, "<s> special </s>")])
    got = {(r["doc_id"], r["n_bytes"]): r for r in N.count_tokens(d, lambda: path, cache).collect()}
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for i, t in [*ODD, (9, "<s> special </s>")]:
        r = got[i, len((t or "").encode())]
        assert r["n_tokens"] == len(sp.encode(t or "")) and r["over_limit"] == (r["n_tokens"] > 4096)
    n = spark.read.parquet(cache).count()
    assert N.count_tokens(d, lambda: path, cache).count() == len(ODD) + 1
    assert spark.read.parquet(cache).count() == n == len({t or "" for _, t in ODD}) + 1
    assert N.count_tokens(d.limit(0), lambda: path).count() == 0
    # a filled cache is used: what it says is what comes out; and only the rest is encoded, on either way to it
    for sent in (0, 1000):
        other = f"file://{tmp_path}/other{sent}"
        first = N.count_tokens(d.where("doc_id < 5"), lambda: path, other, sent_rows=sent).count()
        planted = spark.read.parquet(other).where("n_tokens = 1").select("content", F.lit(77).cast("long").alias("n_tokens"), "tokenizer")
        planted.write.partitionBy("tokenizer").mode("append").parquet(other)
        whole = {(r["doc_id"], r["n_bytes"]): r["n_tokens"] for r in N.count_tokens(d, lambda: path, other, sent_rows=sent).collect()}
        assert first == 5 and whole[4, 1] == 77 and {k: v for k, v in whole.items() if k[0] != 4} == {k: r["n_tokens"] for k, r in got.items() if k[0] != 4}


# SimHash
def reference_fingerprint(text):
    import xxhash

    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum((2 * sum(h >> b & 1 for h in hs) > len(hs)) << b for b in range(64))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aBÉ \n\t\x1c İz", max_size=60))
def test_fingerprint(text):
    assert H.fingerprint_of(text) == reference_fingerprint(text)


def test_block_masks_keep_every_pair():
    rng = random.Random(8)
    for n in (10, 10**8, 10**10):
        masks = H.block_masks(n)
        for _ in range(200):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), 3):
                y ^= 1 << b
            assert any(x & m == y & m for m in masks)


@pytest.mark.parametrize("small", [2, 48])
def test_links_match_brute_force(spark, small):
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(100)}
    base = rng.getrandbits(64)
    weak = rng.sample(range(64), 9)
    for _ in range(150):
        fps.add(base ^ sum(1 << b for b in weak if rng.random() < 0.3))
    fps = sorted(fps)
    root = {x: x for x in fps}
    for x, y in itertools.combinations(fps, 2):
        if (x ^ y).bit_count() <= 3 and root[x] != root[y]:
            a, b = root[x], root[y]
            root = {k: (a if r == b else r) for k, r in root.items()}
    df = spark.createDataFrame([(H._signed(x),) for x in fps], "fp long")
    found = {r["node"]: r["root"] for r in K.components(H.links(df, small)).collect()}
    group = lambda of: sorted(sorted(g) for g in ({x for x in fps if of(x) == r} for r in {of(x) for x in fps}))
    assert group(lambda x: root[x]) == group(lambda x: found.get(H._signed(x), H._signed(x)))


def test_near_duplicates_odd_rows(spark):
    out = H.near_duplicates(docs(spark, [*ODD, (7, None)])).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == len(ODD) + 1 and by[7]["component_id"] == 1 == by[2]["component_id"] and by[1]["fp"] == 0 and by[None]["component_id"] is None
    assert H.near_duplicates(docs(spark, ODD).limit(0)).count() == 0


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components(spark, edges):
    root = {i: i for i in range(26)}
    for u, v in edges:
        a, b = root[u], root[v]
        root = {k: (min(a, b) if r in (a, b) else r) for k, r in root.items()}
    got = {r["node"]: r["root"] for r in K.components(spark.createDataFrame([*edges, (None, 1)], "u long, v long")).collect()}
    assert {i: got.get(i, i) for i in root} == root


# licenses
def test_licenses(spark):
    apache, gpl2 = L.TEMPLATES[0][2], "This work is licensed under the GNU General Public License, version 2."
    rows = [(1, "text before\n" + apache + "\nafter"), (2, gpl2), (3, "x " * 3000 + " Released under the MIT License. " + "y " * 3000), (4, "my driver license was lost"), (5, "ALL RIGHTS RESERVED."), (6, apache + "\n" + apache)]
    got = sorted((r["doc_id"], r["license"]) for r in L.scan(docs(spark, rows + [(9, None), (8, "")])).collect())
    assert [(1, "Apache-2.0")] == [x for x in got if x[0] == 1] and (5, "All-Rights-Reserved") in got and (3, "MIT") in got
    assert not [x for x in got if x[0] in (4, 8, 9)] and len([x for x in got if x[0] == 6]) == 2 and ("GPL-3.0" not in [x[1] for x in got if x[0] == 2])
    one = L.scan(docs(spark, rows)).where("doc_id = 1").first()
    assert rows[0][1][one["start"] : one["end"]] == apache and one["differences"] == []
    assert L.scan(docs(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("around", [12, 60, 600])
def test_license_inside_prose(around):
    scanner = L.Scanner()
    for k, (name, _, notice) in enumerate(L.TEMPLATES):
        rng = random.Random(k)
        text = prose(rng, around) + " " + notice + " " + prose(rng, around)
        got = list(scanner.scan(text))
        assert [x[0] for x in got] == [name] and text[got[0][1] : got[0][2]].rstrip("./") == notice.rstrip("./") and got[0][4:] == (1.0, [])


def test_licenses_wrapped_and_without_usual_words():
    import textwrap

    scanner = L.Scanner()
    for name, _, notice in L.TEMPLATES:
        for width in (30, 80):
            text = "\n".join(" * " + line for line in textwrap.wrap(notice, width))
            assert [x[0] for x in scanner.scan("code here\n" + text + "\nmore code")] == [name]


def test_scan_matches_brute_force():
    import math

    rng = random.Random(23)
    scanner = L.Scanner()

    def plain(text):
        """Every template at every word, and what does not overlap a better one."""
        spans = [(m[0].lower(), *m.span()) for m in L._WORD.finditer(text)]
        words = [s[0] for s in spans]
        found = set()
        for k, (_, keys, _) in enumerate(L.TEMPLATES):
            size = len(scanner.words[k])
            most = max(1, 0.4 * size)
            slack = math.ceil(most)
            for begin in range(-slack, len(words)):
                there = words[max(0, begin - slack) : max(0, begin + size + slack)]
                if not set(keys.split()) <= set(there) or not (fit := scanner.align(there, k)):
                    continue
                first, last, n, diff = fit
                if n >= 0.8 * size and len(diff) <= most and not {d[1:] for d in diff if d[0] == "-"} & set(keys.split()):
                    a = max(0, begin - slack)
                    gain = scanner.gain(text[spans[a + first][1] : L._CLOSING.match(text, spans[a + last - 1][2]).end()], k)
                    if gain >= 0.15:
                        found.add((len(diff) - n, -n, -gain, k, a + first, a + last))
        stay = []
        for x in sorted(found):
            if all(x[5] <= y[4] or y[5] <= x[4] for y in stay):
                stay.append(x)
        return [(L.TEMPLATES[x[3]][0], spans[x[4]][1]) for x in sorted(stay, key=lambda x: x[4])]

    short = [t for t in L.TEMPLATES if len(t[2]) < 300]
    for _ in range(25):
        parts = []
        for _ in range(3):
            notice = rng.choice(short)[2].split()
            for _ in range(rng.choice([0, 0, 1, 3])):
                at = rng.randrange(len(notice))
                notice[at : at + rng.choice([0, 1])] = [rng.choice(["edited", "license", "the", "2.0"])]
            parts += [prose(rng, rng.randrange(0, 12)), " ".join(notice)]
        text = " ".join(parts)
        assert [(x[0], x[1]) for x in scanner.scan(text)] == plain(text), text


def test_texts_that_share_wording_are_told_apart():
    scanner = L.Scanner()
    whole = {(n, k): t for n, k, t in L.TEMPLATES}
    two, three = (next(t for (n, _), t in whole.items() if n == x) for x in ("BSD-2-Clause", "BSD-3-Clause"))
    assert [x[0] for x in scanner.scan("a\n" + two + "\nb")] == ["BSD-2-Clause"] and [x[0] for x in scanner.scan(three)] == ["BSD-3-Clause"]
    assert [x[0] for x in scanner.scan(three.replace("the copyright holder nor", "Some Company nor"))] == ["BSD-3-Clause"]
    later = next(t for (n, _), t in whole.items() if n == "GPL-3.0-or-later")
    assert [x[0] for x in scanner.scan(later)] == ["GPL-3.0-or-later"] and [x[0] for x in scanner.scan(later.replace("3", "4"))] == []


def test_bytes_saved_choose_between_overlapping_notices():
    """By words alone the second template would win: all of its words are there, of the first one's one is another."""
    long = "permission internationalization redistribution acknowledgement notwithstanding licensing ok"
    templates = [("Long", "permission", long), ("Short", "f", "ok a b c d e f")]
    text = long.replace("licensing", "changed") + " a b c d e f"
    (one,) = L.Scanner(templates).ranked(text)
    assert one[0] == "Long" and one[5] == ["-licensing", "+changed"] and one[6] == 1
    assert [x[0] for x in L.Scanner(templates[1:]).scan(text)] == ["Short"]
    ranks = L.Scanner().ranking("x y z " + L.TEMPLATES[5][2] + " x y z")
    assert ranks[0][1] == 5 and [x[0] for x in ranks] == sorted((x[0] for x in ranks), reverse=True) and len(ranks) == len(L.TEMPLATES)


def test_licenses_of_one_line():
    scanner = L.Scanner()
    text = "Licensed under the Apache License, Version 2.0. Released under the MIT License. Licensed under CC BY-SA 4.0. All rights reserved."
    got = list(scanner.scan(text))
    assert [x[0] for x in got] == ["Apache-2.0", "MIT", "CC-BY-SA-4.0", "All-Rights-Reserved"]
    assert all(x[2] <= y[1] for x, y in itertools.pairwise(got))


def test_digests_are_hex(spark):
    from strandline.llm.catalog import queries

    out = queries()["op1_chat_format"](spark, "/root/testdata/sf0.001").where("conv_id = -1").first()
    t = "</s>[INST] ok [/INST]"
    assert out["turns_sha256"] == hashlib.sha256(f"user\n{t}\nassistant\n{t}\n".encode()).hexdigest() and out["loss_chars"] == len(t)


def test_quality_matches_its_sql_where_lines_are_removed(spark, tmp_path):
    """Boilerplate, in tables that the query and its SQL both read."""
    import duckdb

    from strandline.llm.catalog import oracle_sql, queries

    rng = random.Random(12)
    rows = []
    for i in range(600):
        lines = [prose(rng, rng.randrange(3, 14), 4000) for _ in range(rng.randrange(1, 6))]
        if i % 4 == 0:
            lines.insert(rng.randrange(len(lines) + 1), "Share  this PAGE with friends" if i % 8 else "share this page with\tfriends")
        if i % 5 == 0:
            lines = ["all rights to the whole of this page are held by its host and by nobody else at all today"] + [prose(rng, 4, 4000)]
        rows.append((i, "\n".join(lines) if i % 97 else None, "en", ["a", "b", None][i % 3], 0))
    rows += [(1000 + i, rows[0][1], "en", "b", 0) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = queries()["op6_quality"](spark, f"file://{tmp_path}").toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(oracle_sql()["op6_quality"]).fetchdf()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and sorted(got[cols].astype(str).itertuples(index=False, name=None)) == sorted(want[cols].astype(str).itertuples(index=False, name=None))
    assert (got.removed_words > 0).sum() > 150 and ((got.removed_words > 0) & got.kept).any() and (~got.kept & ~got.base_failed).any()


def test_queries_match_their_sql(spark):
    import glob
    import os

    import duckdb

    from strandline.llm.catalog import oracle_sql, queries

    con = duckdb.connect()
    for p in glob.glob("/root/testdata/sf0.001/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    assert {"op1_chat_format", "op6_quality", "op7_mixing"} <= set(oracle_sql())
    for name, sql in oracle_sql().items():
        want, got = con.execute(sql).fetchdf(), queries()[name](spark, "/root/testdata/sf0.001").toPandas()
        cols = sorted(want.columns)
        value = lambda x: f"{x:.7g}" if isinstance(x, float) else str(x)
        rows = lambda df: sorted(tuple(map(value, r)) for r in df[cols].itertuples(index=False))  # noqa: E731, B023
        assert sorted(got.columns) == cols and rows(got) == rows(want), name
