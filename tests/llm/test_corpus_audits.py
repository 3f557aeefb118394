"""Packing, source divergence and manifests against plain versions, and their defined results for odd input."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.llm import divergence as V
from strandline.llm import manifest as M
from strandline.llm import packing as P
from strandline.llm.query_packing import _encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start long, term string, idx long, node string, grp string"


def docs(spark, rows):
    """Rows of (id, text, lang, source); further columns have names that operators use themselves."""
    return spark.createDataFrame([(*r[:4], len(r[1] or ""), 9, "x", 8, "y", "z") for r in rows], SCHEMA)


ODD = [(1, None, None, None), (2, "", "en", "a"), (3, " \n 12", "en", None), (4, "Straße a a", "en", "a"), (4, "Straße a a", "en", "a"), (None, "b c", "en", "b"), (5, "word " * 30000, "de", "b"), (6, "é\U0001f600 x<|endoftext|>y", "", "a"), (7, "ABC<|endof", None, "b"), (None, None, None, None)]


# packing
@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60), st.integers(50, 64))
def test_tree_finds_what_first_fit_finds(sizes, room):
    plain, free = [], []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        at = next((i for i, f in enumerate(free) if f >= sizes[k]), len(free))
        if at == len(free):
            plain.append([])
            free.append(room)
        plain[at].append(k)
        free[at] -= sizes[k]
    assert P.first_fit(sizes, room) == plain


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=40), st.sampled_from([1, 8, 64, 100]))
def test_layout_places_every_id_once(totals, room):
    pieces = P.layout(totals, room)
    got = sorted((d, i) for d, s, n, _, _ in pieces for i in range(s, s + n))
    assert got == [(d, i) for d, n in enumerate(totals) for i in range(n)] and all(p[2] > 0 for p in pieces)
    by = defaultdict(list)
    for _, _, n, k, offset in pieces:
        by[k].append((offset, n))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        total = sum(n for _, n in own)
        assert total == room or (total < room and total & (total - 1) == 0)


def test_ids_are_the_library_s():
    import public_tokenizers
    from tokenizers import Tokenizer

    exact, encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), _encoder()
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}1 {c}!{c}\n {c}" for c in every]
    texts = ["|".join(texts[k : k + 500]) for k in range(0, len(texts), 500)]
    texts += ["", " ", "  lead", "trail \n\n", "'ll 'LL don't", "x <|endoftext|>\n y<|endoftext|>", " " * 5000 + "x", "a" * 5000, "́" * 300, "3.14 " * 99]
    for text, want in zip(texts, exact.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert encode(text).tolist() == want.ids
    assert len(encode(" " * 1_500_000 + "x")) > 0


@pytest.mark.parametrize("group_docs", [3, 1000])
def test_pack_gives_back_every_document(spark, group_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(3)
    rows = [*ODD, *[(100 + i, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(900))), "en", "a") for i in range(60)]]
    out = P.pack(docs(spark, rows), _encoder, length=512, group_docs=group_docs).collect()
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((r[0], tuple([*exact.encode(r[1] or "", add_special_tokens=False).ids, 1])) for r in rows)
    pieces = defaultdict(list)
    for r in out:
        assert len(r["ids"]) == 4 * r["length"] and r["offset"] + r["length"] <= 512
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], tuple(np.frombuffer(r["ids"], "<u4").tolist())))
    for (doc, total), n in Counter((d, len(ids)) for d, ids in want.elements()).items():
        own = sorted(pieces[doc, total])
        assert sum(len(x) for _, x in own) == n * total
        for k, one in ((k, ids) for k, ids in want if (k, len(ids)) == (doc, total)):
            assert k == doc and all(one[s : s + len(x)] == x for s, x in own)
    sizes = Counter()
    for r in out:
        sizes[r["sequence_id"]] += r["length"]
    assert all(n == 512 or n & (n - 1) == 0 for n in sizes.values())
    if group_docs > len(rows):  # only a few shorter documents are cut
        assert sum(n > 1 for n in Counter(r["doc_id"] for r in out if r["doc_tokens"] <= 512 and r["doc_id"] not in (4, None)).values()) < 12
    again = P.pack(docs(spark, rows), _encoder, length=512, group_docs=group_docs).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    assert P.pack(docs(spark, rows).limit(0), _encoder).count() == 0


# divergence
def plain_audit(rows, least=3, ranks=200):
    named = [(r[2] or "", r[3] or "", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")) for r in rows]
    words = [(lang, source, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)) for lang, source, t in named]
    held, count = Counter(), Counter()
    for lang, source, ws in words:
        held.update((lang, w) for w in set(ws))
        count.update((lang, source, w) for w in ws)
    kept = defaultdict(list)
    for (lang, w), n in held.items():
        if n >= least:
            kept[lang].append(w)
    out = []
    for lang in {x[0] for x in named}:
        terms, sources = kept[lang], sorted({s for x, s, _ in named if x == lang})
        v = len(terms)

        def shares(n):
            total = sum(n.values())
            return {w: 1 + 10**9 * (n[w] + 1) // (total + v) for w in terms}

        own = {s: shares(Counter({w: count[lang, s, w] for w in terms})) for s in sources}
        whole = shares(Counter({w: sum(count[lang, s, w] for s in sources) for w in terms}))
        for s in sources:
            pairs = [(o, sum((own[s][w] - own[o][w]) ** 2 // own[o][w] for w in terms)) for o in sources if o != s]
            above = [(w, (own[s][w] - whole[w]) ** 2 // whole[w]) for w in terms if count[lang, s, w] and own[s][w] > whole[w]]
            for part, found in (("pair", pairs), ("term", above)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, *x, i) for i, x in enumerate(found, 1) if part == "pair" or i <= ranks]
    return sorted(out)


@pytest.mark.parametrize("heavy", [0.0, 0.25, 1.0])
def test_audit_matches_plain(spark, heavy):
    rng = random.Random(5)
    words = ["Zürich", "ABC", "x", "naïve", "the", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90))]
    rows = [*ODD, *[(i, " ".join(rng.choices(words, k=rng.randrange(40))) + ".9_" + rng.choice(words), rng.choice(["en", "de", None]), rng.choice("abcdefgh")) for i in range(300)]]
    assert sorted(map(tuple, V.audit(docs(spark, rows), heavy=heavy, term_ranks=9).collect())) == plain_audit(rows, ranks=9)


def test_audit_over_blocks_of_sources(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(["common", "other", *(f"r{chr(97 + k)}" for k in range(20))], weights=[20, 9, *[1] * 20], k=6)), "en", f"s{i % (V.BLOCK + 9)}") for i in range(3 * V.BLOCK)]
    assert sorted(map(tuple, V.audit(docs(spark, rows)).collect())) == plain_audit(rows)


def test_audit_of_little(spark):
    assert V.audit(docs(spark, ODD).limit(0)).count() == 0
    rows = [(1, "a", "en", "s"), (2, None, "en", "t"), (3, "b", "de", None)]
    assert sorted(map(tuple, V.audit(docs(spark, rows)).collect())) == plain_audit(rows) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]


def test_shares_of_large_counts(spark):
    d = spark.createDataFrame([(10**12, 10**12 + 10**6, 7), (0, 0, 3), (10**10, 10**13, 10**9)], "c long, n long, v long")
    got = [r["p"] for r in d.select(V.share(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()]
    assert got == [1 + 10**9 * (c + 1) // (n + v) for c, n, v in [(10**12, 10**12 + 10**6, 7), (0, 0, 3), (10**10, 10**13, 10**9)]]


# manifest
def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes, fanout):
    """The root, and for every node its siblings level by level and where it stands."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    paths = []
    for i in range(len(nodes)):
        path = []
        for level in levels[:-1]:
            run = level[i - i % fanout : i - i % fanout + fanout]
            path.append((i % fanout, run))
            i //= fanout
        paths.append(path)
    return levels[-1][0], paths


def plain_manifest(rows, fanout):
    def leaf_of(r, text):
        return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (r[0], r[3], r[2], len(r[1] or ""), text)])

    by = defaultdict(list)
    for r in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), r[1]) if r[1] is not None else None
        changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        by[r[2]].append((r[0], leaf_of(r, r[1]), leaf_of(r, low) if changed else leaf_of(r, r[1])))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for x in langs:
        by[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[x] = plain_tree([r[1] for r in by[x]], fanout)
    root, tops = plain_tree([trees[x][0] for x in langs], fanout)
    out = []
    for x, top in zip(langs, tops, strict=True):
        for (doc, leaf, tampered), path in zip(by[x], trees[x][1], strict=True):
            node = tampered
            for at, run in path + top:
                node = h(*run[:at], node, *run[at + 1 :])
            proof = "".join("".join(run[:at] + run[at + 1 :]) for at, run in path + top)
            out.append((doc, leaf, trees[x][0], root, proof, node))
    return sorted(out, key=str)


@pytest.mark.parametrize(("fanout", "depth", "n"), [(8, 3, 700), (2, 1, 40), (3, 2, 100), (8, 3, 0)])
def test_manifest_matches_plain(spark, fanout, depth, n):
    rng = random.Random(8)
    rows = [*ODD, *ODD[3:5], *[(rng.randrange(10**6), rng.choice(["Abc", "low", None]) if i % 9 else f"T{i}", rng.choice(["en", "en", "de", "fr"]), "s") for i in range(n)]]
    d = docs(spark, rows)
    digest = lambda text: M.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    low = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, digest(F.lower("text"))).otherwise(digest(F.col("text")))
    leaves = d.select("*", digest(F.col("text")).alias("leaf"), low.alias("root"))
    proved = M.manifest(leaves, "lang", "doc_id", "leaf", carry=["root"], fanout=fanout, depth=depth)
    assert proved.columns == ["doc_id", "leaf", "subroot", "root", "proof", "at", "size", "root"]
    proved = proved.toDF("doc_id", "leaf", "subroot", "root", "proof", "at", "size", "tampered")
    got = proved.select("doc_id", "leaf", "subroot", "root", "proof", M.fold(F.col("tampered"), F.col("proof"), F.col("at"), F.col("size")).alias("f")).collect()
    assert sorted(map(tuple, got), key=str) == plain_manifest(rows, fanout)


def test_manifest_of_little(spark):
    run = lambda rows: M.manifest(docs(spark, [(1, "a", "en", "s")]).limit(0).unionAll(docs(spark, rows)) if rows else docs(spark, ODD).limit(0), "lang", "doc_id", "text")
    assert run([]).count() == 0
    assert [tuple(r) for r in run([(1, "leaf", "en", "s")]).collect()] == [(1, "leaf", "leaf", "leaf", "", [], [])]
    two = sorted(map(tuple, run([(1, "x", "en", "s"), (2, "y", None, "s")]).collect()))
    assert two == [(1, "x", "x", h("y", "x"), "y", [1], [2]), (2, "y", "y", h("y", "x"), "x", [0], [2])]
