"""Substring dedup: paragraphs by MinHash banding, and passages inside paragraphs.

Words are compared in lower case.  Units of a document:

* paragraphs: its lines of at least ``MIN_PARAGRAPH`` words.  Equal ones are one
  distinct paragraph.  Distinct ones get MinHash signatures over five-word shingles
  in ``BANDS`` bands of ``ROWS``; at similarity 0.8 two collide with probability
  1 - (1 - 0.8^2)^5 = 0.994.  Colliding paragraphs are verified by exact Jaccard
  similarity of their shingles, and linked at 0.8 or more.
* windows: any ``MIN_PASSAGE`` words in a row.  A word is a passage's if one of the
  windows over it is also in a document with a smaller id; nothing shorter counts and
  nothing longer is missed.  So that not every window has to be compared, the one of
  its ``ANCHOR``-word digests that is smallest stands for it (equal windows have equal
  ones), and windows in a row with the same anchor are one stretch.  Stretches whose
  anchor is in one document alone are done with.  Equal stretches are decided as one;
  where an anchor has several stretches, one of each is decided window by window.

Linked paragraphs are clustered by connected components.  Of each component, and of
each passage, the occurrence in the document with the smallest id stays; what the
others lose is merged into spans.

Skew: equal paragraphs, stretches and windows are aggregated with map-side partials before
anything is joined.  A bucket of a band with more than ``CHUNK`` distinct paragraphs
is compared in pieces of that size, one task for each two pieces, and every task
returns no more links than it has paragraphs (a spanning forest of what it verified).

Defined results: null and empty texts have no units; rows with a null id neither lose
nor keep anything; rows of one id are one document, so what repeats among them stays;
repeated rows give each span once; an empty table gives no rows; extra columns pass
through ``remove_repeats`` and are ignored otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import fresh, stored
from strandline.llm.components import components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 5, 2
MIN_PARAGRAPH = 20
ANCHOR = 8
MIN_PASSAGE = 32
CHUNK = 256
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)

UNITS = "doc_id long, t long, segs array<struct<at:int,n:int,h:long,s:long>>, pars array<struct<at:int,n:int,d:long,b:array<long>>>"


class _Memo(dict):
    """Word → hash; forgotten when large."""

    def __missing__(self, word):
        import xxhash

        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def words_by_line(text: str | None) -> list[list[bytes]]:
    """Lower-case words of each line, as UTF-8."""
    raw = (text or "").lower().encode("utf-8", "surrogatepass")
    return [line.split() for line in raw.split(b"\n")]


def shingles(hashes):
    """64-bit hashes of the windows of ``SHINGLE`` word hashes (of all words, if there are fewer)."""
    import numpy as np

    size = min(SHINGLE, len(hashes))
    out = np.full(len(hashes) - size + 1, size, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            out = out * np.uint64(_P) + hashes[j : j + len(out)]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out


def _powers(n: int):
    import numpy as np

    with np.errstate(over="ignore"):
        up = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, _P, np.uint64)]))
        down = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, _P_INVERSE, np.uint64)]))
    return up, down


def _sums(h, powers):
    import numpy as np

    with np.errstate(over="ignore"):
        return np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(h * powers[0][: len(h)])])


def _digests(sums, a, b, powers):
    """Digests of the words from ``a`` to before ``b``."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = (sums[b] - sums[a]) * powers[1][a] + (b - a).astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def stretches(h, powers):
    """(start, number of windows, anchor, digest) arrays of the stretches of a document's word hashes."""
    import numpy as np

    if len(h) < MIN_PASSAGE:
        return np.array([], int), np.array([], int), np.array([], np.uint64), np.array([], np.uint64)
    sums = _sums(h, powers)
    at = np.arange(len(h) - ANCHOR + 1)
    least = _digests(sums, at, at + ANCHOR, powers)
    # the smallest digest that begins in a window: each step takes in as many more as it can
    width, whole = 1, MIN_PASSAGE - ANCHOR + 1
    while width < whole:
        step = min(width, whole - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    edges = np.concatenate([[0], np.nonzero(least[1:] != least[:-1])[0] + 1, [len(least)]])
    start, end = edges[:-1], edges[1:]
    return start, end - start, least[start], _digests(sums, start, end + MIN_PASSAGE - 1, powers)


def _lists(offsets, columns: dict):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(list(columns.values()), list(columns)))


def _units(batches):
    import numpy as np
    import pyarrow as pa
    import xxhash

    memo = _Memo()
    powers = _powers(1024)
    seeds = np.array([[xxhash.xxh64_intdigest(f"{k} {i}") | 1 for k in range(BANDS * ROWS)] for i in (0, 1)], np.uint64)
    for whole in batches:
        for k in range(0, whole.num_rows, 256):
            batch = whole.slice(k, 256)
            segs, pars, parts, edges = [], [], [], [0]
            seg_at, par_at = [0], [0]
            texts = batch.column(1).to_pylist()
            for text in texts:
                lines = words_by_line(text)
                h = np.array([memo[w] for line in lines for w in line], np.uint64)
                if len(h) >= len(powers[0]):
                    powers = _powers(2 * len(h))
                segs.append(stretches(h, powers))
                seg_at.append(seg_at[-1] + len(segs[-1][0]))
                at = 0
                for line in lines:
                    if len(line) >= MIN_PARAGRAPH:
                        own = h[at : at + len(line)]
                        parts.append(shingles(own))
                        edges.append(edges[-1] + len(parts[-1]))
                        pars.append((at, len(line), xxhash.xxh64_intdigest(own.tobytes())))
                    at += len(line)
                par_at.append(len(pars))
            bands = np.zeros((len(pars), BANDS), np.int64)
            if pars:
                every = np.concatenate(parts)
                with np.errstate(over="ignore"):
                    for i in range(BANDS * ROWS):
                        x = every * seeds[0, i] + seeds[1, i]
                        x ^= x >> np.uint64(32)
                        least = np.minimum.reduceat(x, edges[:-1])
                        bands[:, i // ROWS] = (bands[:, i // ROWS].view(np.uint64) * np.uint64(_P) + least).view(np.int64)
            cat = lambda i, kind: np.concatenate([s[i] for s in segs]).astype(kind) if segs else np.array([], kind)  # noqa: B023, E731
            seg = _lists(seg_at, {"at": pa.array(cat(0, np.int32)), "n": pa.array(cat(1, np.int32)), "h": pa.array(cat(2, np.uint64).view(np.int64)), "s": pa.array(cat(3, np.uint64).view(np.int64))})
            of = lambda i, kind: np.array([p[i] for p in pars], kind)  # noqa: B023, E731
            b = pa.ListArray.from_arrays(pa.array(np.arange(len(pars) + 1) * BANDS, pa.int32()), pa.array(bands.reshape(-1)))
            par = _lists(par_at, {"at": pa.array(of(0, np.int32)), "n": pa.array(of(1, np.int32)), "d": pa.array(of(2, np.uint64).view(np.int64)), "b": b})
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), seg, par], names=["doc_id", "t", "segs", "pars"])


def _linked(batches):
    """Pieces of a bucket (digests and shingle sets of two sides) → links that span what is similar."""
    import pyarrow as pa

    for b in batches:
        us, vs = [], []
        for rows in b.column(0).to_pylist():
            rows = sorted({r["d"]: r for r in rows}.values(), key=lambda r: r["d"])
            sets = [frozenset(r["s"]) for r in rows]
            parent = list(range(len(rows)))

            def find(x, parent=parent):
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for i in range(len(rows)):
                for j in range(i + 1, len(rows)):
                    a, c = len(sets[i]), len(sets[j])
                    if min(a, c) < SIMILARITY * max(a, c) or (x := find(i)) == (y := find(j)):
                        continue
                    both = len(sets[i] & sets[j])
                    if both >= SIMILARITY * (a + c - both):
                        parent[max(x, y)] = min(x, y)
                        us.append(rows[i]["d"])
                        vs.append(rows[j]["d"])
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


def _cut_out(batches):
    """(text, places of paragraphs) → digest and shingle hashes of each."""
    import numpy as np
    import pyarrow as pa

    memo = _Memo()
    for b in batches:
        ds, sets = [], []
        for text, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = [w for line in words_by_line(text) for w in line]
            for p in places:
                h = np.array([memo[w] for w in words[p["at"] : p["at"] + p["n"]]], np.uint64)
                ds.append(p["d"])
                sets.append(np.unique(shingles(h)).view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(ds, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["d", "s"])


def _paragraph_links(distinct: DataFrame, docs: DataFrame) -> DataFrame:
    """``d, b, place`` of distinct paragraphs → ``u, v``: digests of similar ones."""
    keyed = distinct.select("d", F.posexplode("b").alias("band", "key"))
    full = keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    members = stored(keyed.join(full, ["band", "key"]), "paragraph-members")
    wanted = members.select("d").distinct().join(distinct.select("d", "place"), "d")
    places = wanted.groupBy("place.doc_id", "place.t").agg(F.collect_list(F.struct(F.col("place.at").alias("at"), F.col("place.n").alias("n"), "d")).alias("places"))
    cut = docs.join(places, ["doc_id", "t"]).select("text", "places").mapInArrow(_cut_out, "d long, s array<long>")
    sets = stored(cut.dropDuplicates(["d"]), "paragraph-shingles")
    pieces = F.ceil(F.col("size") / CHUNK).cast("int")
    placed = members.select("*", pieces.alias("p"), F.pmod(F.xxhash64("d"), pieces).cast("int").alias("i"))
    # a member of piece i meets every piece j; both orders of (i, j) name the same task
    spread = placed.select("band", "key", "d", F.explode(F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda j: F.struct(F.least("i", j).alias("a"), F.greatest("i", j).alias("b")))).alias("task"))
    grouped = spread.join(sets, "d").groupBy("band", "key", "task").agg(F.collect_list(F.struct("d", "s")).alias("rows"))
    return grouped.select("rows").mapInArrow(_linked, "u long, v long")


def _windows(batches):
    """(document, text, places of stretches) → digest, stretch, offset and document of each window."""
    import numpy as np
    import pyarrow as pa

    memo = _Memo()
    powers = _powers(1024)
    for b in batches:
        for k in range(0, b.num_rows, 256):
            batch = b.slice(k, 256)
            ws, ss, offs, docs = [np.array([], np.int64)], [np.array([], np.int64)], [np.array([], np.int32)], [np.array([], np.int64)]
            for doc, text, places in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                h = np.array([memo[w] for line in words_by_line(text) for w in line], np.uint64)
                if len(h) >= len(powers[0]):
                    powers = _powers(2 * len(h))
                sums = _sums(h, powers)
                n = np.array([p["n"] for p in places])
                i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(np.array([p["at"] for p in places]), n) + i
                ws.append(_digests(sums, at, at + MIN_PASSAGE, powers).view(np.int64))
                ss.append(np.repeat(np.array([p["s"] for p in places], np.int64), n))
                offs.append(i.astype(np.int32))
                docs.append(np.full(len(i), doc, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ws, ss, offs, docs)], names=["w", "s", "i", "doc"])


def _lost_stretches(segs: DataFrame, docs: DataFrame) -> DataFrame:
    """``doc_id, t, at, n, keep, windows``: stretches that ``keep`` has whole, and their windows that a still earlier document has."""
    again = segs.groupBy("h").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).where(F.col("least") < F.col("last"))
    # stored, here and below: a join of plain scans can be split where a unit fills much of the input
    shared = stored(segs.join(stored(again.select("h"), "dedup-again"), "h"), "dedup-shared")
    distinct = stored(shared.groupBy("s").agg(F.min("h").alias("h"), F.min(F.struct("doc_id", "t", "at", "n")).alias("place")), "dedup-stretches")
    several = stored(distinct.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("h"), "dedup-several")
    places = distinct.join(several, "h").groupBy("place.doc_id", "place.t").agg(F.collect_list(F.struct(F.col("place.at").alias("at"), F.col("place.n").alias("n"), "s")).alias("places"))
    windows = stored(docs.join(places, ["doc_id", "t"]).select("doc_id", "text", "places").mapInArrow(_windows, "w long, s long, i int, doc long"), "dedup-windows")
    first = stored(windows.groupBy("w").agg(F.min("doc").alias("keep"), F.max("doc").alias("last")).where("keep < last").select("w", "keep"), "dedup-first")
    decided = windows.join(first, "w").where(F.col("keep") < F.col("doc")).groupBy("s").agg(F.collect_list(F.struct("i", "keep")).alias("windows"))
    known = stored(distinct.select("s", F.col("place.doc_id").alias("keep")).join(decided, "s", "left"), "dedup-decided")
    lost = shared.join(known, "s").where((F.col("keep") < F.col("doc_id")) | F.col("windows").isNotNull())
    return lost.select("doc_id", "t", "at", "n", "keep", "windows")


def _spans(batches):
    """Repeated units of a document → merged spans of words."""
    import pyarrow as pa

    for b in batches:
        out = []
        for doc, t, segs, pars in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            found = [(p["at"], p["at"] + p["n"], {p["keep"]}) for p in pars]
            for s in segs:
                # windows that are listed have an earlier document than the stretch as a whole
                other = {w["i"]: w["keep"] for w in s["windows"] or ()}
                if s["keep"] < doc:
                    found.append((s["at"], s["at"] + s["n"] - 1 + MIN_PASSAGE, {*other.values(), *([s["keep"]] if len(other) < s["n"] else [])}))
                else:
                    found += [(s["at"] + i, s["at"] + i + MIN_PASSAGE, {keep}) for i, keep in other.items()]
            merged = []
            for a, e, keep in sorted(found, key=lambda x: x[:2]):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                    merged[-1][2] |= keep
                else:
                    merged.append([a, e, set(keep)])
            out += [(doc, t, a, e, sorted(keep)) for a, e, keep in merged]
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "t", "start_word", "end_word", "kept_in"])


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t"))


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, t, start_word, end_word, kept_in``: spans of words that repeat what documents ``kept_in`` keep.

    ``t`` is the hash of the row's text.
    """
    named = _named(docs, id_col, text_col)
    units = stored(named.mapInArrow(_units, UNITS), "dedup-units")

    seg, par = "struct<at:int,n:int,keep:bigint,windows:array<struct<i:int,keep:bigint>>>", "struct<at:int,n:int,keep:bigint>"
    segs = units.select("doc_id", "t", F.explode("segs").alias("s")).select("doc_id", "t", "s.*")
    lost_segs = _lost_stretches(segs, named).select("doc_id", "t", F.struct("at", "n", "keep", "windows").alias("s"), F.lit(None).cast(par).alias("p"))

    pars = units.select("doc_id", "t", F.explode("pars").alias("p")).select("doc_id", "t", "p.*")
    distinct = pars.groupBy("d").agg(F.min(F.struct("doc_id", "t", "at", "n")).alias("place"), F.min("b").alias("b"), F.max("doc_id").alias("last"))
    distinct = stored(distinct, "paragraphs")
    roots = components(_paragraph_links(distinct, named))
    grouped = distinct.join(roots, distinct["d"] == roots["node"], "left").select("d", F.col("place.doc_id").alias("first"), "last", F.coalesce("root", "d").alias("root"))
    least = grouped.groupBy("root").agg(F.min("first").alias("keep"), F.max("last").alias("most")).where(F.col("keep") < F.col("most"))
    kept = stored(grouped.join(least, "root").select("d", "keep"), "dedup-kept")
    lost_pars = pars.join(kept, "d").where(F.col("doc_id") != F.col("keep"))
    lost_pars = lost_pars.select("doc_id", "t", F.lit(None).cast(seg).alias("s"), F.struct("at", "n", "keep").alias("p"))

    lost = lost_segs.union(lost_pars).groupBy("doc_id", "t").agg(F.collect_set("s").alias("segs"), F.collect_set("p").alias("pars"))
    return lost.mapInArrow(_spans, "doc_id long, t long, start_word long, end_word long, kept_in array<long>")


def _without(at: int, drop_emptied: bool):
    def run(batches):
        import re

        import pyarrow as pa

        word = re.compile(r"[^\x20\x09-\x0D]+")
        for b in batches:
            texts, stay = [], []
            for text, spans in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                if spans:
                    places = [m.span() for m in word.finditer(text)]
                    for s in sorted(spans, key=lambda s: -s["start_word"]):
                        a, e = max(0, s["start_word"]), min(len(places), s["end_word"])
                        text = text[: places[a][0]] + text[places[e - 1][1] :].lstrip(" ")
                texts.append(text)
                stay.append(not (spans and drop_emptied) or bool(word.search(text)))
            cols = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:-1]).filter(pa.array(stay, pa.bool_()))

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = False) -> DataFrame:
    """``docs`` with the repeated spans cut out of the texts; all columns stay, and all rows.

    With ``drop_emptied``, rows that lose all their words go.
    """
    i, t, lost = fresh(docs, "__i", "__t", "__spans")
    spans = stored(find_repeats(docs.select(id_col, text_col), id_col, text_col), "dedup-spans")
    by_text = spans.groupBy(F.col("doc_id").alias(i), F.col("t").alias(t)).agg(F.collect_list(F.struct("start_word", "end_word")).alias(lost))
    by_text = stored(by_text, "dedup-lost")
    on = (docs[id_col] == by_text[i]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == by_text[t])
    joined = docs.join(by_text, on, "left").select(*[docs[f"`{c}`"] for c in docs.columns], lost)
    return joined.mapInArrow(_without(docs.columns.index(text_col), drop_emptied), docs.schema)
