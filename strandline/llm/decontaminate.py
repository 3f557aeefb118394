"""Benchmark decontamination by template canonicalisation.

Texts become sequences of tokens in which numbers, units after numbers and names
(capitalised words inside a sentence) are typed placeholders.  Items with the same
tokens, and the same slots that repeat one another, are one *template*, however many
there are.  Windows of ``WINDOW`` tokens of the templates are a table of hashes, and so
are those of the texts; they meet in a hash join.  For a template that a text hits, the
hits that line up are gathered; it is found if they cover at least ``coverage`` of its
tokens and its slots are consistent: where the item repeats a number, name or unit,
the text must repeat what stands in its place (but for a fifth, or in a copy that has
at most a fifth of its values changed).  The item named is the one with the
text's values in its slots; without such a one it is the template's first, and the
text a re-parameterised version of it.

Windows without ``MIN_PLAIN`` plain words would meet everywhere.  So an item that the
others do not cover, or that is no longer than a window, is also a template of its own
exact words, and has longer windows with plain words enough: one from its start and
one to its end, of the next lower size of a fixed ladder, so that few sizes occur.

Only texts' windows that pass a filter enter the join: a bit map of ``FILTER_BITS`` bits
(8 MB, whatever the benchmark's size) in which every window of the benchmark has set its bit.
Texts are read whole in Arrow batches; equal texts are joined and judged once.  A text is
named by a 64-bit hash.

Defined results: null or empty texts hit nothing; null or token-free items match
nothing; a null id stays null; ids must be integers; repeated rows give repeated
results; empty tables give none; extra columns pass through ``drop_leaks`` and are
ignored otherwise.  ``drop_leaks`` judges by the text alone, so rows with null or
repeated ids are treated like any other.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import fresh, stored

WINDOW = 5
MIN_PLAIN = 3
FILTER_BITS = 1 << 26
#: Placeholders, and words that are numbers or units.
NUMBER, NAME, UNIT = "\x01number", "\x01name", "\x01unit"
NUMBER_WORDS = frozenset("one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split())
UNITS = frozenset("m km cm mm kg g mg lb lbs oz s sec min h hr hrs day days week weeks month months year years hour hours minute minutes second seconds mile miles foot feet inch inches dollar dollars euro euros cent cents percent litre litres liter liters ml kmh mph".split())
_TOKEN = re.compile(r"[^\W\d_][^\W_]*|\d+(?:[.,]\d+)*|[.!?\n]")
_STOPS = frozenset(".!?\n")


def canonical(text: str | None) -> tuple[list[str], list[str]]:
    """Canonical tokens, and for each the token as it stands in the text (in lower case)."""
    kinds, values = [], []
    start, last = True, ""
    for t in _TOKEN.findall(text or ""):
        if t in _STOPS:
            start = True
            continue
        low = t.lower()
        if t[0].isdigit() or low in NUMBER_WORDS:
            kind = NUMBER
        elif last is NUMBER and low in UNITS:
            kind = UNIT
        elif not start and low != t and t[0] != low[0] and t[1:] == low[1:]:
            kind = NAME
        else:
            kind = low
        kinds.append(kind)
        values.append(low)
        start, last = False, kind
    return kinds, values


class _Hashes(dict):
    """Token → 64-bit hash, remembered; forgotten when large, so memory is bounded."""

    def __missing__(self, token):
        import xxhash

        if len(self) > 100_000:
            self.clear()
        h = self[token] = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"), 1)
        return h


class Windows:
    """Digests of the windows of a token sequence, of any size, from prefix sums."""

    _UP = 0x9E3779B97F4A7C15

    def __init__(self):
        self.memo, self.up, self.down = _Hashes(), None, None

    def _powers(self, n: int):
        import numpy as np

        if self.up is None or len(self.up) < n + 1:
            size = max(4096, 2 * n)
            with np.errstate(over="ignore"):
                self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, x, np.uint64)])) for x in (self._UP, pow(self._UP, -1, 1 << 64)))

    def sums(self, tokens: list[str]):
        import numpy as np

        self._powers(len(tokens))
        h = np.fromiter(map(self.memo.__getitem__, tokens), np.uint64, len(tokens))
        with np.errstate(over="ignore"):
            return np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(h * self.up[: len(h)])])

    def digests(self, sums, size: int, exact: bool):
        """One for each window of ``size`` tokens."""
        import numpy as np

        n = max(0, len(sums) - size)
        with np.errstate(over="ignore"):
            x = (sums[size : size + n] - sums[:n]) * self.down[:n] + np.uint64(2 * size + exact)
            x ^= x >> np.uint64(31)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            return x ^ (x >> np.uint64(29))


def ladder(n: int) -> int:
    """The largest size of a window for ``n`` tokens: every size up to 6, then in steps of a half or a third."""
    if n <= 6:
        return n
    size = 6
    while (step := size * 4 // 3 if size & (size - 1) else size * 3 // 2) <= n:
        size = step
    return size


def templates_of(kinds: list[str], values: list[str]):
    """(exact, tokens, slots, windows) of an item's templates.

    ``slots``: for each token -1, or the number of the slot; a slot that repeats an
    earlier one has its number.  ``windows``: (start, size) pairs.
    """
    n = len(kinds)
    plain = [0]
    for k in kinds:
        plain.append(plain[-1] + (k[0] != "\x01"))
    enough = lambda a, size: plain[a + size] - plain[a] >= min(MIN_PLAIN, size)
    size = min(WINDOW, n)
    usable = [(a, size) for a in range(n - size + 1) if enough(a, size)]
    # the first token's kind depends on what stands before it, so its window is not relied on
    covered = {a + j for a, _ in usable if a for j in range(size)}
    whole = n <= WINDOW or len(covered) < n - 1
    if whole and n > WINDOW:
        long = ladder(n - 1)
        usable += [(a, long) for a in {1, n - long} if enough(a, long)]
    numbers: dict = {}
    slots = [numbers.setdefault((k, v), len(numbers)) if k[0] == "\x01" else -1 for k, v in zip(kinds, values, strict=True)]
    if usable:
        yield False, kinds, slots, usable
    if whole:
        long = ladder(n)
        yield True, values, [-1] * n, [(a, long) for a in sorted({0, n - long})]


ITEMS = "item_id long, template long, exact boolean, slots array<int>, own array<string>, key string, windows array<struct<h:long,at:int,size:int>>"


def _items(batches):
    """(item id, text) → a row for each template of an item."""
    import pyarrow as pa
    import xxhash

    make = Windows()
    for b in batches:
        rows = []
        for item_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            kinds, values = canonical(text)
            for exact, tokens, slots, windows in templates_of(kinds, values) if kinds else ():
                name = xxhash.xxh64_intdigest("\n".join([str(exact), *map(str, slots), *tokens]).encode("utf-8", "surrogatepass"))
                sums = make.sums(tokens)
                found = [{"h": int(make.digests(sums, size, exact)[a]) - (1 << 63), "at": a, "size": size} for a, size in windows]
                own = [v if s >= 0 else None for s, v in zip(slots, values, strict=True)]
                rows.append((item_id, name - (1 << 63), exact, slots, own, _key(own), found))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
        kinds_ = (pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.string(), pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int32()), ("size", pa.int32())])))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds_, strict=True)], names=["item_id", "template", "exact", "slots", "own", "key", "windows"])


def _key(values) -> str:
    """The values of the slots, in order, as one string."""
    return "\x02".join(v for v in values if v is not None)


def _hits(sizes: list[tuple], places: list[int], bits: list[int]):
    """(document, text hash, text) → its windows that pass the filter; texts without any are left out."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        filter_ = np.zeros(FILTER_BITS // 64, np.uint64)
        filter_[np.array(places, np.int64)] = np.array(bits, np.int64).view(np.uint64)
        make = Windows()
        kinds_ = pa.list_(pa.struct([("h", pa.int64()), ("p", pa.int32()), ("v", pa.list_(pa.string()))]))
        for b in batches:
            docs, names, found = [], [], []
            for doc, name, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                kinds, values = canonical(text)
                out = []
                sums = {e: make.sums(values if e else kinds) for e in {e for _, e in sizes}} if kinds else {}
                for size, exact in sizes if kinds else ():
                    h = make.digests(sums[exact], size, exact)
                    at = h & np.uint64(FILTER_BITS - 1)
                    there = np.nonzero(filter_[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1))[0]
                    for p in there.tolist():
                        v = [] if exact else [values[j] for j in range(p, p + size) if kinds[j][0] == "\x01"]
                        out.append({"h": int(h[p]) - (1 << 63), "p": p, "v": v})
                if out:
                    docs.append(doc)
                    names.append(name)
                    found.append(out)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(names, pa.int64()), pa.array(found, kinds_)], names=["doc_id", "t", "hits"])

    return run


def judge(hits: list[tuple], slots: list[int], own: list, coverage: float, drift: int):
    """(coverage, slots, changed slots, values) if a text has the template, else None.

    ``hits``: (shift, start in the template, size, values in the slots); the best
    run of shifts that differ by ``drift`` at most counts.
    """
    hits = sorted(hits, key=lambda x: x[:3])
    best, first = None, 0
    while first < len(hits):
        last = first
        while last + 1 < len(hits) and hits[last + 1][0] - hits[first][0] <= drift:
            last += 1
        covered = {a + j for _, a, size, _ in hits[first : last + 1] for j in range(size)}
        if best is None or len(covered) > len(best[0]):
            best = (covered, hits[first : last + 1])
        shift = hits[first][0]
        while first < len(hits) and hits[first][0] == shift:
            first += 1
    share = len(best[0]) / len(slots)
    if share < coverage:
        return None
    values, seen = {}, {}
    for shift, a, size, there in best[1]:
        values |= dict(zip([(j, shift) for j in range(a, a + size) if slots[j] >= 0], there, strict=True))
    clashes = sum(seen.setdefault(slots[j], v) != v for (j, _), v in sorted(values.items()))
    changed = sum(v != own[j] for (j, _), v in values.items())
    # of the slots that repeat one another a fifth may clash, or of all a fifth be changed
    if clashes * 5 > len(values) - len(seen) and changed * 5 > len(values):
        return None
    line = {j: v for (j, _), v in sorted(values.items(), reverse=True)}
    return share, len(values), changed, [line.get(j) for j in range(len(slots))]


def _judged(coverage: float, drift: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for t, template, hits, slots, own in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                found = judge([(h["shift"], h["at"], h["size"], h["v"]) for h in hits], slots, own, coverage, drift)
                if found:
                    share, n, changed, values = found
                    whole = all(v is not None for v, s in zip(values, slots, strict=True) if s >= 0)
                    rows.append((t, template, share, n, changed, _key(values) if whole else None))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["t", "template", "coverage", "slots", "changed", "key"])

    return run


def _text_hash(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _found(docs: DataFrame, benchmark: DataFrame, coverage: float, drift: int, id_col: str, text_col: str, item_col: str, item_text_col: str):
    """(documents with hits: ``doc_id, t``; ``t, item_id, coverage, slots, changed_slots, template_items``)."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where(F.col("text").isNotNull())
    items = stored(items.mapInArrow(_items, ITEMS), "leak-items")
    windows = items.select("template", "exact", F.explode("windows").alias("w")).select("template", "exact", "w.*").distinct()
    windows = stored(windows, "leak-windows")
    first = F.min(F.struct("item_id", "own")).alias("first")
    templates = items.groupBy("template").agg(F.min("slots").alias("slots"), first, F.count(F.lit(1)).alias("template_items"))
    templates = stored(templates.select("template", "slots", "first.own", "first.item_id", "template_items"), "leak-templates")

    # hashes are kept with the sign bit flipped, which leaves the low bits as they are
    place = F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1))
    bits = windows.select(F.shiftright(place, 6).alias("i"), F.expr(f"shiftleft(1L, cast(h & {63} as int))").alias("b")).groupBy("i").agg(F.bit_or("b").alias("b")).collect()
    sizes = sorted((r["size"], r["exact"]) for r in windows.select("size", "exact").distinct().collect())
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), _text_hash(text_col).alias("t"), F.col(text_col).alias("text"))
    hits = texts.mapInArrow(_hits(sizes, [r["i"] for r in bits], [r["b"] for r in bits]), "doc_id long, t long, hits array<struct<h:long,p:int,v:array<string>>>")
    hits = stored(hits, "leak-hits")
    distinct = stored(hits.groupBy("t").agg(F.first("hits").alias("hits")), "leak-texts")

    each = distinct.select("t", F.explode("hits").alias("x")).select("t", "x.*")
    met = each.join(windows, "h").groupBy("t", "template").agg(F.collect_list(F.struct((F.col("p") - F.col("at")).alias("shift"), "at", "size", "v")).alias("hits"))
    judged = met.join(templates, "template").select("t", "template", "hits", "slots", "own").mapInArrow(_judged(coverage, drift), "t long, template long, coverage double, slots long, changed long, key string")
    judged = stored(judged, "leak-judged")
    same = items.groupBy("template", "key").agg(F.min("item_id").alias("same"))
    named = judged.join(same, ["template", "key"], "left").join(templates.select("template", "item_id", "template_items"), "template")
    found = named.groupBy("t", F.coalesce("same", "item_id").alias("item_id")).agg(
        F.max("coverage").alias("coverage"), F.max("slots").alias("slots"), F.min(F.when(F.col("same").isNotNull(), 0).otherwise(F.col("changed"))).cast("long").alias("changed_slots"), F.max("template_items").alias("template_items")
    )
    return hits.select("doc_id", "t"), stored(found, "leak-found")


def find_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.8, drift: int = 12, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, coverage, slots, changed_slots, template_items``: a row for each template found in a document.

    ``template_items``: how many items of the benchmark the template stands for.
    """
    ids, found = _found(docs, benchmark, coverage, drift, id_col, text_col, item_col, item_text_col)
    return ids.join(found, "t").select("doc_id", "item_id", "coverage", "slots", "changed_slots", "template_items")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.8, drift: int = 12, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows in whose text an item is found; all columns stay."""
    texts = docs.select(F.lit(None).cast("long").alias("__none"), F.col(text_col).alias("__text"))
    _, found = _found(texts, benchmark, coverage, drift, "__none", "__text", item_col, item_text_col)
    (t,) = fresh(docs, "__t")
    gone = stored(found.select(F.col("t").alias(t)).distinct(), "leak-gone")
    return docs.join(gone, _text_hash(text_col) == gone[t], "left_anti")
