"""Divergence between the sources of each language, with one half for heavy terms and one for light ones.

Terms are counted for each (language, source) in bounded dictionaries of the tasks that read the texts, so
a hot source crosses the network once for each task and term.  A language keeps the
terms that ``least_docs`` of its documents hold.  With N occurrences of kept terms in a group and
V kept terms, a term's share is ``p = 1 + floor(SCALE * (count + 1) / (N + V))`` (also for a count of 0),
and a pair of shares diverges by ``f = floor((p - q) ** 2 / q)``.  All of it is integer arithmetic.

The sum of f over all kept terms, for every ordered pair of a language's sources:

* heavy terms, which more than ``heavy`` of the language's sources have: dense tiles.  A tile is a slice
  of terms by two blocks of sources, a NumPy matrix of shares in which absent ones stand at the group's share
  of a count of 0; each row meets the whole matrix.
* light terms: no zero is ever laid out.  Where neither source has a term, f is that of the two zero
  shares.  For a light term of one source, f against the zero share of every other depends on
  its share alone, so a table of (source, share, terms) corrects all of them.  Only pairs of sources
  that both have a light term need more: one posting list after the other is paired with itself shifted
  by one, two, ... places, and slices of lists sum their corrections before they leave the task.

Both sums are whole numbers, added as they are.  A sum fits a long: it is below (10 ** 9 + V) squared.

Defined results: null text, language and source are empty strings; a group without terms still has shares
(of 0 in 0) where its language keeps terms, and pairs of value 0 where it keeps none; repeated rows
are documents of their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import stored

SCALE = 1_000_000_000
LEAST_DOCS = 3
TERM_RANKS = 200
#: Share of a language's sources above which a term is heavy.
HEAVY = 0.25
TILE_TERMS = 1024
BLOCK = 128
SLICE_ROWS = 100_000
PIECE = 1 << 20
ENTRIES = 300_000
#: Bytes that terms hold, with A to Z lower-cased, and blanks for all others.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _terms(text: str):
    """Lists of the terms of one text, a piece at a time."""
    data = text.encode("utf-8", "surrogatepass").translate(LETTERS)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _count(batches):
    """(lang, source, text) → lang, source, term, occurrences, documents; a null term names a group."""
    from collections import Counter, defaultdict

    import pyarrow as pa

    occurrences: dict = defaultdict(Counter)
    documents: dict = defaultdict(Counter)
    size = 0

    def flushed():
        lang, source, term, n, docs = [], [], [], [], []
        for group, own in occurrences.items():
            held = documents[group]
            lang += [group[0]] * (len(own) + 1)
            source += [group[1]] * (len(own) + 1)
            term += [None, *own]
            n += [0, *own.values()]
            docs += [0, *map(held.__getitem__, own)]
        occurrences.clear()
        documents.clear()
        terms = pa.array(term, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), terms, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])

    for b in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            group, seen = occurrences[lang, source], set()
            size -= len(group)
            for piece in _terms(text):
                group.update(piece)
                seen.update(piece)
            documents[lang, source].update(seen)
            size += len(group) + 1
            if size > ENTRIES:
                yield flushed()
                size = 0
    if occurrences:
        yield flushed()


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, term, n, docs``: occurrences in a group and its documents that hold the term; a null term for each group."""
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counted = named.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(SCALE * (count + 1) / (total + terms))``; in decimals, since ``SCALE`` times a count may not fit a long."""
    top = (count + 1).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", top, (total + terms).cast("decimal(20,0)")) + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def shares(counts: DataFrame, least_docs: int = LEAST_DOCS, heavy: float = HEAVY) -> tuple[DataFrame, DataFrame]:
    """Tables of groups and of cells, from what ``term_counts`` gives (stored).

    Groups: ``lang, source, sid`` (its number within the language), ``zero`` (the share of a count of 0; null
    where the language keeps no term), ``sources, terms, light, tiles, slices`` of the language.
    Cells: ``lang, source, sid, zero, term, p, q, heavy, tiles, slices, sources`` for each kept term that a group has.
    """
    named = counts.where(F.col("term").isNull()).select("lang", "source")
    terms = counts.where(F.col("term").isNotNull())
    kept = terms.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("held")).where(F.col("docs") >= least_docs)
    kept = stored(kept.join(named.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")), "lang").select("lang", "term", "total", (F.col("held") > heavy * F.col("sources")).alias("heavy"), "held"), "divergence-kept")
    cells = stored(terms.select("lang", "source", "term", "n").join(kept.select("lang", "term", "total", "heavy"), ["lang", "term"]), "divergence-cells")

    light = F.coalesce(F.count_if(~F.col("heavy")), F.lit(0))
    rows = F.coalesce(F.sum(F.when(~F.col("heavy"), F.col("held"))), F.lit(0))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("all"), light.alias("light"), F.ceil(F.count_if("heavy") / TILE_TERMS).alias("tiles"), F.ceil(rows / SLICE_ROWS).alias("slices"))
    sizes = cells.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    own = Window.partitionBy("lang")
    groups = named.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", (F.row_number().over(own.orderBy("source")) - 1).cast("long").alias("sid"), F.count(F.lit(1)).over(own).alias("sources"),
        F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("terms", F.lit(0)).alias("terms"), "all", F.coalesce("light", F.lit(0)).alias("light"), F.coalesce("tiles", F.lit(0)).alias("tiles"), "slices",
    )
    zero = F.when(F.col("terms") > 0, share(F.lit(0), F.col("size"), F.col("terms"))).alias("zero")
    groups = stored(groups.select("*", zero), "divergence-groups")
    p, q = share(F.col("n"), F.col("size"), F.col("terms")), share(F.col("total"), F.col("all"), F.col("terms"))
    valued = cells.join(groups, ["lang", "source"]).select("lang", "source", "sid", "zero", "term", p.alias("p"), q.alias("q"), "heavy", "tiles", "slices", "sources")
    return groups, stored(valued, "divergence-shares")


def _dense(table):
    """A tile: every ordered pair of a source of the lower block and one of the upper, over the tile's terms."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    sid, p, zero = (table.column(c).to_numpy() for c in ("sid", "p", "zero"))
    lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
    names, row = np.unique(sid, return_inverse=True)
    base = np.zeros(len(names), np.int64)
    base[row] = zero
    term = table.column("term").combine_chunks().dictionary_encode()
    there = pc.is_valid(term).to_numpy(zero_copy_only=False)
    matrix = np.repeat(base[:, None], len(term.dictionary), axis=1)
    matrix[row[there], term.indices.drop_null().to_numpy()] = p[there]
    upper = names // BLOCK == hi
    below = matrix[upper]
    out = []
    for k in np.flatnonzero(names // BLOCK == lo):
        square = (matrix[k] - below) ** 2
        out.append((np.full(upper.sum(), names[k]), names[upper], (square // below).sum(1)))
        if lo != hi:
            out.append((names[upper], np.full(upper.sum(), names[k]), (square // matrix[k]).sum(1)))
    a, b, v = (np.concatenate(x) for x in zip(*out, strict=True))
    other = a != b
    return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * int(other.sum()), pa.string()), "a": a[other], "b": b[other], "v": v[other]})


def _sparse(table):
    """A slice of posting lists: for each two sources of a light term, what both having it adds to their sums."""
    import numpy as np
    import pyarrow as pa

    order = table.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
    by = np.argsort(order, kind="stable")
    term, sid, p, zero = (x[by] for x in (order, *(table.column(c).to_numpy() for c in ("sid", "p", "zero"))))
    f = lambda x, y: (x - y) ** 2 // y
    width = int(sid.max()) + 1
    sums: dict[int, int] = {}
    for d in range(1, len(term)):
        i = np.flatnonzero(term[d:] == term[:-d])
        if not len(i):
            break
        for a, b in ((i, i + d), (i + d, i)):
            more = f(p[a], p[b]) - f(p[a], zero[b]) - f(zero[a], p[b]) + f(zero[a], zero[b])
            pair, at = np.unique(sid[a] * width + sid[b], return_inverse=True)
            total = np.zeros(len(pair), np.int64)
            np.add.at(total, at, more)
            for x, v in zip(pair.tolist(), total.tolist(), strict=True):
                sums[x] = sums.get(x, 0) + v
    pairs = np.fromiter(sums, np.int64, len(sums))
    lang = pa.array([table.column("lang")[0].as_py()] * len(pairs), pa.string())
    return pa.table({"lang": lang, "a": pairs // width, "b": pairs % width, "v": np.fromiter(sums.values(), np.int64, len(sums))})


SUMS = "lang string, a long, b long, v long"


def _blocks(of: DataFrame, *keep) -> DataFrame:
    """Rows of sources, once for each other block of sources that theirs meets: ``lo`` and ``hi``."""
    own, most = F.floor(F.col("sid") / BLOCK), F.floor((F.col("sources") - 1) / BLOCK)
    return of.select(*keep, own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), most)).alias("other")).select("*", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))


def pair_sums(groups: DataFrame, cells: DataFrame) -> DataFrame:
    """``lang, source, item, value`` for every ordered pair of a language's sources, from what ``shares`` gives."""
    # dense tiles; the zero shares of all sources go to each tile as rows without a term
    tile = F.pmod(F.xxhash64("term"), F.col("tiles")).alias("tile")
    dense = cells.where("heavy").select("lang", "sid", "sources", tile, "term", "p", "zero")
    zeros = groups.where(F.col("tiles") > 0).select("lang", "sid", "sources", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile"), F.lit(None).cast("string").alias("term"), F.col("zero").alias("p"), "zero")
    tiled = _blocks(dense.unionByName(zeros), "lang", "sid", "tile", "term", "p", "zero")
    heavy = tiled.select("lang", "tile", "lo", "hi", "sid", "term", "p", "zero").groupBy("lang", "tile", "lo", "hi").applyInArrow(_dense, SUMS)

    rare = cells.where(~F.col("heavy"))
    slices = rare.select("lang", F.pmod(F.xxhash64("term"), F.col("slices")).alias("slice"), "sid", "term", "p", "zero")
    both = slices.groupBy("lang", "slice").applyInArrow(_sparse, SUMS)

    # one source has the term, the other does not: by the share alone, against each block of other sources
    held = rare.groupBy("lang", "sid", "sources", "p", "zero").agg(F.count(F.lit(1)).alias("m"))
    held = _blocks(held, "lang", "sid", "p", "zero", "m").select("lang", F.col("other").alias("block"), "sid", "p", F.col("zero").alias("za"), "m")
    others = groups.select("lang", F.floor(F.col("sid") / BLOCK).alias("block"), F.col("sid").alias("o"), F.col("zero").alias("zb"))
    met = held.join(others, ["lang", "block"]).where(F.col("sid") != F.col("o"))
    p, za, zb = F.col("p"), F.col("za"), F.col("zb")
    there = F.struct(F.col("sid").alias("a"), F.col("o").alias("b"), (F.col("m") * (divergence(p, zb) - divergence(za, zb))).alias("v"))
    back = F.struct(F.col("o").alias("a"), F.col("sid").alias("b"), (F.col("m") * (divergence(zb, p) - divergence(zb, za))).alias("v"))
    one = met.select("lang", F.explode(F.array(there, back)).alias("x")).select("lang", "x.*")

    sums = stored(heavy.unionByName(both).unionByName(one).groupBy("lang", "a", "b").agg(F.sum("v").alias("v")), "divergence-sums")
    pairs = groups.select("lang", "source", F.col("sid").alias("a"), F.col("zero").alias("za"), "light").join(groups.select("lang", F.col("source").alias("item"), F.col("sid").alias("b"), F.col("zero").alias("zb")), "lang").where(F.col("a") != F.col("b"))
    neither = F.coalesce(F.col("light") * divergence(za, zb), F.lit(0))
    return pairs.join(sums, ["lang", "a", "b"], "left").select("lang", "source", "item", (neither + F.coalesce("v", F.lit(0))).cast("long").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, term_ranks: int = TERM_RANKS, heavy: float = HEAVY, **columns) -> DataFrame:
    """``lang, source, part, item, value, rank``: ``pair`` rows for every other source, ``term`` rows for the terms that a group has most above its language."""
    groups, cells = shares(stored(term_counts(docs, **columns), "divergence-counts"), least_docs, heavy)
    pairs = pair_sums(groups, cells).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    terms = cells.where(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")).alias("rank")
    return pairs.select("*", rank).unionByName(terms.select("*", rank).where(F.col("rank") <= term_ranks))
