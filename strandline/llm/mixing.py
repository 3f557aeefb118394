"""Mixing sources to target weights by a splitting tree (native DataFrame operators only).

Every document gets a permutation key from a digest of its id and text.  The order of
the keys is the source's random permutation, and a document's place in it is the number
of words before it: a prefix sum in three steps (the source's keys by their first
``DIGITS`` hex digits, those by the next ones, the keys themselves), so no step brings a
source together and equal keys are summed before anything is ordered.

A source's target is a stretch of its permuted words, laid end to end in passes: a
document is drawn in a pass if its middle lies before the target's end.  The stretch
is cut into blocks of ``__block`` words, the same for all sources, and each shard gets
``shard_blocks`` blocks, so shards are equal in words whatever the documents' lengths.

The block quotas are split among the output shards by a binary tree: at each node the
left half's quotas are drawn from the multivariate hypergeometric distribution, source
after source, each from the exact conditional distribution by inverting its cumulative
weights around the mode.  The draws that a shard gets of a source are a run of that
source's permuted blocks, so shards are disjoint within a pass, and the position
within a shard is a digest of key and pass.

Bounds: a node of the tree is a row with one quota for each source, made for up to some
thousands of sources.  Only a table with a row for each source (and an array with an
entry for each shard) is joined to the documents; Spark sends it to the tasks while it
is under its own broadcast limit and otherwise joins by shuffle.

Defined results: null texts have size 0; null sources are one source, the last;
documents of equal id and text are taken alike; a source without a word takes
nothing; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import let, stored, word_count

MOST = 3
SHARD_BLOCKS = 256
DIGITS = 3


def permutation_key(doc_id: Column, text: Column) -> Column:
    """32 hex digits that depend on nothing but id and text."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``__id, __source, __size, __key``."""
    return docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), word_count(F.col(text_col)).alias("__size"), permutation_key(F.col(id_col), F.col(text_col)).alias("__key"))


def targets(rows: DataFrame, weights=(1, 2, 3), share: float = 1.0, most: int = MOST) -> DataFrame:
    """``__source, __words, __target``: weighted shares, no more than ``most`` times a source's words.

    Sources in order of the ratio of limit to weight: those at their limit come
    first, and one level holds for all others.
    """
    per = rows.groupBy("__source").agg(F.sum("__size").alias("__words"))
    order = Window.orderBy(F.col("__source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    weighted = per.select("*", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long").alias("__w"))
    ratio = Window.orderBy((F.col("__words") * most / F.col("__w")).asc(), F.col("__source").asc_nulls_last())
    total = Window.partitionBy()
    filled = weighted.select(
        "*",
        F.coalesce(F.sum(F.col("__words") * most).over(ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.sum("__w").over(ratio.rowsBetween(0, Window.unboundedFollowing)).alias("__rest"),
        F.sum("__words").over(total).alias("__all"),
    )
    level = (F.lit(share) * F.col("__all") - F.col("__before")) / F.col("__rest")
    limited = filled.select("*", (level * F.col("__w") >= F.col("__words") * most).alias("__full"), level.alias("__level"))
    common = F.max(F.when(~F.col("__full"), F.col("__level"))).over(total)
    return limited.select("__source", "__words", F.when(F.col("__full"), (F.col("__words") * most).cast("double")).otherwise(common * F.col("__w")).alias("__target"))


def offsets(rows: DataFrame) -> DataFrame:
    """``__source, __key, __n, __first``: words of each key, and words of the source's smaller keys."""
    keys = stored(rows.groupBy("__source", "__key").agg(F.sum("__size").alias("__n")), "mix-keys")
    cut = lambda n: F.substring("__key", 1, n * DIGITS)
    before = lambda w: F.sum("__n").over(w) - F.col("__n")
    fine = keys.groupBy("__source", cut(2).alias("__b")).agg(F.sum("__n").alias("__n"))
    fine = fine.select("*", F.substring("__b", 1, DIGITS).alias("__a"))
    coarse = fine.groupBy(F.col("__source").alias("__s"), F.col("__a").alias("__sa")).agg(F.sum("__n").alias("__n"))
    coarse = coarse.select("__s", "__sa", before(Window.partitionBy("__s").orderBy("__sa")).alias("__start"))
    fine = fine.select("__source", "__a", "__b", before(Window.partitionBy("__source", "__a").orderBy("__b")).alias("__within"))
    fine = fine.join(coarse, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__a") == F.col("__sa"))).select(F.col("__source").alias("__s"), F.col("__b").alias("__sb"), (F.col("__start") + F.col("__within")).alias("__start"))
    keys = keys.select("*", cut(2).alias("__b"))
    keys = keys.select("*", before(Window.partitionBy("__source", "__b").orderBy("__key")).alias("__within"))
    placed = keys.join(fine, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__b") == F.col("__sb")))
    return placed.select("__source", "__key", "__n", (F.col("__start") + F.col("__within")).alias("__first"))


def _hypergeometric(u: Column, good: Column, bad: Column, draws: Column) -> Column:
    """Inverse of the distribution of the good ones among ``draws`` of ``good + bad``, at ``u``.

    Weights relative to the mode, by the ratio of neighbours, as far as a double
    can tell them from nothing.
    """

    def over(low, high, mode, spread):
        def weights(step):
            sign = 1 if step > 0 else -1
            ks = F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), F.least(spread, high - mode if sign > 0 else mode - low)))

            def ratio(k):
                x = (mode + sign * k).cast("double")
                if sign > 0:
                    return (good - x + 1) * (draws - x + 1) / (x * (bad - draws + x))
                return (x + 1) * (bad - draws + x + 1) / ((good - x) * (draws - x))

            grown = F.aggregate(
                ks,
                F.struct(F.array(F.lit(1.0)).alias("all"), F.lit(1.0).alias("last")),
                lambda s, k: let(s["last"] * F.when((mode + sign * k >= low) & (mode + sign * k <= high), ratio(k)).otherwise(0.0), lambda p: F.struct(F.concat(s["all"], F.array(p)).alias("all"), p.alias("last"))),
            )
            return grown["all"]

        return let(weights(1), lambda up: let(weights(-1), lambda down: pick(up, down, mode)))

    def pick(up, down, mode):
        # from the lowest value upwards
        line = F.concat(F.reverse(F.slice(down, 2, F.size(down) - 1)), up)
        whole = F.aggregate(line, F.lit(0.0), lambda a, b: a + b)
        at = F.aggregate(line, F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("n")), lambda s, w: F.struct((s["sum"] + w).alias("sum"), (s["n"] + F.when(s["sum"] + w < u * whole, 1).otherwise(0)).alias("n")))["n"]
        return mode - (F.size(down) - 1) + at

    low, high = F.greatest(F.lit(0).cast("long"), draws - bad), F.least(good, draws)
    n = good + bad
    sd = F.sqrt(draws * (good / n) * (bad / n) * (n - draws) / F.greatest(n - 1, F.lit(1)))
    mode = F.least(high, F.greatest(low, F.floor((draws + 1.0) * (good + 1.0) / (n + 2.0)).cast("long")))
    spread = (F.ceil(sd * 40) + 12).cast("long")
    return F.when((good <= 0) | (draws <= 0), F.lit(0).cast("long")).when(bad <= 0, draws).when(low == high, low).otherwise(let(low, lambda a: let(high, lambda b: let(mode, lambda m: let(spread, lambda s: over(a, b, m, s))))))


def _uniform(*parts: Column) -> Column:
    """In (0, 1), from a digest."""
    return (F.conv(F.substring(F.md5(F.concat_ws("/", *[p.cast("string") for p in parts]).cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def split_tree(quotas: DataFrame, shards: int, seed: int = 7) -> DataFrame:
    """``__source, __quota`` → ``__source, __cut``: for each source the running end of each shard's draws.

    ``shards`` is a power of two.  A node is a row with an array of the sources'
    quotas; a level turns each row into two.
    """
    null = F.col("__source").isNull()
    named = F.struct(null.alias("null"), F.col("__source").alias("s"), F.col("__quota").cast("long").alias("q"))
    node = quotas.agg(F.array_sort(F.collect_list(named)).alias("all")).select(F.lit(0).alias("at"), F.transform("all", lambda x: F.struct(x["null"].alias("null"), x["s"].alias("s"))).alias("names"), F.col("all.q").alias("q"))
    level, width = 0, shards
    while width > 1:
        total = F.aggregate("q", F.lit(0).cast("long"), lambda a, b: a + b)
        start = F.struct(F.array().cast("array<bigint>").alias("left"), (total - F.shiftright(total, 1)).alias("draws"), total.alias("rest"), F.lit(0).alias("i"))
        u = (F.lit(seed), F.lit(level), F.col("at"))

        def take(s, q):
            return let(_hypergeometric(_uniform(*u, s["i"]), q, s["rest"] - q, s["draws"]), lambda x: F.struct(F.concat(s["left"], F.array(x)).alias("left"), (s["draws"] - x).alias("draws"), (s["rest"] - q).alias("rest"), (s["i"] + 1).alias("i")))

        left = F.aggregate("q", start, take)["left"]
        both = node.select("at", "names", "q", left.alias("left"))
        node = both.select("names", F.explode(F.array(F.struct((F.col("at") * 2).alias("at"), F.col("left").alias("q")), F.struct((F.col("at") * 2 + 1).alias("at"), F.zip_with("q", "left", lambda a, b: a - b).alias("q")))).alias("n")).select("n.at", "names", "n.q")
        level, width = level + 1, width // 2
    each = node.select("at", F.explode(F.arrays_zip(F.col("names").alias("s"), F.col("q").alias("q"))).alias("x")).select("at", F.col("x.s").alias("s"), F.col("x.q").alias("q"))
    run = Window.partitionBy("s").orderBy("at")
    cut = each.select("s", "at", F.sum("q").over(run).alias("end")).groupBy("s").agg(F.array_sort(F.collect_list(F.struct("at", "end"))).alias("c"))
    return cut.select(F.col("s.s").alias("__source"), F.col("c.end").alias("__cut"))


def _placed(rows: DataFrame, shards: int, weights, share: float, most: int, shard_blocks: int, seed: int) -> DataFrame:
    per = targets(rows, weights, share, most)
    block = F.greatest(F.lit(1).cast("long"), F.ceil(F.sum("__target").over(Window.partitionBy()) / (shards * shard_blocks)))
    plan = stored(per.select("*", block.alias("__block")).select("*", F.ceil(F.col("__target") / F.col("__block")).alias("__quota")), "mix-plan")
    cuts = split_tree(plan.select("__source", "__quota"), shards, seed).select(F.col("__source").alias("__cs"), "__cut")
    table = stored(plan.join(cuts, F.col("__source").eqNullSafe(F.col("__cs"))).drop("__cs"), "mix-table").select(F.col("__source").alias("__ts"), "__words", "__target", "__block", "__cut")

    keyed = offsets(rows).join(table, F.col("__source").eqNullSafe(F.col("__ts")))
    start = lambda k: k * F.col("__words") + F.col("__first")
    draw = lambda k: F.struct(
        k.cast("int").alias("pass"),
        F.size(F.filter("__cut", lambda c: c * F.col("__block") <= start(k))).alias("shard"),
        F.md5(F.concat_ws("/", F.lit(str(seed)), k.cast("string"), "__key").cast("binary")).alias("position"),
    )
    passes = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long")), lambda k: 2 * start(k) + F.col("__n") < 2 * F.col("__target"))
    return stored(keyed.select(F.col("__source").alias("__ks"), F.col("__key").alias("__kk"), "__words", "__target", F.transform(passes, draw).alias("__draws")), "mix-draws")


def draws(docs: DataFrame, shards: int = 16, weights=(1, 2, 3), share: float = 1.0, most: int = MOST, shard_blocks: int = SHARD_BLOCKS, seed: int = 7, **columns) -> DataFrame:
    """``__ks, __kk, __words, __target, __draws``: source, key, the source's words and target, and the draws of the key's documents."""
    return _placed(stored(sized(docs, **columns), "mix-sizes"), shards, weights, share, most, shard_blocks, seed)


def mix(docs: DataFrame, shards: int = 16, weights=(1, 2, 3), share: float = 1.0, most: int = MOST, shard_blocks: int = SHARD_BLOCKS, seed: int = 7, **columns) -> DataFrame:
    """``doc_id, source, size, source_size, target, key, draws``.

    ``draws``: an array of (pass, shard, position), one for each time that the mix
    takes the whole document; ordering a shard's draws by position shuffles it.
    """
    rows = stored(sized(docs, **columns), "mix-sizes")
    drawn = _placed(rows, shards, weights, share, most, shard_blocks, seed)
    d = rows.join(drawn, F.col("__source").eqNullSafe(F.col("__ks")) & (F.col("__key") == F.col("__kk")))
    return d.select(F.col("__id").alias("doc_id"), F.col("__source").alias("source"), F.col("__size").alias("size"), F.col("__words").alias("source_size"), F.col("__target").alias("target"), F.col("__key").alias("key"), F.col("__draws").alias("draws"))
