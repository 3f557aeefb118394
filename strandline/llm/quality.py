"""Quality rules: base statistics and cross-document line frequency (native DataFrame operators only).

Lines are hashed after lower-casing and collapsing spaces.  For each host (here
the source) the number of distinct texts that hold a line is counted; exact copies
count once, so a text that was copied often does not turn its lines into boilerplate.
A line is over the limit if more than ``min_docs`` texts and more than ``share`` of
the host's texts hold it.  Lines over the limit are removed; a document is depleted,
and rejected, if less than ``left`` of its words remain.

A host has at most (mean lines of a text / ``share``) lines over the limit, so
these fit in one array for each host; the table of hosts is joined to the documents
(Spark sends it to the tasks while under its broadcast limit).  Texts are read once:
statistics and line hashes of each document are kept in a small table.

Defined results: null texts are empty and fail the base rule; null hosts are one
host; empty tables give no rows; repeated rows give repeated results; extra columns
are ignored.  Windows of a text are compared by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import SPACE_CLASS, WORD_CLASS, let, stored, words_of

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8


def repeat_words(words: Column, width: int = WINDOW) -> Column:
    """Number of words that lie in a window of ``width`` words which the text has twice or more."""

    def windows(hashes):
        return F.transform(F.sequence(F.lit(1), F.size(hashes) - (width - 1)), lambda i: F.xxhash64(F.slice(hashes, i, width)))

    def covered(w):
        pairs = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))

        def repeated(s):
            same = lambda x, i: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
            hits = F.filter(F.transform(s, lambda x, i: F.when(same(x, i - 1) | same(x, i + 1), x["at"])), lambda x: x.isNotNull())
            start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
            return F.aggregate(F.array_sort(hits), start, lambda a, p: F.struct((a["n"] + p + width - F.greatest(a["end"], p)).alias("n"), (p + width).alias("end")))["n"]

        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(pairs, repeated))

    found = let(F.transform(words, lambda x: F.xxhash64(x)), lambda h: let(windows(h), covered))
    return F.when(F.size(words) < width + 1, F.lit(0)).otherwise(found).cast("long")


def line_hashes(text: Column) -> Column:
    """Array of (hash, words) of the lines that have a word."""
    spaced = F.lower(F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " "))
    lines = F.transform(F.split(spaced, "\n"), lambda x: F.trim(x))
    return F.transform(F.array_remove(lines, ""), lambda x: F.struct(F.xxhash64(x).alias("hash"), (F.size(F.split(x, " "))).alias("words")))


def base_columns(text: Column) -> list[Column]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a text that is not null."""

    def measured(w):
        lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(WORD_CLASS)))
        dup = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            dup.cast("long").alias("n_dup_lines"),
            repeat_words(w).alias("n_repeat_words"),
        )

    return [let(words_of(text), measured).alias("__base"), line_hashes(text).alias("__lines")]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``doc_id, __host, __digest`` with the statistics and line hashes of each document; stored, so texts are read once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("__host"), F.xxhash64(text).alias("__digest"), *base_columns(text))
    return stored(rows.select("doc_id", "__host", "__digest", "__base.*", "__lines"), "quality-base")


def frequent_lines(measured: DataFrame, min_docs: int = 20, share: float = 0.1) -> DataFrame:
    """``__host, __over``: for each host that has any, the hashes of its lines over the limit."""
    texts = measured.select("__host", "__digest").distinct().groupBy("__host").agg(F.count(F.lit(1)).alias("__texts"))
    held = measured.select("__host", "__digest", F.explode(F.array_distinct("__lines.hash")).alias("__line")).distinct()
    counted = held.groupBy("__host", "__line").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > min_docs)
    over = counted.alias("c").join(texts.alias("t"), F.col("c.__host").eqNullSafe(F.col("t.__host"))).where(F.col("__n") > share * F.col("__texts"))
    return over.groupBy("c.__host").agg(F.collect_list("__line").alias("__over"))


def judge(docs: DataFrame, min_docs: int = 20, share: float = 0.1, left: float = 0.25, min_words: int = 20, max_repeat: int = 30, **columns) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words, kept``."""
    rows = measure(docs, **columns)
    over = frequent_lines(rows, min_docs, share).select(F.col("__host").alias("__h"), "__over")
    joined = rows.join(over, F.col("__host").eqNullSafe(F.col("__h")), "left")
    removed = F.aggregate("__lines", F.lit(0), lambda a, x: a + F.when(F.array_contains(F.col("__over"), x["hash"]), x["words"]).otherwise(0))
    removed = F.when(F.col("__over").isNull(), F.lit(0)).otherwise(removed).cast("long").alias("removed_words")
    failed = ((F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))).alias("base_failed")
    judged = joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed, removed)
    return judged.select("*", (~F.col("base_failed") & (F.col("n_words") - F.col("removed_words") >= left * F.col("n_words"))).alias("kept"))


def remove_lines(docs: DataFrame, over: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``docs`` with the lines over the limit taken out of the texts; ``over`` is what ``frequent_lines`` gives."""
    normal = lambda x: F.xxhash64(F.trim(F.lower(F.regexp_replace(x, SPACE_CLASS + "+", " "))))
    table = over.select(F.col("__host").alias("__h"), "__over")
    joined = docs.join(table, F.col(host_col).eqNullSafe(F.col("__h")), "left")
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda x: ~F.array_contains(F.col("__over"), normal(x))), "\n")
    return joined.select(*[F.when(F.col("__over").isNull(), F.col(c)).otherwise(kept).alias(c) if c == text_col else F.col(c) for c in docs.columns])
