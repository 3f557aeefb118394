"""Canonical assembly of parsed blocks: ordinals, offsets, the heading tree, validation.

All of it is windows partitioned by document, so one shuffle and one sort by
(document, source position) serve every column.  The heading tree needs no stack:
headings survive on the stack exactly while no later one has an equal or smaller
level, so a parent is the nearest earlier heading of a smaller level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.text import normalize_block, safe_split, same_letters, utf16_len

LEVELS = 6
SEPARATOR = 2


def paragraphs(text: Column) -> Column:
    """Paragraphs of a text: array of (start_line, end_line, text); blank lines separate, lines count from 1. In-row, no shuffle."""
    lines = F.split(text, "\n")

    def with_lines(ls):
        filled = F.transform(ls, lambda x: F.rlike(x, F.lit(r"\S")))

        def with_flags(f):
            at = F.sequence(F.lit(0), F.size(f) - 1)
            starts = F.filter(at, lambda i: F.get(f, i) & ~F.coalesce(F.get(f, i - 1), F.lit(False)))
            ends = F.filter(at, lambda i: F.get(f, i) & ~F.coalesce(F.get(f, i + 1), F.lit(False)))
            piece = lambda a, b: F.struct((a + 1).cast("long").alias("start_line"), (b + 1).cast("long").alias("end_line"), F.array_join(F.slice(ls, a + 1, b - a + 1), "\n").alias("text"))
            return F.zip_with(starts, ends, piece)

        return F.element_at(F.transform(F.array(filled), with_flags), 1)

    return F.element_at(F.transform(F.array(lines), with_lines), 1)


def assemble(parsed: DataFrame, most_chars: int | None = None) -> DataFrame:
    """``doc_id, src, kind, level, text`` → blocks with ids, ordinals, character ranges and owning heading.

    Blocks that are blank after normalising drop out but keep their place in the
    source sequence.  A heading owns its own block; the root (position -1) owns what
    comes before any heading.  With ``most_chars``, a longer element becomes several
    blocks of one ``continuation`` group, numbered by elements; a heading's first
    piece is its heading block.
    """
    text = normalize_block(F.col("text"), F.col("kind"))
    kept = parsed.select("doc_id", "src", "kind", F.when(F.col("kind") == "HEADING", F.least(F.greatest("level", F.lit(1)), F.lit(LEVELS))).alias("level"), text.alias("text")).where(F.length("text") > 0)
    keys = ["src"]
    if most_chars is not None:
        by_source = Window.partitionBy("doc_id").orderBy("src")
        kept = kept.withColumn("element", F.row_number().over(by_source) - 1)
        long = utf16_len(F.col("text")) > most_chars
        kept = kept.withColumn("pieces", F.when(long, safe_split(most_chars)("text")).otherwise(F.array("text")))
        kept = kept.select("doc_id", "src", "kind", "level", "element", (F.size("pieces") > 1).alias("several"), F.posexplode("pieces").alias("piece", "text"))
        kept = kept.withColumn("level", F.when(F.col("piece") == 0, F.col("level")))
        kept = kept.withColumn("continuation", F.when(F.col("several"), F.format_string("%d:c:%06d", F.col("doc_id"), F.col("element"))))
        keys = ["src", "piece"]
    order = Window.partitionBy("doc_id").orderBy(*keys)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    size = utf16_len(F.col("text"))
    placed = kept.select("*", (F.row_number().over(order) - 1).alias("ordinal"), F.coalesce(F.sum(size + SEPARATOR).over(before), F.lit(0)).alias("start"), size.alias("__size"))
    own = F.last(F.when(F.col("level").isNotNull(), F.col("ordinal")), ignorenulls=True).over(order)
    extra = ["continuation"] if most_chars is not None else []
    return placed.select(
        "doc_id", "src", F.format_string("%d:b:%06d", F.col("doc_id"), F.col("ordinal")).alias("block_id"), "ordinal", "kind", "level", "text",
        "start", (F.col("start") + F.col("__size")).alias("end"), F.coalesce(own, F.lit(-1)).alias("heading"), *extra,
    )


def document_errors(documents: DataFrame, blocks: DataFrame, most_blocks: int = 200_000) -> DataFrame:
    """``doc_id, format`` → ``doc_id, n_blocks, error``: no text at all, or more blocks than a document may have."""
    n = blocks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    rows = documents.join(n, "doc_id", "left").select("doc_id", "format", F.coalesce("n", F.lit(0)).alias("n_blocks"))
    empty = F.when(F.col("format") == "PDF", "PDF_NO_EXTRACTABLE_TEXT").otherwise("DOCUMENT_CORRUPT")
    return rows.select("doc_id", "n_blocks", F.when(F.col("n_blocks") == 0, empty).when(F.col("n_blocks") > most_blocks, "DOCUMENT_PARSE_LIMIT_EXCEEDED").alias("error"))


def text_preserved(before: DataFrame, after: DataFrame) -> DataFrame:
    """``doc_id, position, text`` before and after restructuring → ``doc_id, same_text, same_letters``.

    The first compares the texts in order without white space, the second how often each character occurs.
    """
    bare = F.col("text")
    for c in " \t\n\x0b\f\r":
        bare = F.replace(bare, F.lit(c), F.lit(""))

    def line(df, name):
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", bare.alias("t")))), lambda x: x["t"]), "")
        return df.groupBy("doc_id").agg(text.alias(name))

    both = line(before, "a").join(line(after, "b"), "doc_id", "full_outer")
    same = F.col("a").eqNullSafe(F.col("b"))
    # equal texts have equal letters; the others are counted if both are there
    counted = same_letters()(F.when(~same, F.col("a")), F.when(~same, F.col("b")))
    return both.select("doc_id", same.alias("same_text"), (same | F.coalesce(counted, F.lit(False))).alias("same_letters"))


def heading_tree(blocks: DataFrame) -> DataFrame:
    """Headings with parent, depth, section end, sibling number and title path."""
    return _tree(blocks).drop("ancestors")


def _tree(blocks: DataFrame) -> DataFrame:
    """The tree with each heading's ancestors, as structs (pos, depth).

    ``last_k``: the position of the last heading of level k before this one.  It is
    an ancestor if k is smaller and no heading of a still smaller level came after.
    """
    n = blocks.groupBy("doc_id").agg((F.max("ordinal") + 1).alias("n_blocks"))
    heads = blocks.where(F.col("level").isNotNull()).select("doc_id", F.col("ordinal").alias("pos"), "level", F.col("text").alias("title"))
    order = Window.partitionBy("doc_id").orderBy("pos")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    here = lambda k: F.when(F.col("level") == k, F.struct("pos", "title"))
    rows = heads.select("*", *[F.last(here(k), ignorenulls=True).over(before).alias(f"p{k}") for k in range(1, LEVELS + 1)], *[F.first(F.when(F.col("level") == k, F.col("pos")), ignorenulls=True).over(after).alias(f"n{k}") for k in range(1, LEVELS + 1)])

    def ancestor(k):
        newer = [F.coalesce(F.col(f"p{j}.pos"), F.lit(-1)) for j in range(1, k)]
        alive = F.col(f"p{k}.pos") > F.greatest(F.lit(-1), F.lit(-1), *newer)
        return F.when((F.col("level") > k) & alive, F.col(f"p{k}"))

    ancestors = F.filter(F.array(*[ancestor(k) for k in range(1, LEVELS)]), lambda x: x.isNotNull())
    end = F.least(*[F.when(F.col("level") >= k, F.col(f"n{k}")) for k in range(1, LEVELS + 1)], F.lit(1 << 30))
    tree = rows.select("doc_id", "pos", "level", "title", ancestors.alias("a"), end.alias("e")).join(n, "doc_id")
    parent = F.coalesce(F.element_at("a", -1)["pos"], F.lit(-1))
    out = tree.select("doc_id", "pos", "level", "title", F.when(F.size("a") > 0, parent).otherwise(-1).alias("parent"), (F.size("a") + 1).alias("depth"), F.least("e", "n_blocks").alias("section_end"), F.array_join(F.concat(F.col("a.title"), F.array("title")), " > ").alias("path"), F.transform("a", lambda x, i: F.struct(x["pos"].alias("pos"), (i + 1).alias("depth"))).alias("ancestors"))
    return out.withColumn("sibling", F.row_number().over(Window.partitionBy("doc_id", "parent").orderBy("pos")) - 1)


def manifest(blocks: DataFrame) -> DataFrame:
    """Counts, text length and SHA-256 of each document's canonical text."""
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "\n\n")
    return blocks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.count("level").alias("n_headings"), F.max("end").alias("text_length"), F.sha2(ordered, 256).alias("text_sha256"))


def full_manifest(blocks: DataFrame, warned: DataFrame) -> DataFrame:
    """The manifest with the number of warnings, and of pages where blocks have one."""
    pages = F.countDistinct("page") if "page" in blocks.columns else F.lit(None).cast("long")
    extra = blocks.groupBy("doc_id").agg(pages.alias("n_pages"))
    n = warned.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_warnings"))
    return manifest(blocks).join(extra, "doc_id").join(n, "doc_id", "left").withColumn("n_warnings", F.coalesce("n_warnings", F.lit(0)))


def warnings(tree: DataFrame, blocks: DataFrame) -> DataFrame:
    """HEADING_LEVEL_JUMP for a heading more than one level below its parent, NO_REAL_HEADINGS for a document without any."""
    p = tree.select("doc_id", F.col("pos").alias("parent"), F.col("level").alias("parent_level"))
    jump = tree.join(p, ["doc_id", "parent"], "left").where(F.col("level") > F.coalesce("parent_level", F.lit(0)) + 1).select("doc_id", F.lit("HEADING_LEVEL_JUMP").alias("code"), "pos")
    none = blocks.groupBy("doc_id").agg(F.count("level").alias("n")).where("n = 0").select("doc_id", F.lit("NO_REAL_HEADINGS").alias("code"), F.lit(None).cast("int").alias("pos"))
    return jump.unionByName(none)


def violations(blocks: DataFrame, separator: int = SEPARATOR) -> DataFrame:
    """Rows of ``doc_id, rule, n``: ordinals that are not dense, ranges that do not continue, ids that repeat."""
    order = Window.partitionBy("doc_id").orderBy("ordinal", "start")
    seen = blocks.select("doc_id", "ordinal", "start", "end", (F.row_number().over(order) - 1).alias("want"), F.lag("end").over(order).alias("last"), F.count(F.lit(1)).over(Window.partitionBy("doc_id", "block_id")).alias("same"))
    rules = F.array(
        F.when(F.col("ordinal") != F.col("want"), "ORDINAL_NOT_DENSE"),
        F.when(F.col("start") != F.coalesce(F.col("last") + separator, F.lit(0)), "RANGE_NOT_CONTIGUOUS"),
        F.when(F.col("end") < F.col("start"), "RANGE_NEGATIVE"),
        F.when(F.col("same") > 1, "BLOCK_ID_REPEATED"),
    )
    return seen.select("doc_id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule")).groupBy("doc_id", "rule").agg(F.count(F.lit(1)).alias("n"))


def neighbours(blocks: DataFrame, anchors: DataFrame, radius: int = 3) -> DataFrame:
    """Blocks within ``radius`` ordinals of an anchor under the same heading: each anchor is sent to the ordinals it covers, so this is an equi-join."""
    near = anchors.select("doc_id", "heading", F.col("ordinal").alias("anchor"), F.explode(F.sequence(F.col("ordinal") - radius, F.col("ordinal") + radius)).alias("ordinal"))
    return blocks.join(near, ["doc_id", "heading", "ordinal"]).select("doc_id", "anchor", "ordinal", "block_id")


def in_sections(blocks: DataFrame) -> DataFrame:
    """Every block with each section that holds it: its own heading and that one's ancestors, so an equi-join."""
    tree = _tree(blocks)
    chain = F.concat("ancestors", F.array(F.struct(F.col("pos"), F.col("depth"))))
    held = tree.select("doc_id", F.col("pos").alias("heading"), F.explode(chain).alias("s"))
    return blocks.join(held, ["doc_id", "heading"]).select("doc_id", "ordinal", "s.pos", "s.depth")


def structure_violations(blocks: DataFrame, headings: DataFrame, manifests: DataFrame) -> DataFrame:
    """``doc_id, rule, n``: what is wrong with stored blocks, headings and manifests of documents.

    ``headings``: ``doc_id, n`` (their order), ``node, parent, level, depth, section_start, section_end,
    source`` (the block's ordinal); ``blocks``: ``doc_id, ordinal, kind, text, end, node``;
    ``manifests``: ``doc_id, text_length, text_sha256``.
    """
    facts = manifest(blocks.withColumn("level", F.when(F.col("kind") == "HEADING", 1))).select("doc_id", F.col("n_blocks").alias("blocks"), F.col("text_length").alias("length"), F.col("text_sha256").alias("sha"))
    text = manifests.join(facts, "doc_id", "left")
    named = lambda df, rule: df.select("doc_id", F.lit(rule).alias("rule"))
    parts = [named(text.where(F.col("blocks").isNull()), "NO_BLOCKS"), named(text.where((F.col("length") != F.col("text_length")) | (F.col("sha") != F.col("text_sha256"))), "TEXT_MISMATCH")]
    root = F.col("parent").isNull()
    per = manifests.select("doc_id").join(headings, "doc_id", "left").groupBy("doc_id").agg(F.count_if(root & F.col("node").isNotNull()).alias("roots"))
    parts.append(named(per.where("roots <> 1"), "NOT_ONE_ROOT"))
    seen = headings.join(facts.select("doc_id", "blocks"), "doc_id", "left").join(headings.groupBy("doc_id", F.col("node").alias("parent")).agg(F.min("n").alias("parent_at")), ["doc_id", "parent"], "left")
    source = blocks.select("doc_id", F.col("ordinal").alias("source"), F.col("kind").alias("source_kind"), F.col("node").alias("source_node"))
    seen = seen.join(source, ["doc_id", "source"], "left").withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "node")))
    rules = F.array(
        F.when(F.col("same") > 1, "HEADING_REPEATED"), F.when(root & ((F.col("depth") != 0) | (F.col("level") != 0)), "BAD_ROOT"),
        F.when(~root & ~F.coalesce(F.col("parent_at") < F.col("n"), F.lit(False)), "PARENT_AFTER_CHILD"),
        F.when((F.col("section_start") < 0) | (F.col("section_end") > F.coalesce("blocks", F.lit(0))) | (F.col("section_start") > F.col("section_end")), "BAD_SECTION"),
        F.when(~root & ~F.coalesce((F.col("source_kind") == "HEADING") & (F.col("source_node") == F.col("node")), F.lit(False)), "NO_SOURCE_BLOCK"),
    )
    parts.append(seen.select("doc_id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule")))
    parts.append(named(blocks.join(headings.select("doc_id", "node").distinct(), ["doc_id", "node"], "left_anti"), "UNKNOWN_HEADING"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("doc_id", "rule").agg(F.count(F.lit(1)).alias("n"))


def evidence_groups(blocks: DataFrame) -> DataFrame:
    """Runs of blocks with one heading and consecutive ordinals: group number, first and last ordinal.

    With columns ``row`` and ``col``, a block that has both is a table cell and stays apart.
    """
    order = Window.partitionBy("doc_id").orderBy("ordinal")
    new = (F.col("ordinal") != F.lag("ordinal").over(order) + 1) | (F.col("heading") != F.lag("heading").over(order))
    if {"row", "col"} <= set(blocks.columns):
        cell = F.col("row").isNotNull() & F.col("col").isNotNull()
        new = new | cell | F.lag(cell).over(order)
    marked = blocks.select("doc_id", "ordinal", "heading", F.coalesce(new, F.lit(True)).cast("int").alias("new"))
    grouped = marked.withColumn("g", F.sum("new").over(order))
    return grouped.groupBy("doc_id", "g").agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.count(F.lit(1)).alias("n"))
