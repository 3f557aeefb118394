"""Projection building and session caches: reuse by fingerprint, digests, expansion over shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def to_rebuild(wanted: DataFrame, built: DataFrame, *keys: str) -> DataFrame:
    """Versions whose fingerprint no finished projection has; only these are worked on."""
    return wanted.join(built.where("complete").select(*keys, "fingerprint"), [*keys, "fingerprint"], "left_anti")


def ordered_digest(cards: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """SHA-256 over a document's card texts in order, each ended by a newline."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: F.concat(x["t"], F.lit("\n")))
    return cards.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(parts, ""), 256).alias("digest"))


def artifact_digests(cards: DataFrame, by: str, order: str, semantic: list[str], payload: str) -> DataFrame:
    """``by, n, semantic_digest, vector_digest`` over an artifact's cards in order.

    The first is taken over each card's ``semantic`` fields as a JSON object and a newline, the second over the
    bytes that the base64 column ``payload`` stands for.  A null payload has none.  An artifact has a bounded number of cards.
    """
    row = F.struct(F.col(order).alias("o"), F.to_json(F.struct(*semantic), {"ignoreNullFields": "false"}).alias("s"), F.coalesce(F.hex(F.unbase64(payload)), F.lit("")).alias("v"))
    rows = cards.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(row)).alias("rows"))
    said = F.array_join(F.transform("rows", lambda x: F.concat(x["s"], F.lit("\n"))), "")
    return rows.select(by, "n", F.sha2(said, 256).alias("semantic_digest"), F.sha2(F.unhex(F.array_join("rows.v", "")), 256).alias("vector_digest"))


def expand_same_column(cells: DataFrame, anchors: DataFrame, most: int = 5) -> DataFrame:
    """Cells that share a table and a normalised column header with an anchor, the nearest rows first."""
    a = anchors.select("anchor", "table_id", "header", F.col("row").alias("at"))
    rows = cells.join(a, ["table_id", "header"]).where(F.col("row") != F.col("at"))
    order = Window.partitionBy("anchor").orderBy(F.abs(F.col("row") - F.col("at")), "row", "cell_id")
    return rows.select("anchor", "cell_id", F.row_number().over(order).alias("n")).where(F.col("n") <= most)


def keep_root_placeholders(ranked: DataFrame, headings: DataFrame) -> DataFrame:
    """Results for a root (heading -1) stay only where the document has no other heading."""
    return ranked.join(headings.select("version").distinct().withColumn("has", F.lit(True)), "version", "left").where((F.col("heading") >= 0) | F.col("has").isNull()).drop("has")


def first_calls(calls: DataFrame) -> DataFrame:
    """A session's calls with how often an equal signature came before: 0 runs, others are answered from its cache."""
    return calls.withColumn("repeat", F.row_number().over(Window.partitionBy("session", "signature").orderBy("seq")) - 1)


def telemetry(calls: DataFrame) -> DataFrame:
    """``request_id, kind, round, characters, evidence, citations`` of a request's calls → one row for each request.

    Model calls, tool calls and rounds, characters read, evidence registered, citations given.
    """
    n = lambda kind: F.count_if(F.col("kind") == kind)
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c)
    return calls.groupBy("request_id").agg(n("MODEL").alias("model_calls"), n("TOOL").alias("tool_calls"), F.countDistinct(F.when(F.col("kind") == "TOOL", F.col("round"))).alias("tool_rounds"), total("characters"), total("evidence"), total("citations"))


def build(versions: DataFrame, canonical: DataFrame, retrieval: DataFrame, built: DataFrame, index: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round of projecting versions into an index: ``(index, manifest, errors)``.

    Versions whose manifests do not belong together are errors and touch nothing; of
    the others those are built anew whose fingerprint no finished projection has.  Their old rows go, the new
    ones come in, and a version is complete only if the index holds exactly as many
    rows as were to be written.  ``rows`` and ``index``: ``version_id`` and more; ``built``: ``version_id, fingerprint, complete``.
    """
    from strandline.operators.control import count_errors, lineage_errors, replace_scope, upsert

    checked = lineage_errors(versions, canonical, retrieval)
    good = checked.where("error IS NULL").join(retrieval.select("version_id", "fingerprint"), "version_id").select("version_id", "fingerprint")
    todo = to_rebuild(good, built, "version_id")
    new = rows.join(todo.select("version_id"), "version_id", "left_semi").select(*index.columns)
    stale = index.join(todo.select("version_id"), "version_id", "left_anti")
    written = replace_scope(stale, new, "version_id")
    expected = todo.join(rows.groupBy("version_id").agg(F.count(F.lit(1)).alias("n")), "version_id", "left").select("version_id", F.coalesce("n", F.lit(0)).alias("n"))
    wrong = count_errors(written, expected, "version_id").select("version_id", F.lit("COUNT_MISMATCH").alias("error"))
    done = todo.join(wrong.select("version_id", F.lit(True).alias("bad")), "version_id", "left").select("version_id", "fingerprint", F.col("bad").isNull().alias("complete"))
    return written, upsert(built.select("version_id", "fingerprint", "complete"), done, "version_id"), checked.where("error IS NOT NULL").unionByName(wrong)
