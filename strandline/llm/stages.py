"""Stages of the corpus pipeline: each takes ``(spark, docs, sf_dir)`` and gives the columns of ``docs``.

Columns that stages need for themselves get names that ``docs`` does not have, so
further columns may have any name and type.  Every stage gives an empty table for an
empty one.  What else each does with nulls and ties stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import decontaminate, mixing, simhash, substring_dedup, toxicity
from strandline.llm.common import fresh, stored, table

TOXIC_AT = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents whose score is 0.3 or more go.

    The model is learned from the labels of ``docs``.  Null and empty texts have the
    score of a text without matches; rows with a null id are judged like any other,
    repeated rows alike.
    """
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        match = toxicity.matcher(model)
        for b in batches:
            yield b.filter(pa.array([toxicity.probability(model, *match(t)[:3]) < TOXIC_AT for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of each group of near copies (five-word shingles, 0.8 of the bits) one document stays.

    It is the one with the smallest id, then the smallest text hash; of its rows the one whose
    other columns have the smallest digest.  One id with several texts is several
    documents.  Rows with a null id all stay; null and empty texts are one group.
    """
    text, row, n = fresh(docs, "__t", "__row", "__n")
    found = simhash.similar_documents(docs.select("doc_id", "text"))
    stay = stored(found.groupBy("root").agg(F.min(F.struct("doc_id", "t")).alias("s")).select(F.col("s.doc_id").alias("i"), F.col("s.t").alias("t")), "near-stay")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    named = docs.select("*", F.xxhash64(F.coalesce("text", F.lit(""))).alias(text), F.md5(F.to_json(F.struct(F.col("text").isNull().alias("no text"), *[c.alias(f"c{k}") for k, c in enumerate(others)]))).alias(row))
    narrow = named.where(F.col("doc_id").isNotNull()).groupBy("doc_id", text, row).agg(F.count(F.lit(1)).alias(n))
    narrow = stored(narrow.groupBy("doc_id", text).agg(F.min(F.struct(row, n)).alias("x")).select(F.col("doc_id").alias("i"), F.col(text).alias("t"), F.col(f"x.{row}").alias("r"), F.col(f"x.{n}").alias("m")), "near-rows")
    wanted = stored(narrow.join(stay, ["i", "t"]), "near-wanted").select(F.col("i").alias(n), F.col("t").alias(n + "t"), F.col("r").alias(n + "r"), F.col("m").alias(n + "m"))
    same = (named["doc_id"] == wanted[n]) & (named[text] == wanted[n + "t"]) & (named[row] == wanted[n + "r"])
    joined = named.join(wanted, same).select(*[F.col(f"`{c}`") for c in docs.columns], text, row, n + "m")
    once = joined.where(F.col(n + "m") == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
    # rows that are the same in every column: with map-side partials, since one may fill much of the table
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)])
    again = joined.where(F.col(n + "m") > 1).groupBy(F.xxhash64("doc_id", text, row).alias(n)).agg(F.first(whole).alias(text)).select(*[F.col(f"{text}.c{k}").alias(c) for k, c in enumerate(docs.columns)])
    return once.unionByName(again).unionByName(docs.where(F.col("doc_id").isNull()))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: repeated passages are cut out; documents that lose all their words go.

    ``n_chars`` is the new text's length.  Rows with a null id, null and empty texts
    stay as they are; rows of one id are one document, so nothing among them repeats.
    """
    out = substring_dedup.remove_repeats(docs, drop_emptied=True)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that hold a benchmark item go.

    Rows are judged by their texts, so null ids and repeated rows make no difference;
    null and empty texts stay.
    """
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: a row for each time that the mix takes a document, with its shard and position.

    ``mix_pass``, ``mix_shard`` and ``mix_position`` come after the columns of ``docs``;
    columns that have these names give way.  Null sources are one source, null texts
    have no words, rows of equal id and text are taken alike.
    """
    placed = ["mix_pass", "mix_shard", "mix_position"]
    kept = [c for c in docs.columns if c.lower() not in placed]
    key, source, draws = fresh(docs, "__key", "__source", "__draws")
    drawn = mixing.draws(docs.select("doc_id", "text", "source")).where(F.size("__draws") > 0).select(F.col("__ks").alias(source), F.col("__kk").alias(key), F.col("__draws").alias(draws))
    on = docs["source"].eqNullSafe(drawn[source]) & (mixing.permutation_key(docs["doc_id"], docs["text"]) == drawn[key])
    taken = docs.join(drawn, on).select(*[F.col(f"`{c}`") for c in kept], F.explode(draws).alias(draws))
    return taken.select(*[F.col(f"`{c}`") for c in kept], F.col(f"{draws}.pass").alias("mix_pass"), F.col(f"{draws}.shard").alias("mix_shard"), F.col(f"{draws}.position").alias("mix_position"))
