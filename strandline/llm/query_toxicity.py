"""Query op2: every document's toxicity (no SQL: held-out accuracy is tested)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import toxicity as T
from strandline.llm.common import table

THRESHOLD = 0.3


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = T.learn(docs, table(spark, sf_dir, "labels"))
    return T.score(docs, model).select("doc_id", T.held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "hits", "n_words")


QUERIES = {"op2_toxicity": op2_toxicity}
