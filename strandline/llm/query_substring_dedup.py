"""Query op5: repeated passages of every document (no SQL: tested against a brute-force version)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import table
from strandline.llm.substring_dedup import find_repeats


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), F.element_at("kept_in", 1).alias("kept_doc_id"), "kept_in")


QUERIES = {"op5_substring_dedup": op5_substring_dedup}
