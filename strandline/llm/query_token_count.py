"""Query op8: tokens of every document under the 32k piece vocabulary.

The cache is the folder that the session's ``spark.strandline.token.cache`` names;
without it each run has one of its own, so that it counts the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm.common import table
from strandline.llm.token_count import count_tokens

VOCABULARY = "piece_bpe_32k.model"


def _path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(VOCABULARY))


def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), _path, spark.conf.get("spark.strandline.token.cache", None))


QUERIES = {"op8_token_count": op8_token_count}
