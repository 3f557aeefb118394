"""Query op11: the pieces of all documents in sequences of 2,048 tokens (no SQL: tested against plain first fit and the library's ids)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import table
from strandline.llm.packing import encoder, pack


def _encoder():
    import public_tokenizers as P

    return encoder(str(P.path("byte_bpe_50k.json")), str(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), _encoder)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op11_packing": op11_packing}
