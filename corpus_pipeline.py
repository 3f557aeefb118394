"""The corpus pipeline: toxicity, near copies, repeated passages, benchmark leaks, mixing.

Each stage's result is written as Parquet and read again as the next one's documents.
``run`` keeps these tables in the folder that ``spark.checkpoint.dir`` names, or in one of the
caller's; there, a run that was stopped goes on after its last finished stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import stages
from strandline.llm.common import finished, stored, table

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("near copies", stages.drop_near_copies),
    ("substring dedup", stages.drop_repeats),
    ("decontamination", stages.drop_leaks),
    ("mixing", stages.mix_sources),
]

#: SQL can express neither the lexicon nor the fingerprints; tests/llm compares every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over ``documents``.  ``folder``: of this corpus alone, shared by driver and executors; tables that it has are not made again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        if k + 1 == len(STAGES):
            docs = stage(spark, docs, sf_dir)
        elif folder is None:
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{k}")
        else:
            docs = finished(spark, f"{folder}/pipeline-{k}", lambda docs=docs, stage=stage: stage(spark, docs, sf_dir))
    return docs
