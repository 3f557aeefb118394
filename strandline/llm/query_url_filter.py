"""Query op4: a verdict for every page's url (no SQL: the regression's verdicts are tested against a brute-force version)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import url_filter as U
from strandline.llm.common import table


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.judge(table(spark, sf_dir, "pages"), U.train(U.labelled_table(spark)))


QUERIES = {"op4_url_filter": op4_url_filter}
