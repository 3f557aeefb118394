"""Registry of the queries and of their SQL twins."""

from __future__ import annotations

import importlib
import pkgutil

from pyspark.sql import DataFrame, SparkSession

import strandline.plans as plans


def _modules():
    for m in sorted(pkgutil.iter_modules(plans.__path__), key=lambda m: m.name):
        yield importlib.import_module(f"strandline.plans.{m.name}")


def queries() -> dict:
    return {k: f for m in _modules() for k, f in getattr(m, "QUERIES", {}).items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in getattr(m, "SQL", {}).items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["bm25_topk"](spark, sf_dir)
