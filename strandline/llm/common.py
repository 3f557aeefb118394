"""Helpers that the operators of this folder share.

Every operator takes the columns it needs by name, works on internal names that
start with ``__`` and returns only what its docstring lists, so further input
columns (also ones named like its results) neither pass through nor clash.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space and the ASCII controls tab to carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one that is read in fewer splits than there are cores, so a small one, is dealt to all of them."""
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return found.repartition(cores) if found.rdd.getNumPartitions() < cores else found


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs in one process (tests) a local one is
    made; executors elsewhere would not see it, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Such names with as many underscores before them as make them none of the table's columns."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        found.append(name)
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    Cuts lineage: what reads the result survives lost executors and repeats no work.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def finished(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at ``path``; only if no run has finished it, it is made (and what a stopped one left is replaced)."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def words_of(text: Column) -> Column:
    """Array of the words of a text; a null or empty text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def word_count(text: Column) -> Column:
    """Number of words without keeping them."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_CLASS + "+")).cast("long")


def let(value: Column, body) -> Column:
    """``body`` over ``value``, computed once also where the optimizer inlines projections."""
    return F.element_at(F.transform(F.array(value), body), 1)
