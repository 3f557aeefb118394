"""Projections as storage: rows in folders by scope and fingerprint, and a manifest that is written last.

A run writes the scopes whose fingerprint no complete projection has, each into a folder of its own
(dynamic partition overwrite, so a run that is repeated replaces what a stopped one left), counts what
can be read back, and only then appends the manifest.  Readers take of each scope the rows of its
latest manifest entry; so until that moment they see the old rows, whole, whatever a stopped run left behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.adapters import stored

MANIFEST = "scope string, fingerprint string, n long, run long"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``scope, fingerprint, n, run``: the latest complete projection of each scope."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
        rows.limit(0).count()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], MANIFEST)
    last = Window.partitionBy("scope").orderBy(F.desc("run"))
    return rows.withColumn("k", F.row_number().over(last)).where("k = 1").drop("k")


def write_rows(versions: DataFrame, rows: DataFrame, path: str) -> DataFrame:
    """The first half of a run: ``scope, fingerprint, n`` of what is new, with its rows written but not yet visible.

    ``versions``: ``scope, fingerprint``, one row for each scope; ``rows``: ``scope`` and more.  Nulls in ``scope`` are left out.
    """
    spark = rows.sparkSession
    wanted = versions.where("scope IS NOT NULL AND fingerprint IS NOT NULL").select(F.col("scope").cast("string").alias("scope"), "fingerprint")
    if twice := wanted.groupBy("scope").count().where("count > 1").first():
        raise ValueError(f"scope {twice['scope']} has several fingerprints")
    todo = stored(wanted.join(manifest(spark, path).select("scope", "fingerprint"), ["scope", "fingerprint"], "left_anti"), "projection-todo")
    own = rows.withColumn("scope", F.col("scope").cast("string")).join(todo, "scope")
    own.repartition("scope").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scope", "fingerprint").parquet(f"{path}/rows")
    counts = own.groupBy("scope").agg(F.count(F.lit(1)).alias("n"))
    return stored(todo.join(counts, "scope", "left").select("scope", "fingerprint", F.coalesce("n", F.lit(0)).cast("long").alias("n")), "projection-written")


def finish(written: DataFrame, schema: str, path: str, run: int) -> DataFrame:
    """The second half: what can be read back as often as it was to be written becomes visible; the others are returned as errors."""
    spark = written.sparkSession
    there = _rows(spark, path, schema).groupBy("scope", "fingerprint").agg(F.count(F.lit(1)).alias("there"))
    checked = stored(written.join(there, ["scope", "fingerprint"], "left").select("scope", "fingerprint", "n", (F.coalesce("there", F.lit(0)) == F.col("n")).alias("ok")), "projection-checked")
    checked.where("ok").select("scope", "fingerprint", "n", F.lit(run).cast("long").alias("run")).write.mode("append").parquet(f"{path}/manifest")
    return checked.where("NOT ok").select("scope", F.lit("COUNT_MISMATCH").alias("error"))


def project(versions: DataFrame, rows: DataFrame, path: str, run: int) -> DataFrame:
    """One whole run; ``scope, error`` of the scopes that could not be replaced and keep their old rows."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "scope")
    return finish(write_rows(versions, rows, path), schema, path, run)


def _rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, scope string, fingerprint string").parquet(f"{path}/rows")


def current(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows that readers see; ``schema``: of the rows, without the scope."""
    return _rows(spark, path, schema).join(manifest(spark, path).select("scope", "fingerprint"), ["scope", "fingerprint"])


def sweep(spark: SparkSession, path: str) -> int:
    """Delete the folders that no reader sees any more; a driver's task, one folder for each superseded projection."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{path}/rows")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    written = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select("scope", "fingerprint").distinct()
    old = written.join(manifest(spark, path).select("scope", "fingerprint"), ["scope", "fingerprint"], "left_anti")
    gone = 0
    for r in old.toLocalIterator():
        gone += fs.delete(jvm.org.apache.hadoop.fs.Path(root, f"scope={r['scope']}/fingerprint={r['fingerprint']}"), True)
    return gone
