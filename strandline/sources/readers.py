"""Readers: files and columns to parsed blocks, through Arrow batches; a format is a parser registered by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.sources import docx, html_table, markdown

#: format → (parser of one document, fields of its rows)
FORMATS = {"MARKDOWN": (markdown.parse, markdown.BLOCK), "DOCX": (docx.parse, docx.BLOCK), "HTML_TABLE": (html_table.parse, html_table.CELL)}


def stored_objects(spark: SparkSession, path: str, glob: str = "*", most_bytes: int = 64 << 20) -> DataFrame:
    """Objects of a store: ``path, length, modified_at, sha256, content, error``; a larger one is an error row without content."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    large = F.col("length") > most_bytes
    content = F.when(~large, F.col("content"))
    return raw.select("path", "length", F.col("modificationTime").alias("modified_at"), F.sha2(content, 256).alias("sha256"), content.alias("content"), F.when(large, "OBJECT_TOO_LARGE").alias("error"))


def object_page(spark: SparkSession, path: str, after: str | None = None, limit: int = 1000, glob: str = "*") -> DataFrame:
    """One page of a store's listing in the order of paths: ``path, length, modified_at, next``; ``next`` goes into ``after``, and is null on the last page.

    Contents are not read.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "length", F.col("modificationTime").alias("modified_at"))
    rest = listed if after is None else listed.where(F.col("path") > after)
    ahead = rest.orderBy("path").limit(limit + 1)
    n = Window.orderBy("path")
    rows = ahead.select("*", F.row_number().over(n).alias("n"), F.max("path").over(n.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("last"), F.count(F.lit(1)).over(Window.partitionBy()).alias("c"))
    more = F.max(F.when(F.col("n") == limit, F.col("path"))).over(Window.partitionBy())
    return rows.where(F.col("n") <= limit).select("path", "length", "modified_at", F.when(F.col("c") > limit, more).alias("next"))


class ObjectStore:
    """Artifacts by key under one folder of any file system that Spark reads: put once, open, exists, delete."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.fs = self.jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, key: str):
        parts = key.split("/")
        if not key or any(p in ("", ".", "..") for p in parts):
            raise ValueError(f"bad key {key!r}")
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}")

    def exists(self, key: str) -> bool:
        return self.fs.exists(self._path(key))

    def put(self, key: str, content: bytes) -> str:
        """Write an object that is not there yet (whole or not at all) and give its SHA-256; an equal one is left as it is."""
        import hashlib

        digest = hashlib.sha256(content).hexdigest()
        if self.exists(key):
            if hashlib.sha256(self.open(key)).hexdigest() != digest:
                raise FileExistsError(key)
            return digest
        path = self._path(key)
        part = self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}.part")
        out = self.fs.create(part, True)
        try:
            out.write(bytearray(content))
        finally:
            out.close()
        if not self.fs.rename(part, path):
            raise OSError(f"could not write {key}")
        return digest

    def open(self, key: str, most_bytes: int = 64 << 20) -> bytes:
        if not self.exists(key):
            raise FileNotFoundError(key)
        if self.fs.getFileStatus(self._path(key)).getLen() > most_bytes:
            raise ValueError("OBJECT_TOO_LARGE")
        stream = self.fs.open(self._path(key))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def delete(self, key: str) -> bool:
        """Whether there was one; deleting again is no error."""
        return self.fs.delete(self._path(key), False)


def parse_column(df: DataFrame, id_col: str, content_col: str, format_name: str) -> DataFrame:
    """``id, src, error`` and the format's fields: a row for each block, or one with an error."""
    parser, fields = FORMATS[format_name]
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for i, content in zip(b["id"], b["content"], strict=True):
                try:
                    found = parser(content)
                    rows += [(i, k, None, *[x[n] for n in names]) for k, x in enumerate(found)]
                except ValueError as e:
                    rows.append((i, 0, str(e), *[None] * len(names)))
            yield pd.DataFrame(rows, columns=["id", "src", "error", *names])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(content_col).alias("content")).mapInPandas(run, f"id {kind}, src int, error string, {fields}")


class CaseError(ValueError):
    """A gold set that cannot be used, with the file and line."""


def gold_cases(spark: SparkSession, path: str, schema: str, key: str | None = None) -> DataFrame:
    """JSON lines of a gold set; blank lines are skipped, the first malformed line is an error that names it.

    A line must be an object that the schema fits; with ``key``, that must be there
    and unique.  Checking is one pass over the lines, the result another.
    """
    from pyspark.sql import types as T

    wanted = T.StructType.fromDDL(schema) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(schema)
    numbered = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))
    lines = numbered.where(F.length(F.trim("line")) > 0)
    typed = lines.select("file", (F.col("at") + 1).alias("__n"), F.from_json("line", T.StructType([*wanted.fields, T.StructField("_bad", T.StringType())]), {"columnNameOfCorruptRecord": "_bad"}).alias("r"), F.json_object_keys("line").alias("keys"))
    bad = typed.where(F.col("keys").isNull() | F.col("r._bad").isNotNull()).orderBy("file", "__n").select("file", "__n").first()
    if bad:
        raise CaseError(f"{bad['file']} line {bad['__n']}: no such case")
    rows = typed.select("__n", "r.*").drop("_bad")
    if key:
        twice = rows.groupBy(key).agg(F.count(F.lit(1)).alias("c"), F.max("__n").alias("__n")).where(F.col(key).isNull() | (F.col("c") > 1)).orderBy("__n").first()
        if twice:
            raise CaseError(f"line {twice['__n']}: {key} {twice[key]!r} is missing or repeated")
    return rows.drop("__n")
