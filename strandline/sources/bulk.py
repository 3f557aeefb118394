"""Bulk writes: each task packs its rows into bulks of at most 500 actions or 5 MiB and writes one object for each.

A row is one action; a bulk ends before the action that would exceed a limit.  An action that is too
large for any bulk fails alone and is reported, the others go on.  The job's commit writes a manifest of the bulks of the
tasks that succeeded, and only what that names is read back; an aborted job's objects are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

MOST_ACTIONS = 500
MOST_BYTES = 5 << 20


class Written(WriterCommitMessage):
    """``bulks``: (object, actions, bytes); ``failed``: (id, bytes)."""

    def __init__(self, bulks: list[tuple], failed: list[tuple]):
        self.bulks, self.failed = bulks, failed


def packed(actions, most_actions: int, most_bytes: int):
    """(id, line) actions → lists of them as bulks; an action that fits none comes as its id and size."""
    bulk, size = [], 0
    for key, line in actions:
        n = len(line) + 1
        if n > most_bytes:
            yield key, n
            continue
        if bulk and (len(bulk) >= most_actions or size + n > most_bytes):
            yield bulk
            bulk, size = [], 0
        bulk.append(line)
        size += n
    if bulk:
        yield bulk


class BulkWriter(DataSourceWriter):
    def __init__(self, path: str, most_actions: int, most_bytes: int):
        self.path, self.most_actions, self.most_bytes = path, most_actions, most_bytes

    def write(self, rows) -> Written:
        import json
        import uuid

        from strandline.streaming.outbox import opened

        system, path = opened(self.path)
        system.create_dir(path, recursive=True)
        bulks, failed = [], []
        actions = ((r["id"], json.dumps(r.asDict(), ensure_ascii=False).encode()) for r in rows)
        # a name of its own for each attempt, so one that is run twice leaves no mixture
        name = uuid.uuid4().hex
        for one in packed(actions, self.most_actions, self.most_bytes):
            if isinstance(one, tuple):
                failed.append(one)
                continue
            file = f"bulk-{name}-{len(bulks)}.jsonl"
            with system.open_output_stream(f"{path}/{file}") as out:
                out.write(b"\n".join(one) + b"\n")
            bulks.append((file, len(one), sum(map(len, one)) + len(one)))
        return Written(bulks, failed)

    def commit(self, messages) -> None:
        import json

        from strandline.streaming.outbox import opened

        system, path = opened(self.path)
        system.create_dir(path, recursive=True)
        lines = [json.dumps({"file": f, "actions": n, "bytes": b, "id": None}) for m in messages if m for f, n, b in m.bulks]
        lines += [json.dumps({"file": None, "actions": 0, "bytes": n, "id": str(key)}) for m in messages if m for key, n in m.failed]
        with system.open_output_stream(f"{path}/manifest.part") as out:
            out.write("".join(x + "\n" for x in lines).encode())
        system.move(f"{path}/manifest.part", f"{path}/manifest.json")

    def abort(self, messages) -> None:
        from strandline.streaming.outbox import opened

        system, path = opened(self.path)
        for m in messages:
            for f, _, _ in m.bulks if m else ():
                system.delete_file(f"{path}/{f}")


class Bulk(DataSource):
    """``format("bulk")`` with the options ``path``, ``actions`` and ``bytes``; rows have an ``id``."""

    @classmethod
    def name(cls) -> str:
        return "bulk"

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return BulkWriter(self.options["path"], int(self.options.get("actions", MOST_ACTIONS)), int(self.options.get("bytes", MOST_BYTES)))


def write(rows: DataFrame, path: str, most_actions: int = MOST_ACTIONS, most_bytes: int = MOST_BYTES) -> None:
    rows.sparkSession.dataSource.register(Bulk)
    rows.write.format("bulk").mode("append").option("path", path).option("actions", str(most_actions)).option("bytes", str(most_bytes)).save()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``file, actions, bytes, id``: a row for each bulk, and one with the id for each action that failed."""
    return spark.read.schema("file string, actions int, bytes long, id string").json(f"{path}/manifest.json")


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The actions of the bulks that the manifest names, with the ``file`` of each."""
    lines = spark.read.schema(schema).option("pathGlobFilter", "bulk-*.jsonl").json(path).select("*", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"))
    return lines.join(manifest(spark, path).where("file IS NOT NULL").select("file"), "file", "left_semi")
