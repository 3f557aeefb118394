"""Objects in a store: uploads whose digest, size and cap are checked as the bytes pass, and a reaper that goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.sources.readers import ObjectStore, object_page

MOST_BYTES = 64 << 20
PUT = "key string, size long, sha256 string, error string"


def put_parts(parts: DataFrame, root: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``key, n, part`` (bytes) → ``key, size, sha256, error``; the objects are written by the tasks, a part at a time.

    The parts of a key come to one task in the order of ``n``; it holds one of them.  An object that grows beyond ``most_bytes``
    is given up and leaves nothing behind; one that is there already stays, and is an
    error unless it is the same.  A null part is empty.  A task that runs again finds its own objects and
    gives the same rows.
    """

    def run(batches):
        import pyarrow as pa

        writer, out = None, []
        for b in batches:
            for key, part in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                if writer is None or writer.key != key:
                    if writer is not None:
                        out.append(writer.done())
                    writer = _Upload(root, key, most_bytes)
                writer.write(part.as_buffer() if part.is_valid else b"")
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("key", pa.string()), ("size", pa.int64()), ("sha256", pa.string()), ("error", pa.string())]))
                out = []
        if writer is not None:
            yield pa.RecordBatch.from_pylist([writer.done()], schema=pa.schema([("key", pa.string()), ("size", pa.int64()), ("sha256", pa.string()), ("error", pa.string())]))

    return parts.where("key IS NOT NULL").select("key", "n", "part").repartition("key").sortWithinPartitions("key", "n").mapInArrow(run, PUT)


class _Upload:
    """One object under way, beside its final place."""

    def __init__(self, root: str, key: str, most_bytes: int):
        import hashlib
        import uuid

        from strandline.streaming.outbox import opened

        self.key, self.most, self.size, self.error = key, most_bytes, 0, None
        self.digest = hashlib.sha256()
        self.out = None
        if not key or any(p in ("", ".", "..") for p in key.split("/")):
            self.error = "BAD_KEY"
            return
        self.system, base = opened(root)
        self.path = f"{base}/{key}"
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.system.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.system.open_output_stream(self.part)

    def write(self, data) -> None:
        if self.error:
            return
        self.size += len(data)
        if self.size > self.most:
            self.error = "OBJECT_TOO_LARGE"
            self._drop()
            return
        self.digest.update(data)
        self.out.write(data)

    def _drop(self) -> None:
        self.out.close()
        self.system.delete_file(self.part)

    def done(self) -> dict:
        if self.error:
            return {"key": self.key, "size": None, "sha256": None, "error": self.error}
        self.out.close()
        sha = self.digest.hexdigest()
        if self.system.get_file_info(self.path).is_file:
            self.system.delete_file(self.part)
            error = None if self._there() == sha else "OBJECT_EXISTS"
        else:
            self.system.move(self.part, self.path)
            error = None
        return {"key": self.key, "size": self.size, "sha256": sha if error is None else None, "error": error}

    def _there(self) -> str:
        import hashlib

        found = hashlib.sha256()
        with self.system.open_input_stream(self.path) as f:
            while block := f.read(1 << 20):
                found.update(block)
        return found.hexdigest()


def reap(spark: SparkSession, root: str, referenced: DataFrame, cutoff: str, state: str, limit: int = 1000, delete: Callable[[str], object] | None = None) -> DataFrame:
    """One page of a scan for objects that nothing refers to: ``path, outcome``.

    ``referenced``: ``path``.  The page starts where the last run's stored cursor (in the folder ``state``) ends, and after
    the last page at the beginning.  An object is YOUNG, REFERENCED, REMOVED or, where looking or deleting failed, RETAINED: one
    that fails is left alone and stops neither the others nor the cursor.  The page (at most ``limit`` names) is the driver's.
    """
    store = ObjectStore(spark, root)
    cursor = ObjectStore(spark, state)
    after = cursor.open("cursor").decode() if cursor.exists("cursor") else None
    page = object_page(spark, root, after or None, limit).select("path", "next", (F.col("modified_at") < F.lit(cutoff).cast("timestamp")).alias("old"))
    try:
        rows = page.join(referenced.select("path").distinct().withColumn("used", F.lit(True)), "path", "left").orderBy("path").collect()
    except Exception:
        # nothing is known of references, so nothing goes
        rows = [r.asDict() | {"used": None, "failed": True} for r in page.orderBy("path").collect()]
    out = []
    remove = delete or (lambda path: store.fs.delete(store.jvm.org.apache.hadoop.fs.Path(path), False))
    for r in rows:
        r = r if isinstance(r, dict) else r.asDict()
        outcome = "YOUNG" if not r["old"] else "RETAINED" if r.get("failed") else "REFERENCED" if r["used"] else None
        if outcome is None:
            try:
                outcome = "REMOVED" if remove(r["path"]) is not False else "RETAINED"
            except Exception:
                outcome = "RETAINED"
        out.append((r["path"], outcome))
    ends = next((r["next"] for r in rows if r["next"]), "")
    cursor.delete("cursor")
    cursor.put("cursor", (ends or "").encode())
    return spark.createDataFrame(out, "path string, outcome string")
