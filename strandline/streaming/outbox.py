"""The outbox: a streaming source with offsets over an append-only queue, and a sink that publishes each batch once.

The queue is a folder of Parquet files with ascending ``id``.  An offset is the last id that was taken; every poll
takes the next ``batch`` ids.  A batch that was cut short runs again with the same
offsets, and the sink writes it to the same place, so what was published twice is there once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

BATCH = 50
FIELDS = "id long, payload string"


def opened(path: str):
    """pyarrow's file system and the path in it; a path without a scheme is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Range(InputPartition):
    """The ids after one and up to another in some row groups of files."""

    def __init__(self, after: int, last: int, groups: list[tuple[str, int]]):
        self.after, self.last, self.groups = after, last, groups


#: Ids that a look at the queue keeps for the polls to come, rows of one task, and rows of one row group of a queue that is written here.
AHEAD, TASK_ROWS, GROUP_ROWS = 2_000_000, 200_000, 50_000
LEAST, MOST = -(2**63), 2**63 - 1


class OutboxReader(DataSourceStreamReader):
    """Footers are read once for each file, and ids for many polls at once; a poll lists the folder, and a task reads only row groups that may hold its ids."""

    def __init__(self, path: str, batch: int):
        self.path, self.batch, self.at = path, batch, None
        self.groups, self.files = [], set()
        # the sorted ids that come next, and the id up to which none is missing there
        self.ahead, self.bound = None, LEAST

    def initialOffset(self) -> dict:
        return {"id": -1}

    def latestOffset(self) -> dict:
        after = -1 if self.at is None else self.at
        self._look()
        ids = self._following(after)
        if len(ids) < self.batch and self.bound < MOST:
            self._fill(after)
            ids = self._following(after)
        return {"id": int(ids[: self.batch][-1]) if len(ids) else after}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        # a restarted query asks for its last batch first
        self.at = max(end["id"], -1 if self.at is None else self.at)
        if not self.files:
            self._look()
        tasks, rows = [], TASK_ROWS
        for least, most, path, k, n in self.groups:
            if most > start["id"] and least <= end["id"]:
                if rows + n > TASK_ROWS:
                    tasks.append(_Range(start["id"], end["id"], []))
                    rows = 0
                tasks[-1].groups.append((path, k))
                rows += n
        return tasks

    def read(self, partition: _Range):
        from itertools import groupby

        for path, own in groupby(partition.groups, lambda g: g[0]):
            yield from self._rows(path, [k for _, k in own], ["id", "payload"], partition.after, partition.last)

    def _look(self) -> None:
        """Take in the row groups of files that were not there before."""
        import pyarrow.parquet as pq

        system, folder = opened(self.path)
        for f in system.get_file_info(_selector(folder)):
            # a file that is still being written lies in a folder that is none of the queue's
            if f.path in self.files or not f.path.endswith(".parquet") or any(x[:1] in ("_", ".") for x in f.path.removeprefix(folder).split("/")):
                continue
            with system.open_input_file(f.path) as opened_file:
                meta = pq.read_metadata(opened_file)
            self.files.add(f.path)
            column = meta.schema.names.index("id")
            for k in range(meta.num_row_groups):
                group = meta.row_group(k)
                stats = group.column(column).statistics
                least, most = (stats.min, stats.max) if stats is not None and stats.has_min_max else (LEAST, MOST)
                self.groups.append((least, most, f.path, k, group.num_rows))
                if least <= self.bound:
                    self.ahead, self.bound = None, LEAST
        self.groups.sort()

    def _following(self, after: int):
        import numpy as np

        return () if self.ahead is None else self.ahead[np.searchsorted(self.ahead, after, "right") :]

    def _fill(self, after: int) -> None:
        """The next ids, ``AHEAD`` or a batch if that is more, by row groups in the order of their least ids; memory holds twice as many."""
        import numpy as np

        most, size, held, bound = max(AHEAD, self.batch), 0, [], MOST
        for least, greatest, path, k, _ in self.groups:
            if least > bound:
                break
            if greatest <= after:
                continue
            for b in self._rows(path, [k], ["id"], after, bound):
                held.append(b.column(0).to_numpy())
                size += b.num_rows
                if size >= (most if bound == MOST else 2 * most):
                    ids = np.concatenate(held)
                    bound = int(np.partition(ids, most - 1)[most - 1])
                    held = [ids[ids <= bound]]
                    size = len(held[0])
        ids = np.sort(np.concatenate(held)) if held else np.array([], np.int64)
        self.ahead, self.bound = ids[ids <= bound], bound

    def _rows(self, path: str, groups: list[int], columns: list[str], after: int, last: int):
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        # files may differ in what they let be null
        kinds = pa.schema([(c, {"id": pa.int64(), "payload": pa.string()}[c]) for c in columns])
        with opened(self.path)[0].open_input_file(path) as f:
            for b in pq.ParquetFile(f).iter_batches(row_groups=groups, columns=columns):
                kept = b.select(columns).filter((pc.field("id") > after) & (pc.field("id") <= last))
                if kept.num_rows:
                    yield pa.RecordBatch.from_arrays([x.cast(k) for x, k in zip(kept.columns, kinds.types, strict=True)], schema=kinds)


def _selector(path: str):
    from pyarrow import fs

    return fs.FileSelector(path, recursive=True)


class Outbox(DataSource):
    """``format("outbox")`` with the options ``path`` and ``batch``."""

    @classmethod
    def name(cls) -> str:
        return "outbox"

    def schema(self) -> str:
        return FIELDS

    def streamReader(self, schema) -> DataSourceStreamReader:
        return OutboxReader(self.options["path"], int(self.options.get("batch", BATCH)))


def append(rows: DataFrame, path: str) -> None:
    """``id, payload`` as files of the queue whose ids ascend, also from file to file, in row groups of few rows."""
    rows.repartitionByRange("id").sortWithinPartitions("id").write.mode("append").option("parquet.block.row.count.limit", GROUP_ROWS).parquet(path)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Outbox)


def pending(spark: SparkSession, path: str, batch: int = BATCH) -> DataFrame:
    return spark.readStream.format("outbox").option("path", path).option("batch", str(batch)).load()


def publisher(queue: DataFrame, folder: str, checkpoint: str, publish=None, every: str = "1 second"):
    """A writer that publishes every batch; ``publish(rows, batch number)`` defaults to one folder for each number, written whole or again."""

    def write(rows: DataFrame, n: int) -> None:
        (publish or to_folder(folder))(rows, n)

    return queue.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every)


def to_folder(folder: str):
    def publish(rows: DataFrame, n: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={n}")

    return publish


def published(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    return spark.read.schema(schema).parquet(folder).select(*names)
