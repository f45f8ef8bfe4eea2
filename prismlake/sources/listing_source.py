"""A folder's files as a data source, for tables and streams: `spark.read.format("media_listing").load(root)`.

Partitions are folders: the driver goes down until it knows enough of them, tasks list these and what is below. As a stream the
offset is a time: a batch has the files whose time of modification is after the offset before and not after its own,
so a file that is written again comes again, and a query that starts anew goes on from its checkpoint. The offset stays
`settle_ms` behind the clock, so that a file's writing is over when its time comes. What is removed doesn't show.

Options: path, and for streams `settle_ms` (2,000) and `begin_ms` (0: with all that is there).
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .listing import FOLDERS, MOST_LEVELS, entries

SCHEMA = "file_path string, file_size long, file_modified_at long"
_ARROW = pa.schema([("file_path", pa.string()), ("file_size", pa.int64()), ("file_modified_at", pa.int64())])
ROWS_A_BATCH = 10_000


class Folder(InputPartition):
    """A folder to list, how many levels below it too, and the times between which files count."""

    def __init__(self, path: str, levels: int, after: int | None = None, until: int | None = None):
        self.path, self.levels, self.after, self.until = path, levels, after, until


def folders(root: str, after: int | None = None, until: int | None = None) -> list[Folder]:
    """Partitions: those above are listed without, the deepest known ones with what is below."""
    level, above, depth = [root], [], 0
    while level and len(level) < FOLDERS and depth < MOST_LEVELS:
        above += level
        level, depth = [d for f in level for d in entries(f)[1]], depth + 1
    return [Folder(f, 0, after, until) for f in above] + [Folder(f, MOST_LEVELS - depth, after, until) for f in level]


def listed(p: Folder) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    now, levels = [p.path], p.levels
    while now:
        below = []
        for folder in now:
            found, deeper = entries(folder)
            rows += [r for r in found if (p.after is None or r[2] > p.after) and (p.until is None or r[2] <= p.until)]
            below += deeper
            while len(rows) >= ROWS_A_BATCH:
                yield _batch(rows[:ROWS_A_BATCH])
                rows = rows[ROWS_A_BATCH:]
        now, levels = (below, levels - 1) if levels > 0 else ([], 0)
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


class ListingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_listing"

    def schema(self) -> str:
        return SCHEMA

    def _root(self) -> str:
        root = self.options["path"]
        if not os.path.isdir(root):
            raise NotADirectoryError(root)
        if not os.access(root, os.R_OK | os.X_OK):
            raise PermissionError(root)
        return root

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self._root())

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(self._root(), int(self.options.get("begin_ms", 0)), int(self.options.get("settle_ms", 2000)))


class _Reader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[Folder]:
        return folders(self.root)

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        return listed(partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, root: str, begin: int, settle: int):
        self.root, self.begin, self.settle = root, begin, settle

    def initialOffset(self) -> dict:  # noqa: N802
        return {"until": self.begin - 1}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"until": max(self.begin - 1, time.time_ns() // 1_000_000 - self.settle)}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        return folders(self.root, start["until"], end["until"])

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        return listed(partition)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ListingSource)
