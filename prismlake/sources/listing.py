"""Listings of media files as tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_name, parent
from ..operators.ingest import ignored_path, supported

MOST_LEVELS = 32


def discovered(listing: DataFrame, root: str) -> DataFrame:
    """What of a listing (file_path, file_size, file_modified_at) is taken up: supported, not empty, and no part below the root is ignored."""
    below = F.substring("file_path", F.lit(len(root.rstrip("/")) + 1), F.length("file_path"))
    deep = F.size(F.split(below, "/")) - 1 <= MOST_LEVELS
    kept = listing.filter(F.col("file_path").startswith(root) & (F.col("file_size") > 0) & supported(base_name(F.col("file_path"))) & ~ignored_path(below) & deep)
    return kept.withColumns({"directory": parent(F.col("file_path")), "file_name": base_name(F.col("file_path"))})


#: Folders that are looked for before tasks take over, and tasks that list them.
FOLDERS, TASKS = 1024, 256


def entries(folder: str) -> tuple[list[tuple[str, int, int]], list[str]]:
    """The files (path, size, milliseconds) and the folders in a folder; none if it can't be read. Links are not followed."""
    found, folders = [], []
    try:
        with os.scandir(folder) as each:
            for e in each:
                if e.is_dir(follow_symlinks=False):
                    folders.append(e.path)
                elif e.is_file(follow_symlinks=False):
                    s = e.stat()
                    found.append((e.path, s.st_size, s.st_mtime_ns // 1_000_000))
    except OSError:
        return [], []
    return found, folders


def walk(spark: SparkSession, root: str) -> DataFrame:
    """A listing of a folder that every executor sees, without following links, down to MOST_LEVELS.

    The driver goes down level by level until it knows FOLDERS folders; tasks list these and what is below them. Spark's own
    file sources leave out names with a leading underscore, which cameras write. Raises if the root is no folder or can't
    be read. A folder below that can't be read has no files.
    """
    if not os.path.isdir(root):
        raise NotADirectoryError(root)
    if not os.access(root, os.R_OK | os.X_OK):
        raise PermissionError(root)

    level, done, depth = [root], [], 0
    while level and len(level) < FOLDERS and depth < MOST_LEVELS:
        below = [entries(f) for f in level]
        done += level
        level, depth = [d for _, folders in below for d in folders], depth + 1

    def files(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for path, rest in zip(pdf["path"], pdf["rest"], strict=True):
                now = [path]
                while now:
                    below = [entries(f) for f in now]
                    out += [row for found, _ in below for row in found]
                    now = [d for _, folders in below for d in folders] if rest > 0 else []
                    rest -= 1
            yield pd.DataFrame(out, columns=["file_path", "file_size", "file_modified_at"])

    # folders the driver has been in are listed again by tasks, without what is below them
    rows = [(f, 0) for f in done] + [(f, MOST_LEVELS - depth) for f in level]
    folders = spark.createDataFrame(rows, "path string, rest int")
    return folders.repartition(min(TASKS, len(rows)), "path").mapInPandas(files, "file_path string, file_size long, file_modified_at long")
