"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: str | None = None


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one of spark.checkpoint.dir, or, where that is unset and all tasks run on this machine, in a local one."""
    global _own
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _own = root = _own or tempfile.mkdtemp(prefix="spark-shared-")
    return f"{root}/{name}-{uuid.uuid4().hex}"
