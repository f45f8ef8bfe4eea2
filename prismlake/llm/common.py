"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 512
#: Bits of a sieve at most, 8 MB; more ids let more others pass.
SIEVE_BITS = 1 << 26
#: What materialize has written and clear has not deleted.
_written: dict[str, DataFrame] = {}
#: Set once a session names no shared folder (tests, a laptop).
_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset and all tasks run on this machine, a local one."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="spark-shared-")
    return _own_dir


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage is cut and the rows outlive any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[path] = out
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    del _written[path]


def written() -> list[DataFrame]:
    """The tables of materialize that are there."""
    return list(_written.values())


def drop(*frames: DataFrame) -> None:
    """Delete what materialize has written for these frames; nothing may be left that would read them again."""
    for df in frames:
        for path in [p for p, f in _written.items() if f is df]:
            _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all that operators have written to the shared folder, once their results have been written or are no longer needed."""
    for path in list(_written):
        _delete(spark, path)


def text_bytes(docs: DataFrame) -> int:
    """The UTF-8 bytes of all texts, by which jobs choose how many parts they have."""
    return docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0


def small_batches(spark: SparkSession) -> None:
    """Let Python workers get few rows at a time: texts and sets of shingles are long, and an executor's memory has to hold a batch several times over."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of an id written as text; null ids give null."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def sieve(ids: DataFrame, rows: int) -> Callable[[Column], Column]:
    """A test for ids: true for all of `ids` (one column of longs, about `rows` of them), false for nearly all others.

    Tasks get it as a bit for each hash, so long rows that would have to be shuffled to meet `ids` can be told apart where they
    are read. What has to be exact is joined afterwards.
    """
    bits = min(SIEVE_BITS, 1 << max(15, (16 * max(rows, 1) - 1).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    # bitmaps of Spark count from 1 and have 32,768 bits each
    number = place(F.col(ids.columns[0])) + 1
    maps = ids.groupBy(F.bitmap_bucket_number(number).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bitmap"))
    held = np.zeros((bits >> 15, 4096), dtype=np.uint8)
    for row in maps.toLocalIterator():
        held[row["bucket"] - 1] = np.frombuffer(row["bitmap"], np.uint8)
    shared = ids.sparkSession.sparkContext.broadcast(held.reshape(-1))

    @F.pandas_udf("boolean")
    def passes(at: pd.Series) -> pd.Series:
        k = at.to_numpy()
        return pd.Series((shared.value[k >> 3] >> (k & 7).astype(np.uint8) & 1).astype(bool))

    return lambda c: passes(place(c))


def split_of(remainder: int, mod: int, column: str = "doc_id") -> Column:
    """True where crc32(id as text) mod `mod` is `remainder`; a null id is on no side, so false."""
    return F.coalesce(id_crc(column) % mod == remainder, F.lit(False))
