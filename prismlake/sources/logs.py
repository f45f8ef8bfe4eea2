"""Log files as numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str) -> DataFrame:
    """seq and line of a log: seq rises with the place in the file (files in the order of their names), without being gapless.

    Tasks get files by size, not by name, and a long file in pieces, so a row's place is its file, its piece of it and its
    number in the task, which reads a piece from its start to its end.
    """
    seq = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("piece"), F.monotonically_increasing_id().alias("row"))
    return spark.read.text(path).select(seq.alias("seq"), F.col("value").alias("line"))


def write(lines: DataFrame, path: str) -> None:
    """The lines in order, as text."""
    lines.orderBy("seq").select("line").write.mode("overwrite").text(path)
