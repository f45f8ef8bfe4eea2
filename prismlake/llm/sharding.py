"""Shards of near equal size by sampled splitters, with DataFrame functions only.

Records are ordered by a hash of their text, then by a hash of their id, so that equal texts are neighbours. Splitters
drawn with size as weight cut that order into ranges (ranges.py), overfull ones are subdivided, and exact sums over the
ranges turn every record's place in its range into its place in the whole. Shard k takes the places whose middle lies in
the k-th equal part of all bytes. A group of equal texts of at most TOGETHER of a shard moves as one; a larger one is split
where the boundary falls.

Defined cases: a null text counts as empty (no bytes, crc32 0); a null id is ordered as an empty one; repeated rows take a
slot each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import ranges
from .common import materialize

#: Bytes that every record takes besides its text.
RECORD_BYTES = 8
RANGES_A_SHARD = 16
TOGETHER = 0.02


def shard(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of `docs` (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + RECORD_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        ranges.hash52(text).alias("key"),
        ranges.hash52(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("second"),
    )
    slim = materialize(slim, "sizes")
    sums = slim.agg(F.sum("size").alias("t"), F.count(F.lit(1)).alias("n")).first()
    total, n = sums["t"] or 0, sums["n"]
    # a range is also even in rows: a text that many share may be short
    weighed = slim.withColumn("weight", F.col("size") + (total // n if n else 0))
    placed, cells = ranges.cut(weighed, "key", "second", "weight", total + n * (total // n if n else 0), shards * RANGES_A_SHARD, ["doc_id", "key"], "size")
    weight, count = cells.before(F.col("cell"))
    # both windows are over parts of a cell, so one exchange serves them
    in_cell = Window.partitionBy("cell").orderBy("key", "second", "doc_id")
    group = Window.partitionBy("cell", "key")
    so_far = F.sum("size").over(in_cell.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = placed.withColumns({"end": weight + so_far, "rank": count + F.row_number().over(in_cell) - 1})
    whole, stop = cells.group(F.col("cell"))
    ranked = ranked.withColumns({"group_size": F.coalesce(whole, F.sum("size").over(group)), "group_end": F.coalesce(stop, F.max("end").over(group))})
    part = total / shards if total else 1.0
    middle = F.when(F.col("group_size") <= TOGETHER * part, F.col("group_end") - F.col("group_size") / 2).otherwise(F.col("end") - F.col("size") / 2)
    ranked = ranked.withColumn("shard", F.least(F.floor(middle / part), F.lit(shards - 1)).cast("int"))
    # a group that moves as one may begin cells before the boundary, so a shard's first row is looked for among all
    firsts = {r["shard"]: r["rank"] for r in ranked.groupBy("shard").agg(F.min("rank").alias("rank")).collect()}
    start = F.get(F.array(*[F.lit(firsts.get(k, 0)).cast("long") for k in range(shards)]), F.col("shard"))
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - start).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
