"""Rescans by digests of folders: what has not changed is not compared file by file.

A folder's own digest is made of its files' paths, sizes and times, in no order: two 64-bit hashes of each file, added up by
exclusive or, and the number of files. Its tree digest is made in the same way of all files below it. Two trees are
compared from the top: a folder whose tree digests are equal is not gone into, whatever is below it. A digest is a row for each folder
and can be kept with a scan, so that the next one reads the old digests and not the old files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_folder
from .ingest import reconcile

#: Of a file: two hashes that have nothing to do with each other.
_HASHES = {"a": 1, "b": 2}
MOST_LEVELS = 64


def own_digests(files: DataFrame) -> DataFrame:
    """folder, files, a and b of each folder that has files itself. files: file_path, directory, file_size, file_modified_at."""
    of = {k: F.bit_xor(F.xxhash64(F.lit(seed), "file_path", "file_size", "file_modified_at")).alias(k) for k, seed in _HASHES.items()}
    return files.groupBy(F.coalesce("directory", F.lit("")).alias("folder")).agg(F.count(F.lit(1)).alias("files"), *of.values())


def tree_digests(files: DataFrame) -> DataFrame:
    """folder, parent (null at the top), depth, its own files, a and b (null without files), and all_files, all_a and all_b of its tree, of every folder and all above it."""
    own = own_digests(files)
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("folder"), (k - 1).alias("depth")))
    # files are added up by folder first: a row of each folder goes to those above it
    each = own.select(F.explode(above).alias("at"), "files", "a", "b", "folder").select("at.*", F.col("folder") == F.col("at.folder"), "files", "a", "b").toDF("folder", "depth", "is_own", "files", "a", "b")
    mine = lambda c: F.max(F.when(F.col("is_own"), F.col(c))).alias(c)
    sums = [mine("files"), mine("a"), mine("b"), F.sum("files").alias("all_files"), F.bit_xor("a").alias("all_a"), F.bit_xor("b").alias("all_b")]
    parent = F.when(F.col("depth") > 0, F.regexp_extract("folder", r"^(.*)/[^/]*$", 1))
    return each.groupBy("folder", "depth").agg(*sums).select("folder", parent.alias("parent"), "depth", "files", "a", "b", "all_files", "all_a", "all_b")


def visited(old: DataFrame, new: DataFrame) -> DataFrame:
    """folder and `changed` (whether files of its own have) of the folders that are gone into when two tables of tree_digests are compared from the top, level by level."""
    spark = old.sparkSession
    differ = lambda *columns: ~reduce(lambda x, y: x & y, [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in columns])
    level = old.filter("parent is null").select("folder").unionByName(new.filter("parent is null").select("folder")).distinct()
    found: list[DataFrame] = []
    for depth in range(MOST_LEVELS):
        both = level.join(old.filter(F.col("depth") == depth).alias("o"), "folder", "left").join(new.filter(F.col("depth") == depth).alias("n"), "folder", "left")
        rows = both.select("folder", differ("files", "a", "b").alias("changed"), differ("all_files", "all_a", "all_b").alias("below"))
        path = shared_folder(spark, f"visited{depth}")
        rows.write.parquet(path)
        rows = spark.read.schema(rows.schema).parquet(path)
        found.append(rows.select("folder", "changed"))
        into = rows.filter("below").select(F.col("folder").alias("parent"))
        if into.isEmpty():
            break
        children = lambda t: t.filter(F.col("depth") == depth + 1).join(into, "parent", "left_semi").select("folder")  # noqa: E731, B023
        level = children(old).unionByName(children(new)).distinct()
    return reduce(DataFrame.unionByName, found)


def reconcile_changed(stored: DataFrame, discovered: DataFrame, library_id: Column, old: DataFrame | None = None, new: DataFrame | None = None) -> DataFrame:
    """`ingest.reconcile`, but only the files of folders that have changed are compared; in others every stored file is kept, or fixed. `old` and `new` are the tree digests of both, if they are there."""
    where = lambda t: F.coalesce(t["directory"], F.lit("")).alias("folder")
    old, new = old if old is not None else tree_digests(stored), new if new is not None else tree_digests(discovered)
    touched = visited(old, new).filter("changed").select("folder")
    has = lambda t: t.withColumn("folder", where(t)).join(touched, "folder", "left_semi").drop("folder")
    compared = reconcile(has(stored), has(discovered), library_id)
    calm = stored.withColumn("folder", where(stored)).join(touched, "folder", "left_anti")
    fix = (F.col("library_id") != library_id) | (F.col("thumbnail_status") == "failed")
    return compared.unionByName(calm.select("file_path", "id", F.when(fix, "fix").otherwise("keep").alias("action")))
