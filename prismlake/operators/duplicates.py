"""Exact copies: groups of equal hashes, which copy to keep, and what the others take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import number

KEY = ["file_hash", "file_size"]


def members(media: DataFrame, min_size: int | None = None, media_type: str | None = None) -> DataFrame:
    """All rows of the hashes that more than one row of at least this size and of exactly this type has."""
    chosen = media
    if min_size is not None:
        chosen = chosen.filter(F.col("file_size") >= min_size)
    if media_type is not None:
        chosen = chosen.filter(F.col("media_type") == media_type)
    hashes = chosen.groupBy("file_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("file_hash")
    return media.join(hashes, "file_hash", "left_semi")


def groups(media: DataFrame, min_size: int | None = None, media_type: str | None = None) -> DataFrame:
    """file_hash, file_size, count, total_size_bytes and first_id (the smallest) of each group of two or more.

    Rows of one hash that differ in size are different groups. What is in a group is told by `items`: a group has any
    number of rows, so it is no array.
    """
    # without filters the count of a group says it all
    found = media if min_size is None and media_type is None else members(media, min_size, media_type)
    sums = found.groupBy(*KEY).agg(F.count(F.lit(1)).alias("count"), F.sum("file_size").alias("total_size_bytes"), F.min("id").alias("first_id"))
    return sums.filter("count > 1")


def largest_first(groups_: DataFrame) -> DataFrame:
    """Groups in the order of lists: by all their bytes; of equal ones by the smallest id."""
    return groups_.orderBy(F.desc("total_size_bytes"), "first_id")


def items(groups_: DataFrame, media: DataFrame) -> DataFrame:
    """The rows of groups."""
    return media.join(groups_.select(*KEY), KEY, "left_semi")


#: Ids that are put in order together.
ID_SLICE = 100_000


def items_in_order(groups_: DataFrame, media: DataFrame) -> DataFrame:
    """The rows of groups with `total_size_bytes` and `first_id` of the group and `position`, the row's place in it by id, from 0: so lists of groups, and each group from any place on, are an order by (total_size_bytes desc, first_id, position)."""
    rows = media.join(groups_.select(*KEY, "total_size_bytes", "first_id"), KEY)
    return number(rows, [F.col(k) for k in KEY], F.floor(F.col("id") / ID_SLICE), [F.col("id")], "position")


def keeper_score(name: Column, path: Column) -> Column:
    """How much speaks for a copy being the original."""
    n, p = F.lower(name), F.lower(path)
    minus = lambda test, points: F.when(test, -points).otherwise(0)
    plus = lambda test, points: F.when(test, points).otherwise(0)
    score = F.lit(100) + minus(n.rlike(r"\([0-9]+\)"), 45) + minus(n.contains("-edited"), 35) + minus(n.contains("copy") | n.contains("copia"), 30)
    score = score + minus(p.contains("takeout"), 25) + minus(p.contains("export") | p.contains("temp") | p.contains("backup"), 20)
    score = score + plus(F.col("latitude").isNotNull(), 30) + plus(F.col("captured_at").isNotNull(), 20) + plus(F.col("camera_make").isNotNull(), 15)
    return score + plus(F.col("is_favorite"), 50) + F.greatest(F.coalesce(F.col("rating"), F.lit(0)), F.lit(0)) * 10


def keepers(media: DataFrame) -> DataFrame:
    """file_hash, file_size, keeper_id, score and count of each group: the row of the highest score (ties to the smaller id) is kept."""
    scored = media.select("id", *KEY, keeper_score(F.col("file_name"), F.col("file_path")).cast("long").alias("score"))
    best = scored.groupBy(*KEY).agg(F.max(F.struct("score", (-F.col("id")).alias("order"))).alias("best"), F.count(F.lit(1)).alias("count"))
    return best.filter("count > 1").select(*KEY, (-F.col("best.order")).alias("keeper_id"), F.col("best.score").alias("score"), "count")


def redundant(media: DataFrame) -> DataFrame:
    """The copies that are not kept."""
    return media.join(keepers(media).select(*KEY, "keeper_id"), KEY).filter("id <> keeper_id").select("id", "file_hash", "keeper_id")


def wasted(media: DataFrame) -> DataFrame:
    """One row: groups, copies beyond the kept ones, and the bytes that these take."""
    per = groups(media).select((F.col("count") - 1).alias("extra"), (F.col("file_size") * (F.col("count") - 1)).alias("bytes"))
    return per.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("extra"), F.lit(0)).alias("extra_files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("wasted_bytes"))


def extra_files(media: DataFrame) -> DataFrame:
    """One row: how many files are copies of a hash that is there already."""
    return media.agg((F.count("file_hash") - F.count_distinct("file_hash")).alias("extra_files"))


def naming(groups_: DataFrame, media: DataFrame, q: str) -> DataFrame:
    """The groups of which an item has the text in its name or path, whatever its case."""
    q = q.strip().lower()
    if not q:
        return groups_
    named = media.filter(F.lower("file_name").contains(q) | F.lower("file_path").contains(q)).select("file_hash", "file_size")
    return groups_.join(named, KEY, "left_semi")
