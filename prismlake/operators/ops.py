"""What keeps a library running: statistics, queues, diagnostics, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import extension, is_alert
from ..functions.times import effective_ts


def library_stats(media: DataFrame, albums: DataFrame, tags: DataFrame) -> DataFrame:
    """One row of counts. Raw files are photos."""
    one = media.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(F.col("media_type").isin("photo", "raw")).alias("photos"),
        F.count_if(F.col("media_type") == "video").alias("videos"),
        F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_bytes"),
        F.count_if(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).alias("geotagged"),
        F.count_if("is_favorite").alias("favorites"),
    )
    return one.crossJoin(albums.agg(F.count(F.lit(1)).alias("albums"))).crossJoin(tags.agg(F.count(F.lit(1)).alias("tags")))


def shares(stats: DataFrame) -> DataFrame:
    """Percentages of a row of statistics; 0 of nothing."""
    part = lambda c: F.when(F.col("total_files") > 0, F.round(100 * F.col(c) / F.col("total_files"), 2)).otherwise(0.0)
    return stats.select(part("photos").alias("photo_percent"), part("videos").alias("video_percent"), F.round(part("geotagged")).cast("long").alias("geotagged_percent"))


def counts(media: DataFrame, column: str) -> DataFrame:
    return media.groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def top_extensions(media: DataFrame, n: int = 8) -> DataFrame:
    """The most frequent extensions, ties by name; (none) where there is none."""
    ext = F.when(extension(F.col("file_name")) == "", "(none)").otherwise(extension(F.col("file_name")))
    return media.groupBy(ext.alias("extension")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "extension").limit(n)


def thumbnail_queue(media: DataFrame, n: int = 80) -> DataFrame:
    """The next previews to make: newest first, each hash once (its smallest id)."""
    waiting = media.filter(F.col("thumbnail_status") == "pending").select("id", "file_path", "file_hash", "media_type", effective_ts().alias("ts"))
    next_ = waiting.orderBy(F.desc("ts"), F.desc("id")).limit(n)
    first = F.row_number().over(Window.partitionBy("file_hash").orderBy("id"))
    return next_.withColumn("_k", first).filter("_k = 1").drop("_k")


def thumbnail_path(hash_: Column) -> Column:
    """Where a preview is kept: folders of two characters of the hash, 00 for shorter ones."""
    return F.concat(F.lit("thumbnails/"), F.when(F.length(hash_) >= 2, F.substring(hash_, 1, 2)).otherwise("00"), F.lit("/"), hash_, F.lit(".jpg"))


#: A preview of fewer bytes is none.
LEAST_PREVIEW_BYTES = 500


def cached_preview(hashes: DataFrame, cache: DataFrame) -> DataFrame:
    """file_hash and preview: the path of each hash's preview in the cache (path, bytes), jpg before webp; null if it has none."""
    jpg = thumbnail_path(F.col("file_hash"))
    wanted = F.array(jpg, F.regexp_replace(jpg, r"\.jpg$", ".webp"))
    each = hashes.select("file_hash").distinct().select("file_hash", F.posexplode(wanted).alias("turn", "path"))
    good = cache.filter(F.col("bytes") >= LEAST_PREVIEW_BYTES).select("path").distinct().withColumn("_there", F.lit(True))
    first = F.min_by(F.when(F.col("_there"), F.col("path")), F.when(F.col("_there"), F.col("turn")))
    return each.join(good, "path", "left").groupBy("file_hash").agg(first.alias("preview"))


def latest_libraries(counted: DataFrame) -> DataFrame:
    """Libraries in the order of lists: the last created first."""
    return counted.orderBy(F.desc("created_at"), F.desc("id"))


def heal_cache(media: DataFrame, cached: DataFrame) -> DataFrame:
    """Previews to make again: failed ones, and ready ones whose file (cached: file_hash, bytes; at least 500) is gone."""
    there = cached.filter(F.col("bytes") >= LEAST_PREVIEW_BYTES).select("file_hash").distinct().withColumn("_there", F.lit(True))
    again = (F.col("thumbnail_status") == "failed") | ((F.col("thumbnail_status") == "ready") & F.col("_there").isNull())
    return media.join(there, "file_hash", "left").withColumn("thumbnail_status", F.when(again, "pending").otherwise(F.col("thumbnail_status"))).select(*media.columns)


def spread_thumbnails(media: DataFrame, results: DataFrame) -> DataFrame:
    """Every file of a hash gets the hash's result (file_hash, ok)."""
    got = results.groupBy("file_hash").agg(F.max("ok").alias("_ok"))
    status = F.when(F.col("_ok"), "ready").when(~F.col("_ok"), "failed").otherwise(F.col("thumbnail_status"))
    return media.join(got, "file_hash", "left").withColumn("thumbnail_status", status).select(*media.columns)


def library_counts(libraries: DataFrame, media: DataFrame) -> DataFrame:
    """Every library with its number of files and a label of its state."""
    n = media.groupBy(F.col("library_id").alias("id")).agg(F.count(F.lit(1)).alias("total_files"))
    out = libraries.join(n, "id", "left").withColumn("total_files", F.coalesce("total_files", F.lit(0)))
    state = F.when(F.col("is_active"), "active").otherwise("inactive")
    return out.select("id", "path", "total_files", F.format_string("%s (%s, %d files)", "path", state, "total_files").alias("label"), "created_at")


def percent_done(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.greatest(F.round(100 * done / total), F.lit(0)), F.lit(100))).otherwise(0).cast("long")


def tail(lines: DataFrame, n: int = 200) -> DataFrame:
    """The last n lines (seq, line) of a log, in order."""
    return lines.orderBy(F.desc("seq")).limit(n).orderBy("seq")


def alerts(lines: DataFrame, n: int = 100) -> DataFrame:
    """The last n warnings and errors of a log, in order."""
    return tail(lines.filter(is_alert(F.col("line"))), n)
