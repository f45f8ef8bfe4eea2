"""A made-up library: three years, six cities, 25 photos and 5 films in each; four of the cities are on the map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: cities, and coordinates of those whose files have some
CITIES = (("San_Francisco", 37.7749, -122.4194), ("Los_Angeles", None, None), ("New_York", 40.7128, -74.006), ("London", 51.5074, -0.1278), ("Tokyo", None, None), ("Buenos_Aires", -34.6037, -58.3816))
YEARS, PHOTOS, FILMS = (2024, 2025, 2026), 25, 5


def library(spark: SparkSession) -> DataFrame:
    """The catalogue of the made-up library; every file is captured on 15 July of its year, within 0.025 degrees of its city."""
    each = PHOTOS + FILMS
    n = len(YEARS) * len(CITIES) * each
    cities = F.array(*[F.struct(F.lit(c).alias("name"), F.lit(a).cast("double").alias("lat"), F.lit(b).cast("double").alias("lon")) for c, a, b in CITIES])
    rows = spark.range(n).withColumns({"year": (F.lit(YEARS[0]) + F.floor(F.col("id") / (len(CITIES) * each))).cast("int"), "city": F.get(cities, (F.floor(F.col("id") / each) % len(CITIES)).cast("int")), "k": F.col("id") % each})
    film = F.col("k") >= PHOTOS
    number = F.when(film, (F.col("k") - PHOTOS + 1) * 5).otherwise(F.col("k") + 1)
    name = F.format_string("%s_%d_%03d.%s", F.when(film, "VID").otherwise("IMG"), F.col("year"), number, F.when(film, "mp4").otherwise("jpg"))
    directory = F.format_string("/library/%d/%s", F.col("year"), F.col("city.name"))
    shift = lambda seed: (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1000)) / 1000.0 - 0.5) * 0.05
    return rows.select(
        (F.col("id") + 1).alias("id"),
        F.lit(1).cast("long").alias("library_id"),
        F.concat(directory, F.lit("/"), name).alias("file_path"),
        directory.alias("directory"),
        name.alias("file_name"),
        F.when(film, 2048).otherwise(1024).cast("long").alias("file_size"),
        F.when(film, "video").otherwise("photo").alias("media_type"),
        F.substring(F.sha2(F.concat(directory, name), 256), 1, 16).alias("file_hash"),
        F.unix_millis(F.make_timestamp(F.col("year"), F.lit(7), F.lit(15), F.lit(14), F.lit(30), F.lit(0), F.lit("UTC"))).alias("captured_at"),
        F.lit(1_700_000_000_000).alias("file_modified_at"),
        F.lit(False).alias("is_favorite"),
        F.lit(0).alias("rating"),
        (F.col("city.lat") + shift(1)).alias("latitude"),
        (F.col("city.lon") + shift(2)).alias("longitude"),
    )
