"""The library over time: months, days, and this day in other years. Rows without any date are their own group of days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import day, effective_ts, in_utc, month
from .ordering import number


def months(media: DataFrame) -> DataFrame:
    """period, count and the cover of each month: the row of the largest id."""
    cover = F.max_by(F.struct("id", "file_path", "file_hash"), "id")
    out = media.groupBy(month(effective_ts()).alias("period")).agg(F.count(F.lit(1)).alias("count"), cover.alias("cover"))
    return out.select("period", "count", F.col("cover.id").alias("cover_id"), F.col("cover.file_path").alias("cover_file_path"), F.col("cover.file_hash").alias("cover_file_hash"))


def years(periods: DataFrame) -> DataFrame:
    """The years of the timeline and how many files each has."""
    return periods.groupBy(F.substring("period", 1, 4).alias("year")).agg(F.sum("count").alias("count"))


def days(media: DataFrame, zone: str = "UTC") -> DataFrame:
    """day, count, first_id and first_ts: the newest row (largest id of equal times) leads a day. A time of 0 counts as none."""
    ts = F.coalesce(F.nullif(F.col("captured_at"), F.lit(0)), F.nullif(F.col("file_modified_at"), F.lit(0)))
    lead = F.max(F.struct(F.coalesce("ts", F.lit(0)).alias("ts"), "id"))
    dated = media.select("id", ts.alias("ts"))
    out = dated.groupBy(F.coalesce(day(F.col("ts"), zone), F.lit("undated")).alias("day")).agg(F.count(F.lit(1)).alias("count"), lead.alias("lead"))
    return out.select("day", "count", F.col("lead.id").alias("first_id"), F.col("lead.ts").alias("first_ts"))


def latest_first(days_: DataFrame) -> DataFrame:
    """Days in the order of lists: by the time of what leads them, those without a date last."""
    return days_.orderBy(F.desc("first_ts"), F.desc("first_id"))


def of_period(media: DataFrame, prefix: str) -> DataFrame:
    """The rows of a year (2001) or a month (2001-07), by the start of their month in UTC."""
    return media.filter(month(effective_ts()).startswith(prefix))


def on_this_day_items(media: DataFrame, month_: int, day_: int, as_of_year: int) -> DataFrame:
    """What was captured on this day of earlier years, with its year."""
    taken = media.filter(in_utc(F.col("captured_at"), "MM-dd") == f"{month_:02d}-{day_:02d}")
    year = F.year(F.to_utc_timestamp(F.timestamp_millis("captured_at"), F.current_timezone())).cast("long")
    return taken.withColumn("year", year).filter(F.col("year") < as_of_year)


def on_this_day(media: DataFrame, month_: int, day_: int, as_of_year: int) -> DataFrame:
    """year, years_ago, count and cover_id of each earlier year with something of this day.

    The cover is the first favourite, else the first, of the newest first (equal times by the smaller id).
    """
    taken = on_this_day_items(media, month_, day_, as_of_year)
    lead = F.struct(F.when(F.col("is_favorite"), 0).otherwise(1).alias("plain"), (-F.col("captured_at")).alias("age"), "id")
    out = taken.groupBy("year").agg(F.count(F.lit(1)).alias("count"), F.min(lead).alias("lead"))
    return out.select("year", (F.lit(as_of_year) - F.col("year")).alias("years_ago"), "count", F.col("lead.id").alias("cover_id"))


HOUR_MS = 3_600_000


def positions(media: DataFrame) -> DataFrame:
    """Each file's period and its number in it (`position`), newest first (the larger id of equal times), from 0; hour by hour."""
    ts = effective_ts()
    dated = media.withColumn("period", month(ts))
    return number(dated, [F.col("period")], F.floor(ts / HOUR_MS), [ts.desc_nulls_last(), F.desc("id")], "position", descending=True)
