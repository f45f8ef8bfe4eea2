"""What the plans look like: filters and columns that reach the scan, and how often rows are shuffled."""

import re

import pytest
from pyspark.sql import functions as F

from prismlake.operators import duplicates, search, spatial, timeline
from prismlake.sources.tables import Library


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    path = str(tmp_path_factory.mktemp("plans") / "media.parquet")
    Library(spark, sf_dir).media_files.write.parquet(path)
    return spark.read.parquet(path)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df) -> int:
    return len(re.findall(r"\bExchange ", plan(df)))


def read_columns(df) -> set[str]:
    return set(re.findall(r"(\w+):", re.search(r"ReadSchema: struct<(.*?)>", plan(df))[1]))


def test_filters_reach_the_scan(stored):
    f = search.Filter(media_type="photo", camera_make="Sony", min_rating=3, has_gps_only=True, limit=None)
    found = search.apply(stored, f).select("id")
    pushed = re.search(r"PushedFilters: \[(.*)\], ReadSchema", plan(found))[1]
    for part in ("In(media_type, [photo,raw])", "EqualTo(camera_make,Sony)", "GreaterThanOrEqual(rating,3)", "IsNotNull(latitude)"):
        assert part in pushed
    assert read_columns(found) == {"id", "media_type", "camera_make", "rating", "latitude", "longitude"} and shuffles(found) == 0


def test_boxes_reach_the_scan(stored):
    found = spatial.in_box(stored, spatial.Box(10, 20, 30, 40)).select("id")
    assert "GreaterThanOrEqual(latitude,10.0)" in plan(found) and "LessThanOrEqual(longitude,40.0)" in plan(found)
    assert read_columns(found) == {"id", "latitude", "longitude"}


def test_months_take_one_shuffle(stored):
    months = timeline.months(stored)
    assert shuffles(months) == 1 and read_columns(months) == {"id", "file_path", "file_hash", "captured_at", "file_modified_at"}


def test_copies_are_aggregated_before_they_move(stored):
    assert shuffles(duplicates.groups(stored)) == 1 == shuffles(duplicates.keepers(stored))
    assert "partial_max" in plan(duplicates.keepers(stored)) and "Window" not in plan(duplicates.keepers(stored))


def test_albums_are_a_semi_join(stored, spark):
    links = spark.range(100).select(F.lit(3).alias("album_id"), F.col("id").alias("media_id"))
    assert "LeftSemi" in plan(search.apply(stored, search.Filter(album_id=3), album_media=links))


def test_pages_are_a_top_k(stored):
    assert "TakeOrderedAndProject" in plan(search.page(stored, 100, 100))


def test_places_meet_points_without_a_product_of_rows(stored):
    text = plan(spatial.nearest_place(stored))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" in text  # one row: the table of places as an array
