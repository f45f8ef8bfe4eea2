"""Points by a space-filling curve: against scans, and how little a box reads."""

import random
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from prismlake.functions.geo import haversine_km
from prismlake.operators import point_index, spatial
from prismlake.operators.point_index import BITS, PointIndex, curve, place, ranges
from prismlake.operators.spatial import Box

COLUMNS = ["id", "latitude", "longitude", "file_hash", "media_type", "captured_at", "is_favorite", "rating"]


def points(spark, n):
    """Clusters around some towns, and points everywhere; some without coordinates, some on edges."""
    h = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1_000_003)) / 1_000_003.0
    town = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(12))
    anywhere = F.col("id") % 3 == 0
    lat = F.when(anywhere, h(1) * 180 - 90).otherwise(h(1) * 0.5 - 60 + town * 10)
    lon = F.when(anywhere, h(2) * 360 - 180).otherwise(h(2) * 0.5 - 170 + town * 28)
    lat = F.when(F.col("id") % 50 == 7, F.lit(90.0)).when(F.col("id") % 50 == 8, F.lit(-90.0)).otherwise(lat)
    lon = F.when(F.col("id") % 60 == 7, F.lit(180.0)).when(F.col("id") % 60 == 8, F.lit(-180.0)).when(F.col("id") % 11 != 5, lon)
    return spark.range(n).select("id", lat.alias("latitude"), lon.alias("longitude"), F.md5(F.col("id").cast("string")).alias("file_hash"), F.lit("photo").alias("media_type"), F.lit(1).cast("long").alias("captured_at"), F.lit(False).alias("is_favorite"), F.lit(0).alias("rating"))


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    out = PointIndex(spark, str(tmp_path_factory.mktemp("points") / "p"), rows_a_file=40_000, group_bytes=64 << 10)
    out.add(points(spark, 300_000))
    return out


def test_curve_is_one_way_through_all_cells(monkeypatch):
    monkeypatch.setattr(point_index, "BITS", 4)
    at = {place(x, y): (x, y) for x in range(16) for y in range(16)}
    assert sorted(at) == list(range(256))
    assert all(abs(at[d][0] - at[d + 1][0]) + abs(at[d][1] - at[d + 1][1]) == 1 for d in range(255))


def test_curve_of_columns(spark):
    rng, n = random.Random(2), 1 << BITS
    rows = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(300)] + [(90.0, 180.0), (-90.0, -180.0), (0.0, 0.0)]
    got = spark.createDataFrame([*rows, (None, 1.0), (1.0, None)], "latitude double, longitude double").select(curve(F.col("latitude"), F.col("longitude")).alias("d")).collect()
    cell = lambda v, low, span: min(n - 1, int((v - low) / span * n))
    assert [r["d"] for r in got] == [place(cell(lon, -180, 360), cell(lat, -90, 180)) for lat, lon in rows] + [None, None]


def test_ranges_hold_the_box(monkeypatch):
    monkeypatch.setattr(point_index, "BITS", 6)
    rng = random.Random(3)
    for _ in range(150):
        box = Box(rng.uniform(-95, 95), rng.uniform(-95, 95), rng.uniform(-180, 180), rng.uniform(-180, 180))
        for most in (1, 4, 64):
            found = ranges(box, most)
            assert len(found) <= most and all(a <= b for a, b in found) and all(a[1] < b[0] for a, b in zip(found, found[1:], strict=False))
            cells = {place(x, y) for x0, y0, x1, y1 in point_index._corners(box) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)}
            inside = sum(b - a + 1 for a, b in found)
            assert all(any(a <= c <= b for a, b in found) for c in cells)
            assert most < 64 or inside <= 1.5 * len(cells) + 64


BOXES = [Box(10, 20, 30, 40), Box(20, 10, 30, 40), Box(-90, 90, -180, 180), Box(-95, -89.9, -180, 180), Box(-30, 30, 170, -170), Box(-60, -59.5, -170, -169.5), Box(5, 5, 5, 5), Box(-10, 10, 179.99, 180), Box(90, 90, -180, 180), Box(0, 1, -200, -179)]


@pytest.mark.parametrize("box", BOXES)
def test_equal_to_a_scan(spark, index, box):
    want = sorted(tuple(r) for r in spatial.in_box(points(spark, 300_000), box).collect())
    assert sorted(tuple(r) for r in index.in_box(box).collect()) == want and index.in_box(box).columns == COLUMNS
    assert [r["id"] for r in index.in_box(box, 7).collect()] == [w[0] for w in want[:7]]


def groups(index):
    """Least and greatest place, and bytes, of each row group."""
    out = []
    for f in Path(index.folder).glob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        at = meta.schema.names.index("curve")
        out += [(meta.row_group(k).column(at).statistics.min, meta.row_group(k).column(at).statistics.max, meta.row_group(k).total_byte_size) for k in range(meta.num_row_groups)]
    return out


def test_a_box_reads_few_row_groups(spark, index):
    """Boxes of a hundredth of the globe, and of one town."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "20000")
    told = groups(index)
    assert len(told) > 100
    for box in (Box(0, 18, 40, 76), Box(-60, -59.5, -170, -169.5), Box(-9, 9, 171, -173)):
        hit = [b for low, high, b in told if any(low <= last and high >= first for first, last in ranges(box))]
        assert 0 < len(hit) < 0.1 * len(told) and sum(hit) < 0.1 * sum(b for *_, b in told)
        text = index.in_box(box)._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [" in text and "GreaterThanOrEqual(curve," in text


def test_rows_that_come_later(spark, tmp_path):
    index = PointIndex(spark, str(tmp_path / "a"), rows_a_file=1000)
    media = points(spark, 3000)
    index.add(media.filter("id < 2000"))
    index.add(media.filter("id >= 2000"))
    again = index.rewrite(str(tmp_path / "b"))
    want = {r["id"] for r in spatial.in_box(media, BOXES[0]).collect()}
    assert want and {r["id"] for r in index.in_box(BOXES[0]).collect()} == want == {r["id"] for r in again.in_box(BOXES[0]).collect()}
    index.add(media.limit(0))
    assert index.points().count() == media.filter("longitude is not null").count() == again.points().count()


@pytest.mark.parametrize("lat, lon, km", [(0.0, 0.0, 500), (-59.8, -169.8, 30), (10.0, 179.9, 800), (-5.0, -179.5, 900), (88.0, 20.0, 400), (-89.9, 0.0, 50), (20.0, 20.0, 12_000)])
def test_around_a_point(spark, index, lat, lon, km):
    media = points(spark, 300_000).filter("latitude is not null and longitude is not null")
    away = haversine_km(F.col("latitude"), F.col("longitude"), F.lit(lat), F.lit(lon))
    want = {r["id"] for r in media.filter(away <= km).select("id").collect()}
    got = [(r["km"], r["id"]) for r in index.nearest(lat, lon, km).collect()]
    assert {i for _, i in got} == want and got == sorted(got)
