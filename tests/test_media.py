"""Operators on small tables of our own."""

import datetime as dt
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from prismlake.functions import dates, geo, text, times, vectors
from prismlake.operators import curation, duplicates, ingest, ops, people, search, spatial, timeline
from prismlake.sources import places
from prismlake.streaming import file_events, progress, windows

MEDIA = "id long, library_id long, file_path string, directory string, file_name string, file_size long, file_modified_at long, file_hash string, media_type string, orientation int, captured_at long, latitude double, longitude double, camera_make string, thumbnail_status string, is_favorite boolean, rating int, face_scanned boolean"


def row(id_, name="a.jpg", **more):
    base = dict(id=id_, library_id=1, directory="/lib", file_name=name, file_size=1024, file_modified_at=1_700_000_000_000, file_hash=f"h{id_}", media_type="photo", orientation=1, captured_at=None, latitude=None, longitude=None, camera_make="Sony", thumbnail_status="ready", is_favorite=False, rating=0, face_scanned=False)
    base |= more
    return base | {"file_path": more.get("file_path", f"{base['directory']}/{name}")}


@pytest.fixture
def media(spark):
    names = [c.split()[0] for c in MEDIA.split(", ")]
    return lambda *rows: spark.createDataFrame([tuple(r[n] for n in names) for r in rows], MEDIA)


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


def ms(*parts):
    return int(dt.datetime(*parts, tzinfo=dt.timezone.utc).timestamp() * 1000)


@pytest.mark.parametrize(
    "name, want",
    [
        ("WhatsApp Image 2023-05-14 at 15.23.45.jpeg", ms(2023, 5, 14, 15, 23, 45)),
        ("IMG_20230514_152345.jpg", ms(2023, 5, 14, 15, 23, 45)),
        ("PXL_20230514_152345123.jpg", ms(2023, 5, 14, 15, 23, 45)),
        ("Screenshot_2023-05-14-15-23-45.png", ms(2023, 5, 14, 15, 23, 45)),
        ("IMG-20230514-WA0001.jpg", ms(2023, 5, 14, 12)),
        ("2023-05-14.jpg", ms(2023, 5, 14, 12)),
        ("Screenshot_20230514.png", ms(2023, 5, 14, 12)),
        ("FB_IMG_1426625621638.jpg", 1426625621638),
        ("Note_261213_194757.jpg", ms(2013, 12, 26, 19, 47, 57)),
        ("IMG_20230231_101010.jpg", None),
        ("IMG_18990101_101010.jpg", None),
        ("IMG_20230514_259999.jpg", ms(2023, 5, 14, 23, 59, 59)),
        ("holiday.jpg", None),
        (None, None),
        ("", None),
    ],
)
def test_dates_of_names(spark, name, want):
    assert one(spark, name, lambda c: dates.from_name(c, 2026)) == want


@pytest.mark.parametrize(
    "value, want",
    [
        ("2023:05:14 15:23:45\x00", ms(2023, 5, 14, 15, 23, 45)),
        (" 2023-05-14T15:23:45Z", ms(2023, 5, 14, 15, 23, 45)),
        ("2023:05:14 15:23:45+02:00", ms(2023, 5, 14, 13, 23, 45)),
        ("2023:05:14 15:23:45.250", ms(2023, 5, 14, 15, 23, 45) + 250),
        ("2023/05/14 15:23:45", ms(2023, 5, 14, 15, 23, 45)),
        ("2023:05:14", ms(2023, 5, 14, 12)),
        ("1890:05:14 00:00:00", None),
        ("0000:00:00 00:00:00", None),
        ("", None),
        ("junk", None),
        (None, None),
    ],
)
def test_dates_of_cameras(spark, value, want):
    assert one(spark, value, dates.from_camera) == want


def test_local_times_of_cameras(spark):
    want = {
        "2023:08:15 14:30:00\x00 ": "2023-08-15 14:30:00",
        "2023-08-15T14:30:00+02:00": "2023-08-15T14:30:00+02:00",
        "2023:08:15 14:30:00 -05:30": "2023-08-15T14:30:00-05:30",
        "2023-08-15T14:30:00Z": "2023-08-15T14:30:00+00:00",
        "2023-08-15T14:30:00.5+02:00": "2023-08-15T14:30:00.500+02:00",
        "2023:08:15 14:30:00.123": "2023-08-15 14:30:00.123",
        "2023:08:15 14:30:00.1234": "2023-08-15 14:30:00.123400",
        "2023-08-15 23:59:59.1234567": "2023-08-15 23:59:59.123456700",
        "2023:08:15 14:30:00.000": "2023-08-15 14:30:00",
        "2023/08/15": "2023-08-15 12:00:00",
        "1969:12:31 23:00:00": None,
        "not a date": None,
        "": None,
    }
    rows = spark.createDataFrame([(k,) for k in want], "x string").select("x", dates.local_text(F.col("x")).alias("y")).collect()
    assert {r["x"]: r["y"] for r in rows} == want


def test_sidecar(spark, media):
    good = '{"photoTakenTime": {"timestamp": "1684077825"}}'
    assert one(spark, good, lambda c: dates.from_sidecar(c, 2026)) == 1684077825000
    assert one(spark, '{"creationTime": {"timestamp": "1"}}', lambda c: dates.from_sidecar(c, 2026)) is None
    rows = media(row(1, "IMG_20230514_152345.jpg"), row(2, "b.jpg"), row(3, "c.jpg"), row(4, "d.jpg", captured_at=5))
    cars = spark.createDataFrame([("/lib/b.jpg", good)], "file_path string, json string")
    got = {r["id"]: r["captured_at"] for r in ingest.repair_dates(rows, 2026, cars).collect()}
    assert got == {1: ms(2023, 5, 14, 15, 23, 45), 2: 1684077825000, 3: None, 4: 5}
    listing = spark.createDataFrame([("/lib/b.jpg.json",), ("/lib/b.json",), ("/lib/c.json",)], "path string")
    assert {tuple(r) for r in ingest.sidecar_of(rows, listing).collect()} == {("/lib/b.jpg", "/lib/b.jpg.json"), ("/lib/c.jpg", "/lib/c.json")}


@pytest.mark.parametrize("s, want", [("+34.0522-118.2437/", (34.0522, -118.2437)), ("+51.5074-000.1278+015.000/", (51.5074, -0.1278)), ("junk", None), ("", None), (None, None)])
def test_iso6709(spark, s, want):
    lat, lon = (one(spark, s, lambda c, k=k: geo.iso6709(c)[k]) for k in (0, 1))
    assert (lat, lon) == (want or (None, None))


def test_geohash_and_places(spark, media):
    rows = media(row(1, latitude=37.7749, longitude=-122.4194), row(2, latitude=51.5074, longitude=-0.1278), row(3, latitude=0.0, longitude=-160.0), row(4), row(5, latitude=90.0, longitude=180.0))
    hashes = {r[0]: r[1] for r in rows.select("id", geo.geohash(F.col("latitude"), F.col("longitude"))).collect()}
    assert hashes[1].startswith("9q8") and hashes[2].startswith("gcp") and hashes[4] is None and hashes[5] == "zzzzzzz"
    places = {r["id"]: r["place"] for r in spatial.nearest_place(rows).collect()}
    assert places == {1: "San Francisco, United States", 2: "London, United Kingdom", 3: None, 5: None}
    for name, want in (("San Francisco", {1}), ("united kingdom", {2}), ("zz", set())):
        assert {r["id"] for r in search.apply(rows, search.Filter(text=name)).collect()} == want


def test_boxes(media):
    rows = media(row(1, latitude=37.7749, longitude=-122.4194), row(2, latitude=34.0, longitude=-118.2), row(3), row(4, latitude=1.0, longitude=179.5), row(5, latitude=1.0, longitude=-179.5))
    ids = lambda *box: {r["id"] for r in spatial.in_box(rows, spatial.Box(*box)).collect()}
    assert ids(37, 38, -123, -122) == {1} == ids(38, 37, -123, -122)
    assert ids(-10, 10, 170, -170) == {4, 5}
    assert ids(-90, 90, -180, 180) == {1, 2, 4, 5}
    assert ids(37.7749, 37.7749, -122.4194, -122.4194) == {1}
    assert [r["id"] for r in spatial.in_box(rows, spatial.Box(-90, 90, -180, 180), 2).collect()] == [1, 2]


def test_clusters_split(media):
    rows = media(row(1, latitude=10.0, longitude=10.0), row(2, latitude=10.001, longitude=10.001), row(3, latitude=-40.0, longitude=100.0), row(4, latitude=90.0, longitude=0.0))
    found = sorted(tuple(r) for r in spatial.clusters(rows, 2).select("count", "first_id").collect())
    assert found == [(1, 3), (1, 4), (2, 1)]
    deep = [r["expansion_zoom"] for r in spatial.expansion_zoom(rows, 2).collect()]
    assert len(deep) == 1 and 10 < deep[0] <= spatial.MAX_ZOOM


def test_timeline(media):
    rows = media(row(1, captured_at=1784073600000), row(2, captured_at=1784073601000), row(3, captured_at=1786752000000), row(4, captured_at=0, file_modified_at=0))
    got = {r["period"]: (r["count"], r["cover_id"]) for r in timeline.months(rows).collect()}
    assert got == {"2026-07": (2, 2), "2026-08": (1, 3), "1970-01": (1, 4)}
    assert {r["day"] for r in timeline.days(rows).collect()} == {"2026-07-15", "2026-08-15", "undated"}
    assert {r["day"] for r in timeline.days(rows, "Pacific/Auckland").collect()} >= {"2026-07-15"}


def test_memories(media):
    rows = media(row(1, captured_at=ms(2023, 11, 11, 8)), row(2, captured_at=ms(2023, 11, 11, 9)), row(3, captured_at=ms(2022, 11, 11, 9), is_favorite=True), row(4, captured_at=ms(2022, 11, 11, 10)), row(5, captured_at=ms(2024, 11, 11)), row(6, captured_at=ms(2023, 11, 12)))
    got = {r["year"]: (r["years_ago"], r["count"], r["cover_id"]) for r in timeline.on_this_day(rows, 11, 11, 2024).collect()}
    assert got == {2023: (1, 2, 2), 2022: (2, 2, 3)}
    assert {r["id"] for r in timeline.on_this_day_items(rows, 11, 11, 2024).collect()} == {1, 2, 3, 4}


def test_presets():
    as_of = dt.date(2024, 3, 1)
    assert times.preset("this_year", as_of) == (ms(2024, 1, 1), ms(2025, 1, 1) - 1)
    assert times.preset("last_30_days", as_of) == (ms(2024, 1, 31), None)
    assert times.month_bounds("2023-12") == (ms(2023, 12, 1), ms(2024, 1, 1) - 1)


def test_sorting_and_stats(spark, media):
    rows = media(row(1, "aaa_first.jpg", file_size=1000, rating=2), row(2, "zzz_second.mp4", file_size=5000, rating=5, media_type="video", latitude=1.0, longitude=1.0), row(3, "MMM_capital.jpg", file_size=2000, media_type="raw"))
    ids = lambda **f: [r["id"] for r in search.search(rows, search.Filter(**f)).collect()]
    assert ids(sort_by="name", descending=False) == [1, 3, 2] and ids(sort_by="name") == [2, 3, 1]
    assert ids(sort_by="size") == [2, 3, 1] and ids(sort_by="rating", descending=False) == [3, 1, 2]
    assert ids(sort_by="nothing", descending=False) == [3, 2, 1]
    assert ids(media_type="photo") == [3, 1] and ids(text="mmm\\") == [] and ids(text="_") == [3, 2, 1]
    stats = ops.library_stats(rows, spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([], "id long")).first().asDict()
    assert stats == {"total_files": 3, "photos": 2, "videos": 1, "total_bytes": 8000, "geotagged": 1, "favorites": 0, "albums": 1, "tags": 0}
    empty = ops.library_stats(rows.limit(0), rows.limit(0), rows.limit(0))
    assert empty.first()["total_bytes"] == 0 and ops.shares(empty).first()["photo_percent"] == 0.0


def test_duplicates(media):
    rows = media(row(1, "x copy.jpg", file_hash="h"), row(2, "x.jpg", file_hash="h"), row(3, "x(1).jpg", file_hash="h", is_favorite=True), row(4, file_hash="u"), row(5, "t.jpg", file_hash="h", file_size=9))
    assert [tuple(r) for r in duplicates.groups(rows).collect()] == [("h", 1024, 3, 3072, 1)]
    assert {r["id"] for r in duplicates.items(duplicates.groups(rows), rows).collect()} == {1, 2, 3}
    assert duplicates.keepers(rows).first()["keeper_id"] == 3
    assert {r["id"] for r in duplicates.redundant(rows).collect()} == {1, 2}
    assert duplicates.wasted(rows).first().asDict() == {"groups": 1, "extra_files": 2, "wasted_bytes": 2048}
    assert duplicates.wasted(rows.limit(0)).first().asDict() == {"groups": 0, "extra_files": 0, "wasted_bytes": 0}


def test_albums(spark, media):
    albums = spark.createDataFrame([(1, "a", None, None, 1), (2, "b", None, 7, 2)], "id long, name string, description string, cover_media_id long, created_at long")
    links = spark.createDataFrame([(2, 7, 1), (2, 8, 5), (2, 9, 5)], "album_id long, media_id long, added_at long")
    covered, more = curation.add_to_album(albums, links, 1, [4, 5, 4], 9)
    assert {r["id"]: r["cover_media_id"] for r in covered.collect()} == {1: 4, 2: 7} and more.count() == 5
    assert curation.add_to_album(albums, links, 2, [7], 9)[1].count() == 3
    gone = spark.createDataFrame([(2, 7)], "album_id long, media_id long")
    assert {r["id"]: r["cover_media_id"] for r in curation.remove_from_album(albums, links, gone)[0].collect()} == {1: None, 2: 9}
    with pytest.raises(ValueError, match="there is an album"):
        curation.create_album(albums, 3, "a", None, 1)
    changed = curation.update_album(albums, 2, "c", "d", None)
    assert changed.filter("id = 2").select("name", "description", "cover_media_id").first() == ("c", "d", 7)
    counted = curation.albums(albums, links, media(row(7))).orderBy("id").collect()
    assert [(r["media_count"], r["cover_file_path"]) for r in counted] == [(0, None), (3, "/lib/a.jpg")]


def test_adding_to_an_album_compares_its_own_links_only(spark, tmp_path):
    spark.createDataFrame([(a, m, 5) for a in range(20) for m in range(10)], "album_id long, media_id long, added_at long").write.parquet(str(tmp_path / "links"))
    links = spark.read.parquet(str(tmp_path / "links"))
    added = curation.add_to_album(spark.createDataFrame([(3, None)], "id long, cover_media_id long"), links, 3, [9, 10, 11, 10], 7)[1]
    assert sorted((r["album_id"], r["media_id"], r["added_at"]) for r in added.exceptAll(links).collect()) == [(3, 10, 7), (3, 11, 7)]
    assert "EqualTo(album_id,3)" in added._jdf.queryExecution().executedPlan().toString()


def test_tags(spark):
    tags = spark.createDataFrame([(1, "sun", "#111111")], "id long, name string, color string")
    again = curation.upsert_tag(tags, 2, "sun")
    assert [tuple(r) for r in again.collect()] == [(1, "sun", "#111111")]
    assert [tuple(r) for r in curation.upsert_tag(tags, 2, "sun", "#222222").collect()] == [(1, "sun", "#222222")]
    assert sorted(tuple(r) for r in curation.upsert_tag(tags, 2, "sea").collect()) == [(1, "sun", "#111111"), (2, "sea", curation.TAG_COLOR)]


def test_upsert_and_reconcile(spark, media):
    stored = media(row(1, "a.jpg", orientation=6, rating=4), row(2, "b.jpg", orientation=6), row(3, "c.jpg", thumbnail_status="failed"))
    new = media(row(11, "a.jpg", file_hash="h1", rating=0, orientation=1), row(12, "b.jpg", file_hash="other"), row(13, "d.jpg"), row(14, "d.jpg", file_size=7), row(15, "c.jpg", file_hash="h3"))
    got = {r["file_name"]: (r["id"], r["orientation"], r["rating"], r["thumbnail_status"], r["file_size"]) for r in ingest.upsert(stored, new).collect()}
    assert got == {"a.jpg": (1, 6, 4, "ready", 1024), "b.jpg": (2, 1, 0, "pending", 1024), "c.jpg": (3, 1, 0, "pending", 1024), "d.jpg": (14, 1, 0, "ready", 7)}
    found = spark.createDataFrame([("/lib/a.jpg", 1024, 1_700_000_000_000), ("/lib/b.jpg", 1, 1_700_000_000_000), ("/lib/e.jpg", 5, 5), ("/lib/e.jpg", 5, 5)], "file_path string, file_size long, file_modified_at long")
    acts = {r["file_path"][5:]: r["action"] for r in ingest.reconcile(stored, found, F.lit(1)).collect()}
    assert acts == {"a.jpg": "keep", "b.jpg": "extract", "c.jpg": "remove", "e.jpg": "add"}


def test_names(spark):
    flags = lambda *names: [r[0] for r in spark.createDataFrame([(n,) for n in names], "p string").select(ingest.ignored_path(F.col("p"))).collect()]
    assert flags("/a/._x.jpg", "/a/@eaDir/x.jpg", "/#recycle/x.jpg", "/a/b.lrdata/x", "/My Pictures/x.jpg") == [True] * 5
    assert flags("/a/x.jpg", "/./a/../x.jpg", "/a/_DSC1.jpg") == [False] * 3
    kinds = [tuple(r) for r in spark.createDataFrame([("A.JPG",), ("b.cr3",), (".jpg",), ("x",)], "n string").select(*ingest.classify(F.col("n"))).collect()]
    assert kinds == [("photo", "image/jpeg"), ("raw", "image/x-canon-cr2"), ("photo", "application/octet-stream"), ("photo", "application/octet-stream")]
    assert one(spark, 'x"', text.clean_path) == "x" and one(spark, "\\\\?\\C:\\a\\", text.clean_path) == "C:\\a" and one(spark, "/", text.clean_path) == "/"
    assert one(spark, 3 * (1 << 40), text.byte_label, "long") == "3.00 TB" and one(spark, 1 << 20, text.byte_label, "long") == "1.0 MB"


def test_pyramid_is_clusters_at_every_zoom(spark):
    rng = np.random.default_rng(6)
    towns = rng.uniform([-80, -180], [80, 180], (30, 2))
    at = towns[rng.integers(0, 30, 900)] + rng.normal(scale=1, size=(900, 2)) * rng.choice([1e-6, 1e-3, 0.5], (900, 1))
    rows = [(i, float(np.clip(a, -90, 90)), float(np.clip(b, -180, 180))) for i, (a, b) in enumerate(at)] + [(1000, None, 1.0), (1001, 90.0, 180.0), (1002, -90.0, -180.0)]
    points = spark.createDataFrame(rows, "id long, latitude double, longitude double")
    got = {}
    for r in spatial.pyramid(points).collect():
        got.setdefault(r["zoom"], {})[r["cell_x"], r["cell_y"]] = r
    assert sorted(got) == list(range(17))
    for z in (0, 3, 9, 16):
        want = {(r["cell_x"], r["cell_y"]): r for r in spatial.clusters(points, z).collect()}
        assert set(want) == set(got[z]) and all(got[z][c][k] == pytest.approx(w[k], abs=2e-6) for c, w in want.items() for k in ("count", "latitude", "longitude", "first_id"))
    apart = {(r["cell_x"], r["cell_y"]): r["expansion_zoom"] for r in spatial.expansion_zoom(points, 3).collect()}
    assert apart == {c: r["expansion_zoom"] for c, r in got[3].items() if r["count"] > 1} and len(set(apart.values())) > 3
    text = spatial.pyramid(points, 2, 5)._jdf.queryExecution().executedPlan().toString()
    assert sorted({r["zoom"] for r in spatial.pyramid(points, 2, 5).collect()}) == [2, 3, 4, 5] and "Window" not in text


def test_nearest_place_by_cover(spark):
    """Points everywhere, on edges of cells and on no globe, against all places."""
    rng = np.random.default_rng(2)
    at = [(float(a), float(b)) for a, b in rng.uniform([-90, -180], [90, 180], (3000, 2))] + [(float(a), float(b)) for a in range(-90, 91, 6) for b in range(-180, 181, 10)] + [(95.0, 200.0), (-91.0, 0.0)]
    points = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(at)], "id long, latitude double, longitude double")
    table = np.radians([[p[4], p[5]] for p in places.PLACES])
    got = {r["id"]: r for r in spatial.nearest_place(points).collect()}
    for i, (a, b) in enumerate(at):
        lat, lon = np.radians(a), np.radians(b)
        h = np.sin((table[:, 0] - lat) / 2) ** 2 + np.cos(lat) * np.cos(table[:, 0]) * np.sin((table[:, 1] - lon) / 2) ** 2
        if abs(a) <= 90:
            assert got[i]["distance_km"] == pytest.approx(float((2 * 6371 * np.arctan2(np.sqrt(h), np.sqrt(1 - h))).min()), abs=0.002)
    assert len(got) == len(at) and sum(map(len, places.cover())) < 8 * len(places.cover()) and min(map(len, places.cover())) == 1


def test_content_hash(spark):
    small, large = b"abc", bytes(range(256)) * 8192
    assert ingest.fast_hash(small) == xxhash.xxh64(small).hexdigest() and len(ingest.fast_hash(large)) == 16
    assert ingest.fast_hash(large) != ingest.fast_hash(large[:-1] + b"x")
    df = spark.createDataFrame([(bytearray(small),), (None,)], "b binary")
    assert [r[0] for r in df.select(ingest.content_hash(F.col("b"))).collect()] == ["44bc2cf5ad770999", None]


def test_libraries_of_paths(spark, media, monkeypatch):
    libs = spark.createDataFrame([(1, "/a", True), (2, "/a/b/", True), (3, "/a/b/c", False)], "id long, path string, is_active boolean")
    files = spark.createDataFrame([("/a/b/c/x",), ("/a/bb/x",), ("/z/x",)], "file_path string")
    for few in (1024, 0):  # by a map, and by a join
        monkeypatch.setattr(ingest, "FEW_ROOTS", few)
        assert {tuple(r) for r in ingest.library_of(files, libs).collect()} == {("/a/b/c/x", 2), ("/a/bb/x", 1), ("/z/x", None)}


FACES = "id long, media_id long, person_id long, bbox_x double, bbox_y double, bbox_w double, bbox_h double, confidence double, embedding array<float>"


def test_people(spark, media):
    hot = lambda k: [1.0 if i == k else 0.0 for i in range(8)]
    faces = spark.createDataFrame([(1, 1, 1, 0.1, 0.1, 0.2, 0.2, 0.9, hot(0)), (2, 2, 1, 0.1, 0.1, 0.2, 0.2, 0.9, hot(0)), (3, 3, 2, 0.1, 0.1, 0.2, 0.2, 0.9, hot(1)), (4, 3, None, 0.1, 0.1, 0.2, 0.2, 0.9, hot(5))], FACES)
    persons = spark.createDataFrame([(1, "Alice", 1), (2, "Bob", 3), (3, None, None)], "id long, name string, cover_face_id long")
    files = media(row(1), row(2), row(3))
    assert {r["id"]: r["face_count"] for r in people.people(persons, faces, files).collect()} == {1: 2, 2: 1, 3: 0}
    left, moved = people.merge(persons, faces, 1, [1, 2])
    assert {r["id"]: r["face_count"] for r in people.people(left, moved, files).collect()} == {1: 3, 3: 0}
    matched = {r["id"]: r["person_id"] for r in people.match(faces, people.centroids(faces)).collect()}
    assert matched == {1: 1, 2: 1, 3: 2, 4: None}
    assert people.merge_target(people.people(persons, faces, files), [3, 2]) == 2
    clusters = {r["id"]: r["cluster"] for r in people.cluster_online(faces.withColumn("all", F.lit("x")), group="all").collect()}
    assert clusters == {1: 1, 2: 1, 3: 3, 4: 4}


def test_clusters_of_people(spark):
    """Faces of twelve people, whose vectors have different largest components, against all met in order."""
    rng = np.random.default_rng(3)
    people_ = rng.normal(size=(12, 32))
    x = people_[np.arange(240) % 12] + 0.35 * rng.normal(size=(240, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    faces = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>")
    assert any(len({int(v.argmax()) for v in x[p::12]}) > 1 for p in range(12))
    for df in (faces, faces.withColumn("all", F.lit("x"))):
        got = {r["id"]: r["cluster"] for r in people.cluster_online(df, group="all" if "all" in df.columns else None).collect()}
        assert got == {i: i % 12 for i in range(240)}


def test_boxes_of_faces(spark):
    rows = [(1, 1, None, 0.1, 0.1, 0.2, 0.2, 0.9, None), (2, 1, None, 0.11, 0.1, 0.2, 0.2, 0.8, None), (3, 1, None, 0.6, 0.6, 0.2, 0.2, 0.7, None), (4, 1, None, 0.2, 0.1, 0.2, 0.2, 0.6, None)]
    faces = spark.createDataFrame(rows, FACES)
    assert {r["id"] for r in people.suppress(faces).collect()} == {1, 3, 4}
    turned = faces.filter("id = 1").select(vectors.upright_to_raw(*[F.col(f"bbox_{c}") for c in "xywh"], F.lit(6)).alias("b")).first()["b"]
    assert np.allclose([turned.x, turned.y, turned.w, turned.h], [0.1, 0.7, 0.2, 0.2])


def test_export_names(media):
    rows = media(row(1, "a.jpg"), row(2, "a.jpg", directory="/b"), row(3, "n"), row(4, "n", directory="/b"))
    assert {r[0]: r[1] for r in curation.export_names(rows).collect()} == {1: "a.jpg", 2: "a_1.jpg", 3: "n", 4: "n_1"}


def test_rate_limit(spark):
    events = spark.createDataFrame([(i, "a", i * 10) for i in range(50)] + [(100, "a", 70_000), (101, None, 5)], "event_id long, k string, ms long")
    got = windows.rate_limited(events, "k", 60_000, 30).filter("allowed").select("event_id").collect()
    assert {r[0] for r in got} == {*range(30), 100, 101}


@pytest.mark.parametrize("slice_ms", [1, 100, 10**9])
def test_sessions_over_slices(spark, slice_ms):
    rng = np.random.default_rng(1)
    times = {k: np.sort(rng.integers(0, 20_000, n)) for k, n in (("a", 400), ("b", 3), (None, 50))}
    rows = [(i, k, int(t)) for k, ts in times.items() for i, t in enumerate(ts)]
    want = []
    for k, ts in times.items():
        for part in np.split(ts, np.flatnonzero(np.diff(ts) >= 60) + 1):
            want.append((k, int(part[0]), int(part[-1]), len(part)))
    got = windows.sessions(spark.createDataFrame(rows, "event_id long, k string, ms long"), "k", 60, slice_ms).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_file_event_stream(spark, media, tmp_path):
    catalogue = file_events.Catalogue(spark, str(tmp_path / "catalogue"))
    catalogue.write(media(row(1, "a.jpg"), row(2, "b.jpg", directory="/lib/sub"), row(3, "c.jpg")), 0)
    new = media(row(11, "a.jpg", file_hash="new", file_size=5), row(12, "d.jpg"), row(13, "c.jpg"), row(14, ".hidden.jpg"), row(15, "e.txt"))
    gone = media(row(2, file_path="/lib/sub"))
    cols = [F.lit(k).alias("kind") for k in ("upsert", "remove")]
    batch = new.select(cols[0], F.col("id").alias("seq"), "*").unionByName(gone.select(cols[1], F.lit(99).cast("long").alias("seq"), "*"))
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # what was delivered is not applied again
        query = file_events.follow(stream, catalogue, str(tmp_path / "check"))
        assert query.awaitTermination(120)
    got = {r["file_name"]: (r["id"], r["file_size"], r["thumbnail_status"]) for r in catalogue.read().collect()}
    assert got == {"a.jpg": (1, 5, "pending"), "c.jpg": (3, 1024, "ready"), "d.jpg": (12, 1024, "ready")}
    assert catalogue.versions() == [0, 1]


def test_file_events_on_an_empty_catalogue(spark, media, tmp_path):
    catalogue = file_events.Catalogue(spark, str(tmp_path / "catalogue"))
    for k, names in enumerate((["a.jpg"], ["b.jpg", "c.jpg"], ["a.jpg"], ["d.jpg"])):
        kind = "remove" if k == 2 else "upsert"
        new = media(*[row(10 * k + n, name) for n, name in enumerate(names)])
        new.select(F.lit(kind).alias("kind"), F.col("id").alias("seq"), "*").write.parquet(str(tmp_path / "in" / str(k)))
        stream = spark.readStream.schema(f"kind string, seq long, {MEDIA}").parquet(str(tmp_path / "in" / "*"))
        assert file_events.follow(stream, catalogue, str(tmp_path / "check")).awaitTermination(120)
    assert {r["file_name"] for r in catalogue.read().collect()} == {"b.jpg", "c.jpg", "d.jpg"}
    assert catalogue.versions() == [3, 4]


def test_names_of_exports_never_meet(spark):
    names = ["a.jpg", "a.jpg", "a_1.jpg", "a.jpg", "a_2.jpg", "a_1.jpg", "b", "b", "b_1", "c_01.jpg", "c.jpg", "c.jpg", "x.tar.gz", "x.tar.gz"]
    got = {r["id"]: r["export_name"] for r in curation.export_names(spark.createDataFrame(list(enumerate(names)), "id long, file_name string")).collect()}
    assert len(set(got.values())) == len(names)
    assert [got[i] for i in range(len(names))] == ["a.jpg", "a_3.jpg", "a_1.jpg", "a_4.jpg", "a_2.jpg", "a_1_1.jpg", "b", "b_2", "b_1", "c_01.jpg", "c.jpg", "c_1.jpg", "x.tar.gz", "x.tar_1.gz"]


def test_progress(spark, tmp_path):
    spark.range(7).write.parquet(str(tmp_path / "in"))
    told = []
    listener = progress.Progress("scan", 7, told.append)
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        query = stream.writeStream.format("noop").queryName("scan").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        for _ in range(100):
            if told and told[-1]["is_complete"]:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert told[-1] == {"done": 7, "total": 7, "percent": 100, "is_complete": True}


def test_live_sessions(spark, tmp_path):
    rows = [(1, "a", dt.datetime(2024, 1, 1, 0, 0, 0)), (2, "a", dt.datetime(2024, 1, 1, 0, 0, 5)), (3, "a", dt.datetime(2024, 1, 1, 1))]
    spark.createDataFrame(rows, "event_id long, k string, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, k string, ts timestamp").parquet(str(tmp_path / "in"))
    query = windows.live_sessions(stream, "k", "10 seconds", "1 minute").writeStream.format("memory").queryName("settled").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert [r["events"] for r in spark.table("settled").collect()] == [2]


def test_results_do_not_depend_on_the_sessions_zone(spark, media):
    rows = media(row(1, "IMG_20230514_233000.jpg", captured_at=ms(2023, 5, 31, 23, 30)), row(2, "x.jpg", captured_at=ms(2022, 3, 27, 1, 30)))

    def results():
        return (
            sorted(tuple(r) for r in timeline.months(rows).select("period", "count").collect()),
            sorted(tuple(r) for r in timeline.days(rows).collect()),
            sorted(tuple(r) for r in timeline.days(rows, "Asia/Tokyo").collect()),
            [tuple(r) for r in timeline.on_this_day(rows, 5, 31, 2024).collect()],
            one(spark, "IMG_20230514_233000.jpg", lambda c: dates.from_name(c, 2026)),
            one(spark, "FB_IMG_1426625621638.jpg", lambda c: dates.from_name(c, 2026)),
            [one(spark, s, dates.from_camera) for s in ("2023:05:14 15:23:45", "2023:05:14", "2023:05:14 15:23:45+02:00", "2023:03:26 02:30:00")],
            one(spark, '{"photoTakenTime": {"timestamp": "1684077825"}}', lambda c: dates.from_sidecar(c, 2026)),
        )

    before = spark.conf.get("spark.sql.session.timeZone")
    utc = results()
    assert utc[0] == [("2022-03", 1), ("2023-05", 1)] and utc[2][1][0] == "2023-06-01"
    try:
        for zone in ("America/Los_Angeles", "Europe/Berlin"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert results() == utc
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
