"""Libraries, the made-up library, logs, exports and stored vectors."""

import numpy as np
from pyspark.sql import functions as F

from prismlake.functions import vectors
from prismlake.operators import curation, duplicates, libraries, ops, search, spatial, timeline
from prismlake.sources import logs, synthetic


def test_made_up_library(spark):
    media = synthetic.library(spark)
    assert media.count() == 540 and media.filter("latitude is not null").count() == 360
    assert media.select("file_path").distinct().count() == 540
    assert spatial.in_box(media, spatial.Box(37.0, 38.5, -123.0, -121.5)).count() == 90
    assert sorted((r["period"], r["count"]) for r in timeline.months(media).collect()) == [(f"{y}-07", 180) for y in (2024, 2025, 2026)]
    assert {r["place"] for r in spatial.nearest_place(media).collect()} == {"San Francisco, United States", "New York, United States", "London, United Kingdom", "Buenos Aires, Argentina"}
    assert duplicates.groups(media).count() == 0 and duplicates.extra_files(media).first()[0] == 0
    found = search.apply(media, search.Filter(text="san_francisco", media_type="photo", has_gps_only=True, date_from=1735689600000))
    assert found.count() == 50


def test_registering(spark):
    libs = spark.createDataFrame([(1, "/a", False, 1)], "id long, path string, is_active boolean, created_at long")
    assert [tuple(r) for r in libraries.register(libs, 2, "/a", 9).collect()] == [(1, "/a", True, 1)]
    assert sorted(tuple(r) for r in libraries.register(libs, 2, "/b", 9).collect()) == [(1, "/a", False, 1), (2, "/b", True, 9)]


def test_removing_and_scanning(spark):
    media = spark.createDataFrame([(1, 1, False), (2, 2, False)], "id long, library_id long, face_scanned boolean")
    albums = spark.createDataFrame([(1, 1), (2, 2)], "id long, cover_media_id long")
    links = spark.createDataFrame([(1, 1), (1, 2)], "album_id long, media_id long")
    tags = spark.createDataFrame([(1, 7), (2, 7)], "media_id long, tag_id long")
    faces = spark.createDataFrame([(1, 1), (2, 2)], "id long, media_id long")
    libs = spark.createDataFrame([(1, "/a"), (2, "/b")], "id long, path string")
    left, tables = libraries.remove(libs, curation.Tables(media, albums, links, tags, faces), 1)
    assert [r["id"] for r in left.collect()] == [2] and [r["id"] for r in tables.media_files.collect()] == [2]
    assert {r["id"]: r["cover_media_id"] for r in tables.albums.collect()} == {1: None, 2: 2}
    assert tables.album_media.count() == tables.media_tags.count() == tables.media_faces.count() == 1
    scanned = libraries.mark_scanned(media, spark.createDataFrame([(2,), (2,)], "id long"))
    assert {r["id"]: r["face_scanned"] for r in scanned.collect()} == {1: False, 2: True}
    fresh, people = libraries.reset_scan(curation.Tables(scanned, albums, links, tags, faces), libs)
    assert fresh.media_faces.count() == people.count() == 0 and fresh.media_files.filter("face_scanned").count() == 0


def test_columns_and_previews(spark):
    df = spark.createDataFrame([("video", None, "ready"), ("video", "x.WEBP", "ready"), ("video", "x.jpg", "ready"), ("photo", None, "ready")], "media_type string, thumbnail_path string, thumbnail_status string")
    wide = libraries.with_columns(df, {"rating": ("int", 0), "media_type": ("string", "photo")})
    assert wide.columns[-1] == "rating" and wide.select("media_type").distinct().count() == 2
    assert [r["thumbnail_status"] for r in libraries.reset_film_previews(df).collect()] == ["pending", "pending", "ready", "ready"]
    assert [r["id"] for r in libraries.page(spark.range(10), ["id"], 4, 4).collect()] == [4, 5, 6, 7, 8] and libraries.page(spark.range(10), ["id"], 4, 6).count() == 4


def test_logs(spark, tmp_path):
    (tmp_path / "a.log").write_text("\n".join(["[INFO ] fine", "[WARN ] hm", "[ERROR] bad"] * 3))
    lines = logs.read(spark, str(tmp_path / "a.log"))
    assert [r["line"] for r in ops.tail(lines, 2).collect()] == ["[WARN ] hm", "[ERROR] bad"]
    assert ops.alerts(lines).count() == 6
    logs.write(lines, str(tmp_path / "out"))
    assert [r["line"] for r in logs.read(spark, str(tmp_path / "out")).collect()][:3] == ["[INFO ] fine", "[WARN ] hm", "[ERROR] bad"]


def test_lines_rise_with_file_names_whatever_the_sizes(spark, tmp_path):
    wanted = []
    for name, n in (("a", 2), ("b", 4000), ("c", 300), ("d", 1)):
        lines = [f"{name} {k}" for k in range(n)]
        (tmp_path / f"{name}.log").write_text("\n".join(lines) + "\n")
        wanted += lines
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for c, v in zip(before, ("8k", "1"), strict=True):  # long files are read in pieces, short ones together
        spark.conf.set(c, v)
    try:
        lines = logs.read(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 2
        assert [r["line"] for r in lines.orderBy("seq").collect()] == wanted
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_export(spark, tmp_path):
    for d in ("p", "q"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "a.jpg").write_text(d)
    out = tmp_path / "out"
    out.mkdir()
    rows = [(1, f"{tmp_path}/p/a.jpg", "a.jpg"), (2, f"{tmp_path}/q/a.jpg", "a.jpg"), (3, f"{tmp_path}/gone.jpg", "gone.jpg")]
    got = {r["id"]: (r["export_name"], r["ok"]) for r in libraries.export(spark.createDataFrame(rows, "id long, file_path string, file_name string"), str(out)).collect()}
    assert got == {1: ("a.jpg", True), 2: ("a_1.jpg", True), 3: ("gone.jpg", False)}
    assert (out / "a.jpg").read_text() == "p" and (out / "a_1.jpg").read_text() == "q"


def test_stored_vectors(spark):
    v = np.arange(130, dtype="<f4")
    rows = [(1, bytearray(v.tobytes())), (2, bytearray(v[:2].tobytes() + b"x")), (3, None), (4, bytearray())]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "id long, b binary").select("id", vectors.from_bytes(F.col("b"), 4)).collect()}
    assert got == {1: [0.0, 1.0, 2.0, 3.0], 2: [0.0, 1.0, 0.0, 0.0], 3: None, 4: [0.0] * 4}
