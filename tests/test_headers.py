"""Headers of pictures and films that the tests write themselves."""

import datetime as dt
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismlake.operators import ingest
from prismlake.sources import headers, listing


def ifd(order, entries, at):
    """A directory at an offset, with its values behind it."""
    body, extra = struct.pack(order + "H", len(entries)), b""
    behind = at + 2 + 12 * len(entries) + 4
    for tag, kind, values in entries:
        code = {2: "s", 3: "H", 4: "I", 5: "I"}[kind]
        raw = values if kind == 2 else struct.pack(f"{order}{len(values)}{code}", *values)
        count = len(raw) if kind == 2 else len(values) // (2 if kind == 5 else 1)
        if len(raw) <= 4:
            field = raw.ljust(4, b"\0")
        else:
            field = struct.pack(order + "I", behind + len(extra))
            extra += raw
        body += struct.pack(order + "HHI", tag, kind, count) + field
    return body + struct.pack(order + "I", 0) + extra


def tiff(order, gps=True, text=b"2023:05:14 15:23:45\0"):
    exif = [(0x829A, 5, (1, 250)), (0x829D, 5, (28, 10)), (0x8827, 3, (400,)), (0x9003, 2, text), (0x920A, 5, (50, 1)), (0xA434, 2, b" FE 50mm \0")]
    places = [(1, 2, b"S\0"), (2, 5, (33, 1, 18, 1, 36, 1)), (3, 2, b"W\0"), (4, 5, (66, 1, 20, 1, 0, 1)), (6, 5, (700, 1))]
    main = [(0x0100, 4, (4000,)), (0x0101, 3, (3000,)), (0x010F, 2, b"Sony \0"), (0x0110, 2, b"A7 IV\0"), (0x0112, 3, (6,)), (headers.EXIF_AT, 4, (1000,))]
    main += [(headers.GPS_AT, 4, (2000,))] * gps
    start = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)
    out = bytearray(3000)
    out[:8] = start
    for at, entries in ((8, main), (1000, exif), (2000, places)):
        part = ifd(order, entries, at)
        out[at : at + len(part)] = part
    return bytes(out)


def atom(kind, body):
    return struct.pack(">I4s", len(body) + 8, kind) + body


def movie(place=b"+34.0522-118.2437/"):
    created = int(dt.datetime(2023, 5, 14, 15, tzinfo=dt.timezone.utc).timestamp()) + headers.SINCE_1904
    mvhd = atom(b"mvhd", bytes(4) + struct.pack(">IIII", created, created, 1000, 12_500) + bytes(80))
    track = atom(b"trak", atom(b"tkhd", bytes(76) + struct.pack(">II", 1920 << 16, 1080 << 16)))
    udta = atom(b"udta", atom(b"\xa9xyz", struct.pack(">HH", len(place), 0x15C7) + place))
    return atom(b"ftyp", b"isom" * 3) + atom(b"free", bytes(100)) + atom(b"moov", mvhd + track + udta)


TAKEN = int(dt.datetime(2023, 5, 14, 15, 23, 45, tzinfo=dt.timezone.utc).timestamp() * 1000)


def test_photos(spark):
    jpeg = b"\xff\xd8\xff\xe1\x00\x00Exif\0\0" + tiff(">")
    rows = [("/a/x.dng", tiff("<")), ("/a/y.jpg", jpeg), ("/a/IMG_20200101_000000.jpg", b"\xff\xd8"), ("/a/cut.dng", tiff("<")[:40]), ("/a/none.jpg", None), ("/a/odd.dng", tiff("<", gps=False, text=b"no date\0"))]
    got = {r["file_path"]: r.asDict() for r in headers.photo_headers(spark.createDataFrame(rows, "file_path string, content binary"), 2026).collect()}
    for name in ("/a/x.dng", "/a/y.jpg"):
        r = got[name]
        assert (r["captured_at"], r["orientation"], r["camera_make"], r["camera_model"], r["lens_model"]) == (TAKEN, 6, "Sony", "A7 IV", "FE 50mm")
        assert (r["aperture"], r["iso"], r["exposure_time"], r["focal_length"], r["width"], r["height"], r["altitude"]) == (2.8, 400, "1/250", 50.0, 4000, 3000, 700.0)
        assert r["latitude"] == pytest.approx(-33.31) and r["longitude"] == pytest.approx(-66.333333, abs=1e-5)
    assert got["/a/IMG_20200101_000000.jpg"]["captured_at"] == 1577836800000
    assert got["/a/none.jpg"]["captured_at"] is None and got["/a/odd.dng"]["latitude"] is None and got["/a/odd.dng"]["captured_at"] is None


def test_films(spark):
    rows = [("/a/x.mp4", movie()), ("/a/y.mp4", movie(b"+51.5074-000.1278+015.000/")), ("/a/z.mp4", movie(b"+99.0-999.0/")), ("/a/VID_20200101_000000.mp4", b"junk"), ("/a/n.mp4", None)]
    got = {r["file_path"]: tuple(r)[1:] for r in headers.film_headers(spark.createDataFrame(rows, "file_path string, content binary"), 2026).select("file_path", "captured_at", "duration", "width", "height", "latitude", "longitude").collect()}
    at = int(dt.datetime(2023, 5, 14, 15, tzinfo=dt.timezone.utc).timestamp() * 1000)
    assert got["/a/x.mp4"] == (at, 12.5, 1920, 1080, 34.0522, -118.2437) and got["/a/y.mp4"][4:] == (51.5074, -0.1278)
    assert got["/a/z.mp4"][4:] == (None, None) and got["/a/VID_20200101_000000.mp4"][0] == 1577836800000 and got["/a/n.mp4"][0] is None


def test_headers_of_files(spark, tmp_path):
    """Read by path: the same as from contents, and of a film only what it takes."""
    contents = {"x.dng": tiff("<"), "x.mp4": b"\0\0\0\x10free" + b"x" * 8 + movie(), "cut.mp4": movie()[:30], "junk.mp4": b"ju"}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    with (tmp_path / "long.mp4").open("wb") as f:  # three gigabytes of nothing before the atom
        f.write(b"\0\0\0\1mdat" + (3 << 30).to_bytes(8, "big"))
        f.seek(3 << 30)
        f.write(movie())
    paths = [f"{tmp_path}/{n}" for n in (*contents, "long.mp4", "gone.mp4")]
    files = spark.createDataFrame([(p,) for p in paths], "file_path string")
    given = spark.createDataFrame([(f"{tmp_path}/{n}", c) for n, c in contents.items()], "file_path string, content binary")
    films = {r["file_path"].rsplit("/")[-1]: tuple(r)[1:] for r in headers.film_headers(files, 2026).collect()}
    assert {n: films[n] for n in contents} == {r["file_path"].rsplit("/")[-1]: tuple(r)[1:] for r in headers.film_headers(given, 2026).collect()}
    assert films["long.mp4"] == films["x.mp4"] and films["x.mp4"][1] is not None and not any(films["gone.mp4"])
    photos = {r["file_path"].rsplit("/")[-1]: r for r in headers.photo_headers(files, 2026).collect()}
    assert photos["x.dng"]["captured_at"] == TAKEN and photos["gone.mp4"]["captured_at"] is None


def test_hashes_of_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    sizes = {"a": 0, "b": 100, "c": 1 << 20, "d": (1 << 20) + 1, "e": 3_000_000}
    for name, n in sizes.items():
        (tmp_path / name).write_bytes(rng.bytes(n))
    df = spark.createDataFrame([(f"{tmp_path}/{n}",) for n in (*sizes, "gone")] + [(None,)], "p string")
    got = {r["p"]: r["h"] for r in df.select("p", ingest.file_hashes(F.col("p")).alias("h")).collect()}
    assert got == {f"{tmp_path}/{n}": ingest.fast_hash((tmp_path / n).read_bytes()) for n in sizes} | {f"{tmp_path}/gone": None, None: None}


def test_listing_in_two_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(listing, "FOLDERS", 3)
    want = set()
    for k in range(4):
        for d in ("", "a/", "a/b/", "c/"):
            path = tmp_path / f"top{k}" / d / f"f{k}.jpg"
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(b"x" * (k + 1))
            want.add((str(path), k + 1))
    (tmp_path / "link").symlink_to(tmp_path / "top1")
    assert {(r["file_path"], r["file_size"]) for r in listing.walk(spark, str(tmp_path)).collect()} == want
    with pytest.raises(NotADirectoryError):
        listing.walk(spark, str(tmp_path / "none"))


def test_listing(spark, tmp_path):
    for name in ("a.jpg", "_DSC1.JPG", "._x.jpg", "@eaDir/b.jpg", "sub/deep/c.mp4", "notes.txt", "#recycle/d.jpg", "cat.lrdata/e.jpg", "empty.jpg"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"" if name == "empty.jpg" else b"x")
    found = listing.discovered(listing.walk(spark, str(tmp_path)), str(tmp_path)).collect()
    assert sorted(r["file_path"][len(str(tmp_path)) :] for r in found) == ["/_DSC1.JPG", "/a.jpg", "/sub/deep/c.mp4"]
    with pytest.raises(NotADirectoryError):
        listing.walk(spark, str(tmp_path / "nowhere"))
