"""What picture and film files say about themselves: EXIF headers and film atoms, read from bytes.

`photo_headers` and `film_headers` take a table of paths that every executor can open (file_path), of which tasks read
HEAD_BYTES of a picture, and of a film, whatever its size, its `moov` atom, found by seeking from atom to atom. Or they take
the contents with them (file_path, content; `spark.read.format("binaryFile")` makes such a table). Each gives a row of
metadata. A file that cannot be read gives nulls.
"""

from __future__ import annotations

import re
import struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import from_camera, from_name

HEAD_BYTES, ATOM_BYTES = 1 << 18, 1 << 19
#: A larger `moov` atom is not read.
MOST_MOOV_BYTES = 64 << 20

# fixed values: the numbers of the tags that are read, by directory
MAIN = {0x0100: "width", 0x0101: "height", 0x010F: "camera_make", 0x0110: "camera_model", 0x0112: "orientation", 0x0132: "modified"}
EXIF = {
    0x829A: "exposure_time", 0x829D: "aperture", 0x8827: "iso", 0x9003: "taken", 0x9004: "created", 0x920A: "focal_length",
    0xA002: "width", 0xA003: "height", 0xA434: "lens_model",
}
GPS = {1: "lat_ref", 2: "lat", 3: "lon_ref", 4: "lon", 5: "alt_ref", 6: "alt"}
EXIF_AT, GPS_AT = 0x8769, 0x8825
#: Bytes and struct codes of the field types; 5 and 10 are pairs.
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "I", 7: "s", 9: "i", 10: "i"}
MOST_ENTRIES = 512
#: Seconds from 1904, where films count from, to 1970.
SINCE_1904 = 2_082_844_800

PHOTO = "file_path string, taken_text string, orientation int, camera_make string, camera_model string, lens_model string, focal_length double, aperture double, iso int, exposure_time string, width int, height int, latitude double, longitude double, altitude double"
FILM = "file_path string, created_ms long, duration double, width int, height int, latitude double, longitude double"

_LOCATION = re.compile(rb"(?:\xa9xyz|xyz)[\s\S]{0,11}?([+-][0-9][0-9.]*[+-][0-9.]+(?:[+-][0-9.]+)?/?)")
_NUMBERS = re.compile(rb"([+-][0-9.]+)([+-][0-9.]+)")


def tiff_start(head: bytes) -> int | None:
    """Where the TIFF structure of a picture begins: at 0 in TIFF-like files, else behind the EXIF mark of a JPEG or another container."""
    if head[:4] in (b"II*\0", b"MM\0*", b"IIU\0", b"IIRO"):
        return 0
    at = head.find(b"Exif\0\0")
    return at + 6 if at >= 0 and head[at + 6 : at + 8] in (b"II", b"MM") else None


def _entries(data: bytes, order: str, at: int):
    """tag and values of a directory's fields."""
    if at + 2 > len(data):
        return
    (n,) = struct.unpack_from(order + "H", data, at)
    for k in range(min(n, MOST_ENTRIES)):
        where = at + 2 + 12 * k
        if where + 12 > len(data):
            return
        tag, kind, count = struct.unpack_from(order + "HHI", data, where)
        code = TYPES.get(kind)
        if code is None:
            continue
        pairs = 2 if kind in (5, 10) else 1
        size = count * pairs * struct.calcsize(order + code)
        start = where + 8 if size <= 4 else struct.unpack_from(order + "I", data, where + 8)[0]
        if count and start + size <= len(data):
            values = struct.unpack_from(f"{order}{count * pairs}{code}", data, start)
            yield tag, list(zip(values[::2], values[1::2], strict=True)) if pairs == 2 else values


def _ratio(value) -> float | None:
    return value[0] / value[1] if isinstance(value, tuple) and value[1] else None


def _degrees(parts, ref) -> float | None:
    whole = [_ratio(p) for p in parts or ()]
    if not whole or None in whole:
        return None
    sign = -1 if ref and ref[:1] in (b"S", b"W") else 1
    return sign * sum(x / 60**k for k, x in enumerate(whole[:3]))


def _text(value: bytes | None) -> str | None:
    return None if value is None else value.decode("utf-8", "replace").replace("\0", " ").strip() or None


def photo(content: bytes) -> dict:
    """The metadata of one picture by column name."""
    head = content[:HEAD_BYTES]
    start = tiff_start(head)
    if start is None or len(head) < start + 8:
        return {}
    data = head[start:]
    order = "<" if data[:2] == b"II" else ">"
    found: dict = {}
    links = {}
    for tag, values in _entries(data, order, struct.unpack_from(order + "I", data, 4)[0]):
        if tag in (EXIF_AT, GPS_AT):
            links[tag] = values[0]
        elif tag in MAIN:
            found[MAIN[tag]] = values[0]
    for at, names in ((EXIF_AT, EXIF), (GPS_AT, GPS)):
        for tag, values in _entries(data, order, links[at]) if at in links else ():
            if tag in names:
                found[names[tag]] = values if names[tag] in ("lat", "lon") else values[0]
    taken = next((found[k] for k in ("taken", "created", "modified") if k in found), None)
    out = {"taken_text": _text(taken) if isinstance(taken, bytes) else None}
    out |= {k: _text(found[k]) for k in ("camera_make", "camera_model", "lens_model") if isinstance(found.get(k), bytes)}
    out |= {k: int(found[k]) for k in ("orientation", "iso", "width", "height") if isinstance(found.get(k), int)}
    out |= {k: _ratio(found.get(k)) for k in ("focal_length", "aperture")}
    if isinstance(found.get("exposure_time"), tuple):
        out["exposure_time"] = "{}/{}".format(*found["exposure_time"])
    out |= {"latitude": _degrees(found.get("lat"), found.get("lat_ref")), "longitude": _degrees(found.get("lon"), found.get("lon_ref"))}
    altitude = _ratio(found.get("alt"))
    out["altitude"] = -altitude if altitude is not None and found.get("alt_ref") == 1 else altitude
    return out


def _atoms(data: bytes, at: int, end: int):
    """kind, start and end of the contents of the atoms in a stretch."""
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1 and at + 16 <= end:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        stop = end if size == 0 else at + size
        if stop > end or size and size < head:
            return
        yield kind, at + head, stop
        at = stop


def location(data: bytes) -> tuple[float, float] | None:
    """The first location in a film's bytes that is on the globe."""
    for m in _LOCATION.finditer(data):
        pair = _NUMBERS.match(m[1])
        if len(m[1]) >= 8 and pair:
            try:
                lat, lon = float(pair[1]), float(pair[2])
            except ValueError:
                continue
            if -90 <= lat <= 90 and -180 <= lon <= 180:
                return lat, lon
    return None


def film(content: bytes) -> dict:
    """The metadata of one film by column name."""
    out: dict = {}
    for kind, a, b in _atoms(content, 0, len(content)):
        if kind != b"moov":
            continue
        for inner, c, d in _atoms(content, a, b):
            if inner == b"mvhd" and d - c >= 20:
                long_ = content[c] == 1
                created, _, scale, duration = struct.unpack_from(">QQIQ" if long_ else ">IIII", content, c + 4)
                out["created_ms"] = (created - SINCE_1904) * 1000 if created > SINCE_1904 else None
                out["duration"] = duration / scale if scale else None
            elif inner == b"trak":
                for deep, e, f in _atoms(content, c, d):
                    if deep == b"tkhd" and f - e >= 8:
                        w, h = (x >> 16 for x in struct.unpack_from(">II", content, f - 8))
                        if w and h and "width" not in out:
                            out |= {"width": w, "height": h}
        where = location(content[a:b])
        if where:
            out["latitude"], out["longitude"] = where
    if "latitude" not in out and (where := location(content[:ATOM_BYTES])):
        out["latitude"], out["longitude"] = where
    return out


def _photo_head(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read(HEAD_BYTES)


def _film_head(path: str) -> bytes:
    """The `moov` atom of a film, or its first ATOM_BYTES if it has none that ends."""
    with open(path, "rb") as f:
        end, at = f.seek(0, 2), 0
        while at + 8 <= end:
            f.seek(at)
            head = f.read(16)
            size, kind = struct.unpack_from(">I4s", head)
            if size == 1 and len(head) == 16:
                size = struct.unpack_from(">Q", head, 8)[0]
            size = size or end - at
            if size < 8 or at + size > end:
                break
            if kind == b"moov" and size <= MOST_MOOV_BYTES:
                f.seek(at)
                return f.read(size)
            at += size
        f.seek(0)
        return f.read(ATOM_BYTES)


def _table(files: DataFrame, read, head, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    given = "content" in files.columns

    def run(parts):
        for pdf in parts:
            rows = []
            for path, content in zip(pdf["file_path"], pdf["content"] if given else pdf["file_path"], strict=True):
                try:
                    got = {} if content is None else read(bytes(content) if given else head(path))
                except (struct.error, ValueError, OverflowError, OSError):
                    got = {}
                rows.append({"file_path": path} | got)
            yield pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names, dtype=object)

    return files.select("file_path", *["content"] * given).mapInPandas(run, schema)


def photo_headers(files: DataFrame, as_of_year: int) -> DataFrame:
    """A row for each picture: what its header says, and captured_at from it or else from the file's name."""
    found = _table(files, photo, _photo_head, PHOTO)
    name = F.regexp_extract("file_path", r"([^/\\]*)$", 1)
    return found.withColumn("captured_at", F.coalesce(from_camera(F.col("taken_text")), from_name(name, as_of_year))).drop("taken_text")


def film_headers(files: DataFrame, as_of_year: int) -> DataFrame:
    """A row for each film: its atoms, and captured_at from them or else from the file's name."""
    found = _table(files, film, _film_head, FILM)
    name = F.regexp_extract("file_path", r"([^/\\]*)$", 1)
    return found.withColumn("captured_at", F.coalesce("created_ms", from_name(name, as_of_year))).drop("created_ms")
