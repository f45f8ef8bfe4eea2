"""Search of the catalogue: optional filters that all have to hold, an order, and a page.

Null values of a filtered column never pass. Extra columns stay.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_like, fold
from ..functions.times import effective_ts
from ..sources.places import PLACES

TEXT_COLUMNS = ("file_name", "directory", "camera_make", "camera_model", "lens_model")
#: A place name of fewer bytes finds no places.
LEAST_PLACE_BYTES = 3
PAGE = 100


@dataclass(frozen=True)
class Filter:
    """What to look for; a field that is None (or False, or 'all') asks for nothing."""

    text: str | None = None
    date_from: int | None = None
    date_to: int | None = None
    media_type: str | None = None
    camera_make: str | None = None
    has_gps_only: bool = False
    favorites_only: bool = False
    min_rating: int | None = None
    album_id: int | None = None
    tag_id: int | None = None
    sort_by: str = "date"
    descending: bool = True
    limit: int | None = PAGE
    offset: int = 0


def place_boxes(query: str) -> list[tuple[float, float, float, float]]:
    """Boxes (least and most latitude, least and most longitude) of the places whose city, region or country has the query in it."""
    q = query.strip().lower()
    if len(q.encode()) < LEAST_PLACE_BYTES:
        return []
    return [(lat - r, lat + r, lon - r, lon + r) for city, region, country, _, lat, lon, r in PLACES if any(q in x.lower() for x in (city, region, country))]


def of_type(media_type: str) -> Column:
    """Photos are photos and raw files."""
    if media_type == "all":
        return F.lit(True)
    return F.col("media_type").isin("photo", "raw") if media_type == "photo" else F.col("media_type") == media_type


def matches_text(text: str, columns: list[str]) -> Column:
    """The text stands in a name, or the file lies in a place of that name."""
    hits = [contains_like(F.col(c), text) for c in TEXT_COLUMNS if c in columns]
    hits += [F.coalesce(F.col("latitude").between(a, b) & F.col("longitude").between(c, d), F.lit(False)) for a, b, c, d in place_boxes(text)]
    return reduce(lambda a, b: a | b, hits)


def apply(media: DataFrame, f: Filter, album_media: DataFrame | None = None, media_tags: DataFrame | None = None) -> DataFrame:
    """The rows of `media` that pass, without order and page."""
    tests = []
    if f.text and f.text.strip():
        tests.append(matches_text(f.text.strip(), media.columns))
    if f.date_from is not None:
        tests.append(effective_ts() >= f.date_from)
    if f.date_to is not None:
        tests.append(effective_ts() <= f.date_to)
    if f.media_type:
        tests.append(of_type(f.media_type))
    if f.camera_make:
        tests.append(F.col("camera_make") == f.camera_make)
    if f.has_gps_only:
        tests.append(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    if f.favorites_only:
        tests.append(F.col("is_favorite"))
    if f.min_rating:
        tests.append(F.col("rating") >= f.min_rating)
    out = media.filter(reduce(lambda a, b: a & b, tests)) if tests else media
    if f.album_id is not None:
        out = members(out, album_media.filter(F.col("album_id") == f.album_id))
    if f.tag_id is not None:
        out = members(out, media_tags.filter(F.col("tag_id") == f.tag_id))
    return out


def members(media: DataFrame, links: DataFrame) -> DataFrame:
    """The media that `links` (media_id) name."""
    return media.join(links.select(F.col("media_id").alias("id")), "id", "left_semi")


def order_of(sort_by: str, descending: bool) -> list[Column]:
    """An unknown key sorts by date, newest first; ties always by id, largest first."""
    keys = {"name": fold(F.col("file_name")), "size": F.col("file_size"), "rating": F.col("rating"), "date": effective_ts()}
    if sort_by not in keys:
        sort_by, descending = "date", True
    key = keys[sort_by]
    return [key.desc_nulls_last() if descending else key.asc_nulls_first(), F.col("id").desc()]


def search(media: DataFrame, f: Filter, album_media: DataFrame | None = None, media_tags: DataFrame | None = None) -> DataFrame:
    """A page of what passes, in order; all of it if the filter's limit is None."""
    out = apply(media, f, album_media, media_tags).orderBy(*order_of(f.sort_by, f.descending))
    out = out.offset(f.offset) if f.offset else out
    return out if f.limit is None else out.limit(f.limit)


def page(media: DataFrame, limit: int = PAGE, offset: int = 0) -> DataFrame:
    """The gallery's page: newest first."""
    return search(media, Filter(limit=limit, offset=offset))


def after(media: DataFrame, ts: int, id_: int, limit: int = PAGE) -> DataFrame:
    """The gallery's page behind the row of this time and id, without counting the rows before it."""
    when = effective_ts()
    return page(media.filter((when < ts) | ((when == ts) & (F.col("id") < id_))), limit)


def map_filter(media: DataFrame, media_type: str | None = None, favorites_only: bool = False, min_rating: int = 0, date_from: int | None = None, date_to: int | None = None, path: str = "") -> DataFrame:
    """The map's own filter: rows without a capture date pass date bounds, and text is looked for in paths only."""
    dated = lambda test: F.col("captured_at").isNull() | test
    tests = [of_type(media_type or "all")]
    tests += [F.col("is_favorite")] * favorites_only + [F.col("rating") >= min_rating] * (min_rating > 0)
    tests += [dated(F.col("captured_at") >= date_from)] * (date_from is not None) + [dated(F.col("captured_at") <= date_to)] * (date_to is not None)
    tests += [F.contains(F.lower(F.col("file_path")), F.lit(path.strip().lower()))] * bool(path.strip())
    return media.filter(reduce(lambda a, b: a & b, tests))
