"""The registered queries over the media library's tables, each with its twin in SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dates, geo, text, times, vectors
from ..operators import curation, duplicates, folder_digests, ingest, libraries, ops, people, page_index, point_index, search, spatial, text_index, timeline
from ..sources import listing, logs
from ..sources.places import oracle_rows
from ..sources.shared import shared_folder
from ..sources.tables import Library, oracle_with
from ..streaming import catalogue, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The year as which the queries run.
AS_OF_YEAR = 2002
TS = "coalesce(captured_at, file_modified_at)"
SCORE = """100 - case when regexp_matches(lower(file_name), '\\([0-9]+\\)') then 45 else 0 end - case when contains(lower(file_name), '-edited') then 35 else 0 end
 - case when contains(lower(file_name), 'copy') or contains(lower(file_name), 'copia') then 30 else 0 end - case when contains(lower(file_path), 'takeout') then 25 else 0 end
 - case when contains(lower(file_path), 'export') or contains(lower(file_path), 'temp') or contains(lower(file_path), 'backup') then 20 else 0 end
 + case when latitude is not null then 30 else 0 end + case when captured_at is not null then 20 else 0 end + case when camera_make is not null then 15 else 0 end
 + case when is_favorite then 50 else 0 end + 10 * greatest(coalesce(rating, 0), 0)"""


def query(sql: str | None = None, *tables: str, name: str | None = None):
    """Register a function of a Library; `sql` follows a WITH clause of the named derived tables."""

    def put(f: Callable[[Library], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Library(spark, sf_dir))
        if sql is not None:
            # a query with clauses of its own joins them to the tables'
            head = oracle_with(*tables) if tables else ""
            if head and sql.startswith("with "):
                walks = "recursive " * sql.startswith("with recursive ")
                ORACLE_SQL[key] = f"with {walks}{head[5:]}, {sql.removeprefix('with ').removeprefix(walks)}"
            else:
                ORACLE_SQL[key] = f"{head} {sql}".strip()
        return f

    return put


# months, days, memories


@query(f"select strftime(make_timestamp({TS} * 1000), '%Y-%m') as period, count(*) as count, max(id) as cover_id, arg_max(file_path, id) as cover_file_path, arg_max(file_hash, id) as cover_file_hash from media_files group by 1", "media_files")
def timeline_groups(lib: Library) -> DataFrame:
    return timeline.months(lib.media_files)


@query(f"select strftime(make_timestamp({TS} * 1000), '%Y') as year, count(*) as count from media_files group by 1", "media_files")
def timeline_years(lib: Library) -> DataFrame:
    return timeline.years(timeline.months(lib.media_files))


@query(f"select strftime(make_timestamp({TS} * 1000), '%Y-%m-%d') as day, count(*) as count, arg_max(id, {TS} * 1000000 + id) as first_id, max({TS}) as first_ts from media_files group by 1", "media_files")
def day_groups(lib: Library) -> DataFrame:
    return timeline.days(lib.media_files)


_DAY = "select *, year(make_timestamp(captured_at * 1000)) as year from media_files where strftime(make_timestamp(captured_at * 1000), '%m-%d') = '07-04'"


@query(
    f"""select year, 2002 - year as years_ago, count(*) as count, min(case when k = 1 then id end) as cover_id from
 (select *, row_number() over (partition by year order by is_favorite desc, captured_at desc, id) as k from ({_DAY})) where year < 2002 group by year""",
    "media_files",
)
def on_this_day(lib: Library) -> DataFrame:
    return timeline.on_this_day(lib.media_files, 7, 4, AS_OF_YEAR)


@query(f"select id, year from ({_DAY}) where year < 2002", "media_files")
def on_this_day_items(lib: Library) -> DataFrame:
    return timeline.on_this_day_items(lib.media_files, 7, 4, AS_OF_YEAR).select("id", "year")


@query(f"select id, strftime(make_timestamp({TS} * 1000), '%Y-%m') as period, row_number() over (partition by strftime(make_timestamp({TS} * 1000), '%Y-%m') order by {TS} desc, id desc) - 1 as position from media_files", "media_files")
def timeline_positions(lib: Library) -> DataFrame:
    return timeline.positions(lib.media_files).select("id", "period", F.col("position").cast("long").alias("position"))


# search and pages


_TERMS = ("vid_", "img_77", "/lib2/d1", "ONY", "7.jp", "g_%9.cr2", "no such name")


@query(
    " union all ".join(
        f"select '{t}' as term, id from media_files where lower(file_name) like '%{t.lower()}%' or lower(directory) like '%{t.lower()}%' or lower(coalesce(camera_make, '')) like '%{t.lower()}%'" for t in _TERMS
    ),
    "media_files",
)
def search_text_index(lib: Library) -> DataFrame:
    index = text_index.TextIndex(lib.spark, shared_folder(lib.spark, "grams"))
    index.add(lib.media_files)
    return reduce(DataFrame.unionByName, [index.search(lib.media_files, t).select(F.lit(t).alias("term"), "id") for t in _TERMS])


@query("select id from media_files where contains(lower(file_name), 'vid_') or contains(lower(directory), 'vid_') or contains(lower(coalesce(camera_make, '')), 'vid_')", "media_files")
def search_text(lib: Library) -> DataFrame:
    # the underscore is a wildcard; no name has other characters there
    return search.apply(lib.media_files, search.Filter(text=" VID_ ")).select("id")


@query(
    f"""select id from media_files where media_type in ('photo', 'raw') and camera_make = 'Sony' and latitude is not null and longitude is not null and rating >= 3
 and {TS} between 820454400000 and 978307199999""",
    "media_files",
)
def search_filters(lib: Library) -> DataFrame:
    f = search.Filter(media_type="photo", camera_make="Sony", has_gps_only=True, min_rating=3, date_from=820454400000, date_to=978307199999)
    return search.apply(lib.media_files, f).select("id")


@query("select id from media_files where is_favorite and media_type = 'video'", "media_files")
def search_favorites(lib: Library) -> DataFrame:
    return search.apply(lib.media_files, search.Filter(favorites_only=True, media_type="video")).select("id")


@query("select id, file_name from media_files order by lower(file_name) asc nulls first, id desc limit 100 offset 50", "media_files")
def search_sorted_page(lib: Library) -> DataFrame:
    return search.search(lib.media_files, search.Filter(sort_by="name", descending=False, offset=50)).select("id", "file_name")


@query("select id, file_size from media_files order by file_size desc, id desc limit 100", "media_files")
def search_largest(lib: Library) -> DataFrame:
    return search.search(lib.media_files, search.Filter(sort_by="size")).select("id", "file_size")


@query("select id, rating from media_files order by rating asc nulls first, id desc limit 100", "media_files")
def search_by_rating(lib: Library) -> DataFrame:
    return search.search(lib.media_files, search.Filter(sort_by="rating", descending=False)).select("id", F.col("rating"))


@query(
    f"""select distinct id from media_files, {oracle_rows()} where (contains(lower(city), 'united') or contains(lower(region), 'united') or contains(lower(country), 'united'))
 and latitude between lat - radius_deg and lat + radius_deg and longitude between lon - radius_deg and lon + radius_deg""",
    "media_files",
)
def search_place(lib: Library) -> DataFrame:
    return search.apply(lib.media_files, search.Filter(text="United")).select("id")


@query("select id from media_files where id in (select media_id from album_media where album_id = 3)", "media_files", "album_media")
def search_album(lib: Library) -> DataFrame:
    return search.apply(lib.media_files, search.Filter(album_id=3), album_media=lib.album_media).select("id")


@query("select id from media_files where id in (select media_id from media_tags where tag_id = 7) and media_type in ('photo', 'raw')", "media_files", "media_tags")
def search_tag(lib: Library) -> DataFrame:
    return search.apply(lib.media_files, search.Filter(tag_id=7, media_type="photo"), media_tags=lib.media_tags).select("id")


@query(f"select id, {TS} as ts from media_files order by {TS} desc, id desc limit 100 offset 100", "media_files")
def media_paged(lib: Library) -> DataFrame:
    return search.page(lib.media_files, 100, 100).select("id", times.effective_ts().alias("ts"))


_OFFSETS = ((0, 50), (7321, 100), (14990, 100))


@query(
    f"with paged as (select id, row_number() over (order by {TS} desc, id desc) - 1 as place, row_number() over (order by lower(file_name), id desc) - 1 as by_name from media_files) "
    + " union all ".join(f"select {o} as first, 'date' as by, id from paged where place >= {o} and place < {o + n} union all select {o}, 'name', id from paged where by_name >= {o} and by_name < {o + n}" for o, n in _OFFSETS)
    + " union all select place, 'place', id from paged where id % 997 = 0",
    "media_files",
)
def media_paged_index(lib: Library) -> DataFrame:
    by_date, by_name = (page_index.PageIndex(lib.spark, shared_folder(lib.spark, "pages"), *order) for order in (("date", True), ("name", False)))
    for index in (by_date, by_name):
        index.write(lib.media_files, 5000)
    pages = [index.page(o, n).select(F.lit(o).cast("long").alias("first"), F.lit(by).alias("by"), "id") for o, n in _OFFSETS for by, index in (("date", by_date), ("name", by_name))]
    places = by_date.places(lib.media_files.filter("id % 997 = 0")).select(F.col("place").alias("first"), F.lit("place").alias("by"), "id")
    return reduce(DataFrame.unionByName, [*pages, places])


@query(f"select id from media_files where ({TS}, id) < (900000000000, 100000000) order by {TS} desc, id desc limit 120", "media_files")
def media_after(lib: Library) -> DataFrame:
    return search.after(lib.media_files, 900000000000, 100000000, 120).select("id")


@query("select id, file_path, file_hash, file_size from media_files where id = 4", "media_files")
def media_by_id(lib: Library) -> DataFrame:
    return lib.media_files.filter("id = 4").select("id", "file_path", "file_hash", "file_size").limit(1)


@query("select id from media_files where rating >= 2 and (captured_at is null or captured_at >= 900000000000) and contains(lower(file_path), '/d1')", "media_files")
def map_filter(lib: Library) -> DataFrame:
    return search.map_filter(lib.media_files, min_rating=2, date_from=900000000000, path="/D1").select("id")


# statistics


@query(
    """select count(*) as total_files, count(*) filter (media_type in ('photo', 'raw')) as photos, count(*) filter (media_type = 'video') as videos, cast(sum(file_size) as bigint) as total_bytes,
 count(*) filter (latitude is not null and longitude is not null) as geotagged, count(*) filter (is_favorite) as favorites, (select count(*) from albums) as albums, (select count(*) from tags) as tags from media_files""",
    "media_files",
    "albums",
    "tags",
)
def library_stats(lib: Library) -> DataFrame:
    return ops.library_stats(lib.media_files, lib.albums, lib.tags)


@query(
    """select round(100.0::double * count(*) filter (media_type in ('photo', 'raw')) / count(*), 2) as photo_percent, round(100.0::double * count(*) filter (media_type = 'video') / count(*), 2) as video_percent,
 cast(round(round(100.0::double * count(latitude) / count(*), 2)) as bigint) as geotagged_percent from media_files""",
    "media_files",
)
def library_shares(lib: Library) -> DataFrame:
    return ops.shares(ops.library_stats(lib.media_files, lib.albums, lib.tags))


@query("select media_type, count(*) as count from media_files group by 1", "media_files")
def count_by_type(lib: Library) -> DataFrame:
    return ops.counts(lib.media_files, "media_type")


@query("select thumbnail_status, count(*) as count from media_files group by 1", "media_files")
def thumb_status_counts(lib: Library) -> DataFrame:
    return ops.counts(lib.media_files, "thumbnail_status")


@query("select lower(regexp_extract(file_name, '^.+\\.([^.]*)$', 1)) as extension, count(*) as count from media_files group by 1 order by 2 desc, 1 limit 8", "media_files")
def top_extensions(lib: Library) -> DataFrame:
    return ops.top_extensions(lib.media_files)


@query("select l.id, path, count(m.id) as total_files, path || ' (active, ' || count(m.id) || ' files)' as label, created_at from libraries l left join media_files m on m.library_id = l.id group by l.id, path, created_at", "libraries", "media_files")
def library_counts(lib: Library) -> DataFrame:
    return ops.library_counts(lib.libraries, lib.media_files)


@query(f"select id, file_hash from (select *, row_number() over (partition by file_hash order by id) as k from (select * from media_files where thumbnail_status = 'pending' order by {TS} desc, id desc limit 80)) where k = 1", "media_files")
def thumb_queue(lib: Library) -> DataFrame:
    return ops.thumbnail_queue(lib.media_files).select("id", "file_hash")


@query("select id, 'thumbnails/' || file_hash[1:2] || '/' || file_hash || '.jpg' as path from media_files", "media_files")
def thumb_paths(lib: Library) -> DataFrame:
    return lib.media_files.select("id", ops.thumbnail_path(F.col("file_hash")).alias("path"))


@query("select id, case when thumbnail_status = 'failed' or (thumbnail_status = 'ready' and id % 10 = 7) then 'pending' else thumbnail_status end as thumbnail_status from media_files", "media_files")
def thumb_heal(lib: Library) -> DataFrame:
    # each row's own preview is there, but for every tenth
    own = lib.media_files.withColumn("file_hash", F.concat("file_hash", F.lit("-"), F.col("id").cast("string")))
    cached = own.select("file_hash", F.when(F.col("id") % 10 == 7, 100).otherwise(900).alias("bytes"))
    return ops.heal_cache(own, cached).select("id", "thumbnail_status")


@query("select id, case when n > 0 then 'ready' else thumbnail_status end as thumbnail_status from (select *, count(*) filter (id % 4 = 0) over (partition by file_hash) as n from media_files)", "media_files")
def thumb_results(lib: Library) -> DataFrame:
    done = lib.media_files.filter("id % 4 = 0").select("file_hash", F.lit(True).alias("ok"))
    return ops.spread_thumbnails(lib.media_files, done).select("id", "thumbnail_status")


# copies


@query("select count(*) - count(distinct file_hash) as extra_files from media_files", "media_files")
def duplicate_extra_files(lib: Library) -> DataFrame:
    return duplicates.extra_files(lib.media_files)


_GROUP = "select file_hash, file_size, count(*) as count, cast(sum(file_size) as bigint) as total_size_bytes, min(id) as first_id"


@query(f"{_GROUP} from media_files where file_hash in (select file_hash from media_files group by 1 having count(*) > 1) group by 1, 2 having count(*) > 1", "media_files")
def duplicate_groups(lib: Library) -> DataFrame:
    return duplicates.groups(lib.media_files)


@query(f"{_GROUP} from media_files where file_hash in (select file_hash from media_files where file_size >= 20000 and media_type = 'photo' group by 1 having count(*) > 1) group by 1, 2 having count(*) > 1", "media_files")
def duplicate_groups_filtered(lib: Library) -> DataFrame:
    return duplicates.groups(lib.media_files, 20000, "photo")


@query(f"{_GROUP} from media_files group by 1, 2 having count(*) > 1 and bool_or(contains(lower(file_name), 'copy'))", "media_files")
def duplicate_groups_named(lib: Library) -> DataFrame:
    return duplicates.naming(duplicates.groups(lib.media_files), lib.media_files, "Copy")


@query("select id, file_hash from (select *, count(*) over (partition by file_hash, file_size) as n from media_files) where n > 1", "media_files")
def duplicate_items(lib: Library) -> DataFrame:
    return duplicates.items(duplicates.groups(lib.media_files), lib.media_files).select("id", "file_hash")


@query(
    """select id, file_hash, sum(file_size) over same as total_size_bytes, min(id) over same as first_id, row_number() over (partition by file_hash, file_size order by id) - 1 as position from media_files
 window same as (partition by file_hash, file_size) qualify count(*) over same > 1""",
    "media_files",
)
def duplicate_items_ordered(lib: Library) -> DataFrame:
    return duplicates.items_in_order(duplicates.groups(lib.media_files), lib.media_files).select("id", "file_hash", "total_size_bytes", "first_id", "position")


_RANKED = f"with ranked as (select *, row_number() over (partition by file_hash, file_size order by score desc, id) as rank, count(*) over (partition by file_hash, file_size) as copies from (select *, cast({SCORE} as bigint) as score from media_files))"


@query(f"{_RANKED} select file_hash, file_size, id as keeper_id, score, copies as count from ranked where rank = 1 and copies > 1", "media_files")
def duplicate_keepers(lib: Library) -> DataFrame:
    return duplicates.keepers(lib.media_files)


@query(f"{_RANKED} select count(*) as groups, cast(sum(copies - 1) as bigint) as extra_files, cast(sum(file_size * (copies - 1)) as bigint) as wasted_bytes from ranked where rank = 1 and copies > 1", "media_files")
def duplicate_wasted(lib: Library) -> DataFrame:
    return duplicates.wasted(lib.media_files)


@query(f"{_RANKED} select id, file_hash from ranked where rank > 1", "media_files")
def redundant_ids(lib: Library) -> DataFrame:
    return duplicates.redundant(lib.media_files).select("id", "file_hash")


# the map


@query("select id, latitude, longitude from media_files where latitude between 20 and 40 and longitude between -100 and -60", "media_files")
def bbox(lib: Library) -> DataFrame:
    return spatial.in_box(lib.media_files, spatial.Box(40, 20, -100, -60)).select("id", "latitude", "longitude")


@query("select id, latitude, longitude from media_files where latitude between -30 and 30 and (longitude >= 170 or longitude <= -170)", "media_files")
def bbox_antimeridian(lib: Library) -> DataFrame:
    return spatial.in_box(lib.media_files, spatial.Box(-30, 30, 170, -170)).select("id", "latitude", "longitude")


@query("select id, latitude, longitude from media_files where latitude between -60 and 90 and longitude is not null", "media_files")
def bbox_world(lib: Library) -> DataFrame:
    return spatial.in_box(lib.media_files, spatial.Box(-60, 120, -180, 180)).select("id", "latitude", "longitude")


@query(
    """select 'box' as what, id, latitude, longitude from media_files where latitude between 30 and 42 and longitude between 100 and 130
 union all select 'date line', id, latitude, longitude from media_files where latitude between -30 and 5 and (longitude >= 171.5 or longitude <= -175)
 union all select 'first', id, latitude, longitude from (select * from media_files where latitude between -50 and 50 and longitude is not null order by id limit 50)""",
    "media_files",
)
def bbox_index(lib: Library) -> DataFrame:
    index = point_index.PointIndex(lib.spark, shared_folder(lib.spark, "points"))
    index.add(lib.media_files)
    boxes = {"box": (spatial.Box(42, 30, 100, 130), None), "date line": (spatial.Box(-30, 5, 171.5, -175), None), "first": (spatial.Box(-50, 50, -180, 180), 50)}
    return reduce(DataFrame.unionByName, [index.in_box(box, limit).select(F.lit(what).alias("what"), "id", "latitude", "longitude") for what, (box, limit) in boxes.items()])


@query("select id from media_files where latitude between -80 and 80 and longitude between -170 and 170 and id in (select media_id from album_media where album_id = 5) order by id limit 100000", "media_files", "album_media")
def bbox_album(lib: Library) -> DataFrame:
    chosen = search.apply(lib.media_files, search.Filter(album_id=5), album_media=lib.album_media)
    return spatial.in_box(chosen, spatial.Box(-80, 80, -170, 170), 100_000).select("id")


_BITS = "least(greatest(cast(floor((longitude + 180) / 360 * 262144) as bigint), 0), 262143) as x, least(greatest(cast(floor((latitude + 90) / 180 * 131072) as bigint), 0), 131071) as y"
_CODE = " || ".join(
    "substr('0123456789bcdefghjkmnpqrstuvwxyz', 1 + cast(" + " + ".join(f"{1 << (4 - (b - 5 * k))} * (({'x' if b % 2 == 0 else 'y'} >> {(17 if b % 2 == 0 else 16) - b // 2}) & 1)" for b in range(5 * k, 5 * k + 5)) + " as integer), 1)" for k in range(7)
)


@query(f"select id, {_CODE} as geohash from (select id, {_BITS} from media_files where latitude is not null)", "media_files")
def geohash7(lib: Library) -> DataFrame:
    return lib.media_files.filter("latitude is not null").select("id", geo.geohash(F.col("latitude"), F.col("longitude")).alias("geohash"))


@query(f"select tile, count(*) as count, round(avg(latitude), 6) as latitude, round(avg(longitude), 6) as longitude from (select latitude, longitude, ({_CODE})[1:2] as tile from (select latitude, longitude, {_BITS} from media_files where latitude is not null)) group by 1", "media_files")
def geohash_tiles(lib: Library) -> DataFrame:
    return spatial.tiles(lib.media_files, 2)


def _cell_sql(zoom: int, x: str = "cell_x", y: str = "cell_y") -> str:
    north = "case when latitude >= 90 then 0 when latitude <= -90 then 1 else least(greatest(0.5 - 0.25 * ln((1 + sin(radians(latitude))) / (1 - sin(radians(latitude)))) / pi(), 0), 1) end"
    n = repr(512 * 2.0**zoom / 60)
    return f"cast(floor((longitude / 360 + 0.5) * {n}) as bigint) as {x}, cast(floor(({north}) * {n}) as bigint) as {y}"


@query(f"select cell_x, cell_y, count(*) as count, round(avg(latitude), 6) as latitude, round(avg(longitude), 6) as longitude, min(id) as first_id from (select *, {_cell_sql(3)} from media_files where latitude is not null) group by 1, 2", "media_files")
def grid_clusters(lib: Library) -> DataFrame:
    return spatial.clusters(lib.media_files, 3)


_LEVELS = f"with spots as (select id, latitude, longitude, {', '.join(_cell_sql(z, f'x{z}', f'y{z}') for z in range(17))} from media_files where latitude is not null) " + " union all ".join(
    f"select {z} as zoom, x{z} as cell_x, y{z} as cell_y, count(*) as count, round(sum(latitude), 3) as latitude_sum, round(sum(longitude), 3) as longitude_sum, min(id) as first_id,"
    f" case when count(*) > 1 then coalesce({''.join(f'case when count(distinct (x{d}, y{d})) > 1 then {d} end, ' for d in range(z + 1, 17))}17) end as expansion_zoom from spots group by x{z}, y{z}"
    for z in range(17)
)


@query(_LEVELS, "media_files")
def cluster_pyramid(lib: Library) -> DataFrame:
    sums = {f"{c}_sum": F.round(F.col(c) * F.col("count"), 3) for c in ("latitude", "longitude")}
    return spatial.pyramid(lib.media_files).select("zoom", "cell_x", "cell_y", "count", *[c.alias(n) for n, c in sums.items()], "first_id", F.when(F.col("count") > 1, F.col("expansion_zoom")).alias("expansion_zoom"))


_DEEPER = range(4, 17)


@query(
    f"""select cell_x, cell_y, count(*) as count, cast(coalesce({", ".join(f"case when count(distinct (x{z}, y{z})) > 1 then {z} end" for z in _DEEPER)}, 17) as bigint) as expansion_zoom
 from (select {_cell_sql(3)}, {", ".join(_cell_sql(z, f"x{z}", f"y{z}") for z in _DEEPER)} from media_files where latitude is not null) group by 1, 2 having count(*) > 1""",
    "media_files",
)
def cluster_expansion(lib: Library) -> DataFrame:
    return spatial.expansion_zoom(lib.media_files, 3)


_KM = "2 * 6371.0 * atan2(sqrt(a), sqrt(greatest(1 - a, 0)))"
_A = "pow(sin(radians(lat - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(lat)) * pow(sin(radians(lon - longitude) / 2), 2)"


@query(
    f"""select id, round(km, 3) as distance_km, case when km <= 85 then city || ', ' || country when km <= 160 then 'Near ' || city || ', ' || country end as place from
 (select *, row_number() over (partition by id order by km) as k from (select *, {_KM} as km from (select id, city, country, {_A} as a from media_files, {oracle_rows()} where latitude is not null))) where k = 1""",
    "media_files",
)
def nearest_city(lib: Library) -> DataFrame:
    return spatial.nearest_place(lib.media_files)


# what stands around the catalogue: paths, listings, labels, logs, stored vectors


@query("select id, file_path as path from media_files", "media_files")
def clean_paths(lib: Library) -> DataFrame:
    prefix = F.when(F.col("id") % 3 == 0, "\\\\?\\").otherwise("")
    raw = F.concat(F.lit(' "'), prefix, F.col("file_path"), F.expr("repeat('/', cast(id % 4 as int))"), F.lit("'\t "))
    return lib.media_files.select("id", text.clean_path(raw).alias("path"))


@query(
    """with listed as (select case when id % 7 = 0 then directory || '/' || id || '.txt' when id % 11 = 0 then directory || '/.git/' || file_name when id % 17 = 0 then '/.lib1' || file_path else file_path end as file_path, case when id % 13 = 0 then 0 else file_size end as file_size from media_files)
 select file_path, file_size, regexp_replace(file_path, '/[^/]*$', '') as directory, regexp_extract(file_path, '[^/]*$') as file_name from listed where file_size > 0 and starts_with(file_path, '/lib1') and not ends_with(file_path, '.txt') and not contains(file_path, '/.git/')""",
    "media_files",
)
def listing_discovered(lib: Library) -> DataFrame:
    path = F.when(F.col("id") % 7 == 0, F.concat("directory", F.lit("/"), "id", F.lit(".txt"))).when(F.col("id") % 11 == 0, F.concat("directory", F.lit("/.git/"), "file_name")).when(F.col("id") % 17 == 0, F.concat(F.lit("/.lib1"), "file_path")).otherwise(F.col("file_path"))
    listed = lib.media_files.select(path.alias("file_path"), F.when(F.col("id") % 13 == 0, 0).otherwise(F.col("file_size")).alias("file_size"))
    return listing.discovered(listed, "/lib1")


@query(
    """select id, case when n >= 1099511627776 then printf('%.2f TB', n / 1099511627776.0) when n >= 1073741824 then printf('%.2f GB', n / 1073741824.0) else printf('%.1f MB', n / 1048576.0) end as label
 from (select id, file_size * case id % 4 when 0 then 1 when 1 then 1000 when 2 then 1000000 else 100000000 end as n from media_files)""",
    "media_files",
)
def byte_labels(lib: Library) -> DataFrame:
    n = F.col("file_size") * F.when(F.col("id") % 4 == 0, 1).when(F.col("id") % 4 == 1, 1000).when(F.col("id") % 4 == 2, 1_000_000).otherwise(100_000_000)
    return lib.media_files.select("id", text.byte_label(n).alias("label"))


@query("select directory, cast(round(100.0 * count(*) filter (face_scanned) / count(*)) as bigint) as percent from media_files group by 1", "media_files")
def scan_percent(lib: Library) -> DataFrame:
    each = lib.media_files.groupBy("directory").agg(F.count_if("face_scanned").alias("done"), F.count(F.lit(1)).alias("total"))
    return each.select("directory", ops.percent_done(F.col("done"), F.col("total")).alias("percent"))


@query(f"select cell_x, cell_y, case when n >= 1000 then cast(round(n / 1000.0, 1) as double) || 'k' else n || '' end as badge from (select cell_x, cell_y, count(*) as n from (select *, {_cell_sql(0)} from media_files where latitude is not null) group by 1, 2)", "media_files")
def cluster_badges(lib: Library) -> DataFrame:
    return spatial.clusters(lib.media_files, 0).select("cell_x", "cell_y", spatial.badge(F.col("count")).alias("badge"))


@query("select id, name from albums order by name, id limit 11 offset 5", "albums")
def albums_page(lib: Library) -> DataFrame:
    return libraries.page(lib.albums, ["name", "id"], 10, 5).select("id", "name")


@query("select id, round(list_sum(list_transform(embedding[1:40], lambda x: cast(x as double))), 5) as total, 40 as numbers from media_faces", "media_faces")
def stored_vectors(lib: Library) -> DataFrame:
    """Vectors as they are stored, little-endian floats, read back, the first 40 numbers of each."""

    @F.pandas_udf("binary")
    def as_bytes(vectors_: pd.Series) -> pd.Series:
        return vectors_.map(lambda v: np.asarray(v, dtype="<f4").tobytes())

    read = vectors.from_bytes(as_bytes("embedding"), 40)
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return lib.media_faces.select("id", read.alias("v")).select("id", F.round(total, 5).alias("total"), F.size("v").alias("numbers"))


@query("select props as line, 200 - row_number() over (order by event_id desc) as place from events qualify row_number() over (order by event_id desc) <= 200")
def log_written_and_read(lib: Library) -> DataFrame:
    folder = shared_folder(lib.spark, "log")
    logs.write(lib.base("events").select(F.col("event_id").alias("seq"), F.col("props").alias("line")), folder)
    last = ops.tail(logs.read(lib.spark, folder), 200)
    return last.select("line", (F.row_number().over(Window.orderBy("seq")) - 1).cast("long").alias("place"))


# albums, tags and changes


@query(
    """select a.id, a.name, a.cover_media_id, a.created_at, count(l.media_id) as media_count, m.file_path as cover_file_path from albums a left join album_media l on l.album_id = a.id
 left join media_files m on m.id = a.cover_media_id group by a.id, a.name, a.cover_media_id, a.created_at, m.file_path""",
    "albums",
    "album_media",
    "media_files",
)
def albums_with_counts(lib: Library) -> DataFrame:
    return curation.albums(lib.albums, lib.album_media, lib.media_files).select("id", "name", "cover_media_id", "created_at", "media_count", "cover_file_path")


@query("select id, name, (select count(*) from album_media x where x.album_id = a.id) as media_count from albums a where id in (select album_id from album_media where media_id = 4)", "albums", "album_media")
def media_albums(lib: Library) -> DataFrame:
    return curation.albums_of(4, lib.albums, lib.album_media, lib.media_files).select("id", "name", "media_count")


@query("select t.id, t.name, t.color, count(l.media_id) as media_count from tags t left join media_tags l on l.tag_id = t.id group by 1, 2, 3", "tags", "media_tags")
def tags_with_counts(lib: Library) -> DataFrame:
    return curation.tags(lib.tags, lib.media_tags)


@query("select id, name, color, cast(1 as bigint) as media_count from tags where id in (select tag_id from media_tags where media_id = 4)", "tags", "media_tags")
def media_tags(lib: Library) -> DataFrame:
    return curation.tags_of(4, lib.tags, lib.media_tags)


@query(
    """with left_ as (select * from album_media where media_id % 3 <> 0) select a.id, case when a.cover_media_id % 3 = 0 and exists (select 1 from album_media x where x.album_id = a.id and x.media_id = a.cover_media_id)
 then (select max(struct_pack(t := added_at, m := media_id)).m from left_ l where l.album_id = a.id) else a.cover_media_id end as cover_media_id from albums a""",
    "albums",
    "album_media",
)
def album_remove_reassign(lib: Library) -> DataFrame:
    removed = lib.album_media.filter("media_id % 3 = 0").select("album_id", "media_id")
    return curation.remove_from_album(lib.albums, lib.album_media, removed)[0].select("id", "cover_media_id")


@query("select album_id, media_id, added_at from album_media union select 10, m, 5000 from (values (1), (2), (3)) v(m) where m not in (select media_id from album_media where album_id = 10)", "album_media")
def album_add(lib: Library) -> DataFrame:
    return curation.add_to_album(lib.albums, lib.album_media, 10, [1, 2, 3, 2], 5000)[1]


@query("select id, name, case when name = 'tag_7' then '#ff0000' else color end as color from tags union all select 1000, 'holiday', '#3b82f6'", "tags")
def tag_upsert(lib: Library) -> DataFrame:
    return curation.upsert_tag(curation.upsert_tag(lib.tags, 999, "tag_7", "#ff0000"), 1000, "holiday")


@query("select media_id, tag_id from media_tags where tag_id <> 7 union select id, 3 from media_files where is_favorite", "media_tags", "media_files")
def tag_changes(lib: Library) -> DataFrame:
    kept = curation.delete_tag(lib.tags, lib.media_tags, 7)[1]
    return curation.add_tags(kept, lib.media_files.filter("is_favorite").select(F.col("id").alias("media_id"), F.lit(3).cast("long").alias("tag_id")))


@query(
    """select (select count(*) from media_files where id % 7 <> 0) as media, (select count(*) from albums where cover_media_id % 7 <> 0) as covers, (select count(*) from album_media where media_id % 7 <> 0) as album_links,
 (select count(*) from media_tags where media_id % 7 <> 0) as tag_links, (select count(*) from media_faces where media_id not in (select id from media_files where id % 7 = 0)) as faces""",
    "media_files",
    "albums",
    "album_media",
    "media_tags",
    "media_faces",
)
def delete_cascade(lib: Library) -> DataFrame:
    t = curation.delete_media(curation.Tables(lib.media_files, lib.albums, lib.album_media, lib.media_tags, lib.media_faces), lib.media_files.filter("id % 7 = 0").select("id"))
    n = lambda df, name, c="*": df.agg(F.count(c).alias(name))
    return n(t.media_files, "media").crossJoin(n(t.albums, "covers", "cover_media_id")).crossJoin(n(t.album_media, "album_links")).crossJoin(n(t.media_tags, "tag_links")).crossJoin(n(t.media_faces, "faces"))


@query("select id, case when id % 5 = 0 then true else is_favorite end as is_favorite, cast(case when id % 4 = 0 then 5 else rating end as integer) as rating, cast(case when id % 3 = 0 then 6 else orientation end as integer) as orientation from media_files", "media_files")
def batch_favourite(lib: Library) -> DataFrame:
    out = curation.favourite(lib.media_files, F.col("id") % 5 == 0, True)
    out = curation.orient(curation.rate(out, F.col("id") % 4 == 0, 9), F.col("id") % 3 == 0, 90)
    return out.select("id", "is_favorite", "rating", "orientation")


#: Names with the digits dropped, so that many are the same, and some that end in a number as made names do.
_SHORT = "case when id % 50 = 1 then 'IMG__' || cast(1 + id % 7 as {0}) || '.jpg' else {1} end"
_SHORT_SQL = _SHORT.format("varchar", "regexp_replace(file_name, '[0-9]+', '', 'g')")


@query(
    f"""with named as (select id, {_SHORT_SQL} as file_name from media_files),
 numbered as (select *, row_number() over (partition by file_name order by id) - 1 as k from named),
 repeated as (select file_name, count(*) as n, regexp_replace(file_name, '\\.[^.]*$', '') as stem, regexp_extract(file_name, '\\.[^.]*$') as dot from named group by 1 having count(*) > 1),
 made as (select file_name, stem || '_' || number || dot as name, number from repeated, unnest(range(1, n + (select count(distinct file_name) from named))) u(number)),
 free as (select file_name, name, row_number() over (partition by file_name order by number) as k from made where name not in (select file_name from named))
 select id, coalesce(name, numbered.file_name) as export_name from numbered left join free on numbered.file_name = free.file_name and numbered.k = free.k""",
    "media_files",
)
def export_names(lib: Library) -> DataFrame:
    return curation.export_names(lib.media_files.withColumn("file_name", F.expr(_SHORT.format("string", "regexp_replace(file_name, '[0-9]+', '')"))))


# lists in their order: a list's first page, which is what a limit is for


@query("select id, name, created_at from albums order by created_at desc, id desc limit 20", "albums")
def albums_first(lib: Library) -> DataFrame:
    return curation.newest_first(curation.albums(lib.albums, lib.album_media, lib.media_files)).limit(20).select("id", "name", "created_at")


@query("select id, name from tags order by name, id limit 20", "tags")
def tags_first(lib: Library) -> DataFrame:
    return curation.by_name(curation.tags(lib.tags, lib.media_tags)).limit(20).select("id", "name")


@query("select p.id, count(distinct f.media_id) as face_count from persons p left join media_faces f on f.person_id = p.id group by 1 order by 2 desc, 1 limit 5", "persons", "media_faces")
def people_first(lib: Library) -> DataFrame:
    return people.most_seen_first(people.people(lib.persons, lib.media_faces, lib.media_files)).limit(5).select("id", "face_count")


@query(f"{_GROUP} from media_files group by 1, 2 having count(*) > 1 order by 4 desc, 5 limit 25", "media_files")
def duplicate_groups_first(lib: Library) -> DataFrame:
    return duplicates.largest_first(duplicates.groups(lib.media_files)).limit(25)


@query("select id, path from libraries order by created_at desc, id desc limit 2", "libraries")
def libraries_first(lib: Library) -> DataFrame:
    return ops.latest_libraries(ops.library_counts(lib.libraries, lib.media_files)).limit(2).select("id", "path")


@query(f"select strftime(make_timestamp({TS} * 1000), '%Y-%m-%d') as day, count(*) as count, max({TS}) as first_ts from media_files group by 1 order by 3 desc limit 30", "media_files")
def days_first(lib: Library) -> DataFrame:
    return timeline.latest_first(timeline.days(lib.media_files)).limit(30).select("day", "count", "first_ts")


@query(f"select id from media_files where year(make_timestamp({TS} * 1000)) = 1995 and month(make_timestamp({TS} * 1000)) = 7", "media_files")
def period_media(lib: Library) -> DataFrame:
    return timeline.of_period(lib.media_files, "1995-07").select("id")


@query(f"select id from media_files where {TS} between epoch_ms(timestamp '1996-02-01') and epoch_ms(timestamp '1996-03-01') - 1", "media_files")
def month_media(lib: Library) -> DataFrame:
    first, last = times.month_bounds("1996-02")
    return lib.media_files.filter(times.effective_ts().between(first, last)).select("id")


@query(f"select id from media_files where {TS} >= epoch_ms(timestamp '1998-01-01') and {TS} < epoch_ms(timestamp '1999-01-01')", "media_files")
def preset_media(lib: Library) -> DataFrame:
    first, last = times.preset("last_year", date(1999, 5, 5))
    return lib.media_files.filter(times.effective_ts().between(first, last)).select("id")


# ingest


def _incoming(lib: Library) -> DataFrame:
    m = lib.media_files.filter("id % 3 = 0 or id % 29 = 0")
    changed = F.when(F.col("id") % 2 == 0, F.concat("file_hash", F.lit("x"))).otherwise(F.col("file_hash"))
    return m.withColumns({"file_hash": changed, "file_size": F.col("file_size") + 1, "orientation": F.lit(8), "rating": F.lit(0), "thumbnail_status": F.lit("pending")})


@query(
    """with incoming as (select id, file_path, case when id % 2 = 0 then file_hash || 'x' else file_hash end as file_hash, file_size + 1 as file_size, media_type from media_files where id % 3 = 0 or id % 29 = 0)
 select coalesce(s.id, n.id) as id, coalesce(n.file_hash, s.file_hash) as file_hash, coalesce(n.file_size, s.file_size) as file_size,
 cast(case when s.id is null then 8 when n.id is null or n.file_hash = s.file_hash then s.orientation else 8 end as integer) as orientation, cast(coalesce(s.rating, 0) as integer) as rating,
 case when s.id is null then 'pending' when n.id is not null and (n.file_hash <> s.file_hash or s.thumbnail_status = 'failed') then 'pending' else s.thumbnail_status end as thumbnail_status
 from stored s full join incoming n on s.file_path = n.file_path""",
    "media_files",
    "stored",
)
def upsert_media(lib: Library) -> DataFrame:
    return ingest.upsert(lib.stored, _incoming(lib)).select("id", "file_hash", "file_size", "orientation", "rating", "thumbnail_status")


_EVENTS = """
 select 1 as version, case when id % 31 = 0 then 'upsert' else 'remove' end as kind, id as seq, * replace (file_size + 1 as file_size, 'new' as file_hash, 8 - orientation as orientation) from media_files where id % 31 = 0 or id % 37 = 0
 union all select 1, 'remove', max(id) + 1, null, null, '/lib2/d7', null, null, null, null, null, null, null, null, null, null, null, null, null, null, null from media_files
 union all select 2, 'upsert', id, * replace (case when id % 3 = 0 then file_size else file_size + 2 end as file_size, 9 - orientation as orientation) from media_files where directory = '/lib2/d7' and id % 2 = 0 or id % 41 = 0
 union all select 3, 'remove', id, * from media_files where id % 43 = 0
"""


def _events(lib: Library) -> DataFrame:
    """Three batches of file events: changed and removed files and a removed folder; files that come back, or as they are stored; removed files."""
    media = lib.media_files
    put = lambda version, kind, rows: rows.select(F.lit(version).cast("long").alias("version"), F.lit(kind).alias("kind"), F.col("id").alias("seq"), *media.columns)
    changed = media.withColumns({"file_size": F.col("file_size") + 1, "file_hash": F.lit("new"), "orientation": 8 - F.col("orientation")})
    folder = media.agg((F.max("id") + 1).alias("id")).withColumn("file_path", F.lit("/lib2/d7"))
    folder = folder.select(*[(F.col(c) if c in ("id", "file_path") else F.lit(None).cast(media.schema[c].dataType)).alias(c) for c in media.columns])
    back = media.withColumns({"file_size": F.when(F.col("id") % 3 == 0, F.col("file_size")).otherwise(F.col("file_size") + 2), "orientation": 9 - F.col("orientation")})
    rows = [(1, "upsert", changed.filter("id % 31 = 0")), (1, "remove", media.filter("id % 31 <> 0 and id % 37 = 0")), (1, "remove", folder), (2, "upsert", back.filter("(directory = '/lib2/d7' and id % 2 = 0) or id % 41 = 0")), (3, "remove", media.filter("id % 43 = 0"))]
    return reduce(DataFrame.unionByName, [put(*r) for r in rows])


def _step(k: int) -> str:
    """The catalogue after batch k, plainly: rows of removed paths and folders go, then files come, but not those that a later event of the batch removes."""
    cols = {"file_size": "n.file_size", "file_hash": "n.file_hash", "file_modified_at": "n.file_modified_at", "orientation": "case when s.file_hash = n.file_hash then s.orientation else n.orientation end", "thumbnail_status": "case when s.file_hash <> n.file_hash or s.thumbnail_status = 'failed' then 'pending' else s.thumbnail_status end"}
    met = ", ".join(f"case when s.id is null then n.{c} when n.id is null or (s.file_size = n.file_size and s.file_modified_at = n.file_modified_at) then s.{c} else {cols[c]} end as {c}" for c in cols)
    same = "id", "rating", "directory"
    kept = ", ".join(f"coalesce(s.{c}, n.{c}) as {c}" for c in same)
    later = "exists (select 1 from events r where r.version = {k} and r.kind = 'remove' and (r.file_path = x.file_path or starts_with(x.file_path, r.file_path || '/')){more})"
    return f"""gone{k} as (select file_path from events where version = {k} and kind = 'remove'),
 left{k} as (select s.* from c{k - 1} s left join gone{k} a on a.file_path = s.file_path left join gone{k} b on b.file_path = s.directory where a.file_path is null and b.file_path is null),
 new{k} as (select * from events x where version = {k} and kind = 'upsert' and not {later.format(k=k, more=' and r.seq > x.seq and r.file_path = x.directory')}),
 c{k} as (select coalesce(s.file_path, n.file_path) as file_path, {kept}, {met} from left{k} s full join new{k} n on s.file_path = n.file_path)"""


@query(
    f"with events as ({_EVENTS}), c0 as (select file_path, id, rating, directory, file_size, file_hash, file_modified_at, orientation, thumbnail_status from stored), {_step(1)}, {_step(2)}, {_step(3)} select id, file_path, file_size, file_hash, orientation, rating, thumbnail_status from c3",
    "stored",
    "media_files",
)
def catalogue_after_events(lib: Library) -> DataFrame:
    return catalogue.folded(lib.stored, _events(lib)).select("id", "file_path", "file_size", "file_hash", "orientation", "rating", "thumbnail_status")


@query(
    """select coalesce(s.file_path, d.file_path) as file_path, s.id, case when d.file_path is null then 'remove' when s.id is null then 'add' when s.file_modified_at <> d.file_modified_at or s.file_size <> d.file_size then 'extract'
 when s.thumbnail_status = 'failed' then 'fix' else 'keep' end as action from stored s full join discovered d on s.file_path = d.file_path""",
    "stored",
    "discovered",
)
def reconcile_scan(lib: Library) -> DataFrame:
    return ingest.reconcile(lib.stored, lib.discovered, F.regexp_extract("file_path", "^/lib([0-9]+)/", 1).cast("long"))


@query(ORACLE_SQL["reconcile_scan"])
def reconcile_by_digests(lib: Library) -> DataFrame:
    return folder_digests.reconcile_changed(lib.stored, lib.discovered, F.regexp_extract("file_path", "^/lib([0-9]+)/", 1).cast("long"))


@query("select d.file_path from discovered d where exists (select 1 from stored s where s.file_path = d.file_path and s.file_modified_at = d.file_modified_at and s.file_size = d.file_size)", "stored", "discovered")
def unchanged_files(lib: Library) -> DataFrame:
    return ingest.unchanged(lib.stored, lib.discovered).select("file_path")


_STAMP = "strftime(o_orderdate, '{}')"
#: Names whose dates are of nine shapes, by the order's key.
_NAMES = [
    ("'WhatsApp Image ' || {} || ' at ' || {} || '.jpeg'", ("%Y-%m-%d", "%H.%M.%S")),
    ("'IMG_' || {} || '_' || {} || '.jpg'", ("%Y%m%d", "%H%M%S")),
    ("'Screenshot_' || {} || '-' || {} || '.png'", ("%Y-%m-%d", "%H-%M-%S")),
    ("'IMG-' || {} || '-WA0001.jpg'", ("%Y%m%d",)),
    ("'trip ' || {} || '.jpg'", ("%Y-%m-%d",)),
    ("'scan_' || {} || '.tif'", ("%Y%m%d",)),
    ("'FB_IMG_' || cast(epoch_ms(o_orderdate) + 400000000000 as varchar) || '.jpg'", ()),
    ("'Note_' || {} || '_' || {} || '.jpg'", ("%d%m%y", "%H%M%S")),
    ("'holiday_' || cast(o_orderkey as varchar) || '.jpg'", ()),
]
_SPARK_FORMAT = {"%Y-%m-%d": "yyyy-MM-dd", "%H.%M.%S": "HH.mm.ss", "%Y%m%d": "yyyyMMdd", "%H%M%S": "HHmmss", "%H-%M-%S": "HH-mm-ss", "%d%m%y": "ddMMyy"}


def _named(lib: Library) -> DataFrame:
    whens = []
    for k, (shape, formats) in enumerate(_NAMES):
        sql = shape.format(*[f"date_format(o_orderdate, '{_SPARK_FORMAT[f]}')" for f in formats])
        sql = sql.replace("epoch_ms(o_orderdate)", "unix_millis(cast(o_orderdate as timestamp))").replace("varchar", "string")
        whens.append(f"when {k} then {sql}")
    return lib.base("orders").select("o_orderkey", "o_orderdate", F.expr(f"case o_orderkey % 9 {' '.join(whens)} end").alias("file_name"))


_NAMED_SQL = "case o_orderkey % 9 " + " ".join(f"when {k} then {shape.format(*[_STAMP.format(f) for f in formats])}" for k, (shape, formats) in enumerate(_NAMES)) + " end"
_DAY_MS = "epoch_ms(date_trunc('day', o_orderdate))"


@query(
    f"""select o_orderkey as id, {_NAMED_SQL} as file_name, case o_orderkey % 9 when 0 then epoch_ms(date_trunc('second', o_orderdate)) when 1 then epoch_ms(date_trunc('second', o_orderdate)) when 2 then epoch_ms(date_trunc('second', o_orderdate))
 when 3 then {_DAY_MS} + 43200000 when 4 then {_DAY_MS} + 43200000 when 5 then {_DAY_MS} + 43200000 when 6 then case when epoch_ms(o_orderdate) + 400000000000 >= 1200000000000 then epoch_ms(o_orderdate) + 400000000000 end
 when 7 then case when year(o_orderdate) >= 2000 then epoch_ms(date_trunc('second', o_orderdate)) end end as captured_at from orders"""
)
def filename_dates(lib: Library) -> DataFrame:
    return _named(lib).select(F.col("o_orderkey").alias("id"), "file_name", dates.from_name(F.col("file_name"), 2026).alias("captured_at"))


_CAMERA = [("%Y:%m:%d %H:%M:%S", "yyyy:MM:dd HH:mm:ss"), ("%Y-%m-%dT%H:%M:%S", "yyyy-MM-dd'T'HH:mm:ss"), ("%Y/%m/%d %H:%M:%S", "yyyy/MM/dd HH:mm:ss"), ("%Y:%m:%d", "yyyy:MM:dd"), ("%Y-%m-%dT%H:%M:%S+02:00", "yyyy-MM-dd'T'HH:mm:ss'+02:00'")]


@query("select o_orderkey as id, case o_orderkey % 6 when 3 then epoch_ms(date_trunc('day', o_orderdate)) + 43200000 when 4 then epoch_ms(date_trunc('second', o_orderdate)) - 7200000 when 5 then null else epoch_ms(date_trunc('second', o_orderdate)) end as captured_at from orders")
def camera_dates(lib: Library) -> DataFrame:
    forms = [F.when(F.col("o_orderkey") % 6 == k, F.date_format("o_orderdate", f)) for k, (_, f) in enumerate(_CAMERA)]
    made = lib.base("orders").select("o_orderkey", F.concat(F.coalesce(*forms, F.lit("no date")), F.lit("\x00 ")).alias("text"))
    return made.select(F.col("o_orderkey").alias("id"), dates.from_camera(F.col("text")).alias("captured_at"))


@query(
    """select o_orderkey as id, case o_orderkey % 6 when 5 then null when 3 then strftime(o_orderdate, '%Y-%m-%d') || ' 12:00:00' when 4 then strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+02:00'
 when 0 then strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || case o_orderkey % 4 when 0 then '.250' when 2 then '.123457' else '' end else strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') end as shown from orders"""
)
def camera_local_times(lib: Library) -> DataFrame:
    forms = [F.when(F.col("o_orderkey") % 6 == k, F.date_format("o_orderdate", f)) for k, (_, f) in enumerate(_CAMERA)]
    fraction = F.when(F.col("o_orderkey") % 6 == 0, F.when(F.col("o_orderkey") % 4 == 0, ".25").when(F.col("o_orderkey") % 4 == 2, ".123457").otherwise(".000")).otherwise("")
    made = lib.base("orders").select("o_orderkey", F.concat(F.coalesce(*forms, F.lit("no date")), fraction, F.lit("\x00 ")).alias("text"))
    return made.select(F.col("o_orderkey").alias("id"), dates.local_text(F.col("text")).alias("shown"))


@query("select o_orderkey as id, case when o_orderkey % 3 = 2 then null else epoch_ms(date_trunc('second', o_orderdate)) end as captured_at from orders")
def sidecar_dates(lib: Library) -> DataFrame:
    seconds = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("string")
    json = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('{"photoTakenTime":{"timestamp":"'), seconds, F.lit('"}}'))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit('{"creationTime":{"timestamp":"'), seconds, F.lit('"}}'))).otherwise("{broken")
    return lib.base("orders").select(F.col("o_orderkey").alias("id"), dates.from_sidecar(json, 2026).alias("captured_at"))


@query(
    """select id, case when captured_at is not null then captured_at when id % 2 = 0 then epoch_ms(timestamp '2001-02-03 04:05:06') + 86400000 * (id % 20) when id % 3 = 0 then 1000000000000 + 1000 * id end as captured_at from media_files""",
    "media_files",
)
def repair_dates(lib: Library) -> DataFrame:
    day = F.date_format(F.date_add(F.lit("2001-02-03").cast("date"), (F.col("id") % 20).cast("int")), "yyyyMMdd")
    media = lib.media_files.withColumn("file_name", F.when(F.col("id") % 2 == 0, F.concat(F.lit("IMG_"), day, F.lit("_040506.jpg"))).otherwise("holiday.jpg"))
    text_ = F.concat(F.lit('{"photoTakenTime":{"timestamp":"'), (1_000_000_000 + F.col("id")).cast("string"), F.lit('"}}'))
    sidecars = media.filter("id % 3 = 0").select("file_path", text_.alias("json"))
    return ingest.repair_dates(media, AS_OF_YEAR, sidecars).select("id", "captured_at")


@query(
    """with shown as (select id, file_path, directory, library_id, file_size, file_modified_at, thumbnail_status from stored
  union all select id + 1000000000, upper(file_path), directory, library_id, file_size, file_modified_at, thumbnail_status from stored where id % 31 = 0
  union all select id + 2000000000, upper(file_path), directory, library_id, file_size, file_modified_at, thumbnail_status from media_files where id % 29 = 0),
 met as (select s.*, d.file_path as new_path, d.file_size as new_size, d.file_modified_at as new_time, row_number() over (partition by lower(s.file_path) order by case when s.file_path = d.file_path then 0 else 1 end, id) as k
  from shown s join discovered d on lower(d.file_path) = lower(s.file_path)),
 judged as (select *, file_size <> new_size or file_modified_at <> new_time as anew, file_path <> new_path as moved from met where k = 1)
 select id, new_path as file_path, regexp_replace(new_path, '/[^/]*$', '') as directory, library_id, case when not anew and thumbnail_status = 'failed' then 'pending' else thumbnail_status end as thumbnail_status from judged""",
    "stored",
    "media_files",
    "discovered",
)
def reconcile_fixes(lib: Library) -> DataFrame:
    columns = ["id", "file_path", "directory", "library_id", "file_size", "file_modified_at", "thumbnail_status"]
    shouting = lambda df, which, more: df.filter(which).withColumns({"id": F.col("id") + more, "file_path": F.upper("file_path")}).select(*columns)
    stored = lib.stored.select(*columns).unionByName(shouting(lib.stored, "id % 31 = 0", 1_000_000_000)).unionByName(shouting(lib.media_files, "id % 29 = 0", 2_000_000_000))
    plan = ingest.reconcile_cased(stored, lib.discovered, F.regexp_extract("file_path", "^/lib([0-9]+)/", 1).cast("long"))
    return ingest.apply_fixes(stored, plan, 1).select("id", "file_path", "directory", "library_id", "thumbnail_status")


@query("select id, file_path from media_files where id % 7 = 0", "media_files")
def deleted_paths(lib: Library) -> DataFrame:
    return curation.deleted_paths(lib.media_files, lib.media_files.filter("id % 7 = 0").select("id"))


@query(
    """select distinct file_hash, case when h % 3 = 0 then 'thumbnails/' || file_hash[1:2] || '/' || file_hash || '.jpg' when h % 3 = 1 then 'thumbnails/' || file_hash[1:2] || '/' || file_hash || '.webp' end as preview
 from (select file_hash, ascii(file_hash) as h from media_files)""",
    "media_files",
)
def cached_previews(lib: Library) -> DataFrame:
    # by the hash's first character: both, a webp and an empty jpg, or nothing
    hashes = lib.media_files.select("file_hash", ops.thumbnail_path(F.col("file_hash")).alias("path"), (F.ascii("file_hash") % 3).alias("h"))
    webp = F.regexp_replace("path", r"\.jpg$", ".webp")
    cache = hashes.filter("h < 2").select("path", F.when(F.col("h") == 0, 500).otherwise(10).alias("bytes")).unionByName(hashes.filter("h < 2").select(webp.alias("path"), F.lit(900).alias("bytes")))
    return ops.cached_preview(hashes, cache)


@query("select id, latitude, longitude from media_files where latitude is not null", "media_files")
def iso6709(lib: Library) -> DataFrame:
    points = lib.media_files.filter("latitude is not null").select("id", F.concat(F.format_string("%+08.3f%+09.3f/", "latitude", "longitude")).alias("s"))
    lat, lon = geo.iso6709(F.col("s"))
    return points.select("id", lat.alias("latitude"), lon.alias("longitude"))


@query(
    """select id, case lower(regexp_extract(file_name, '\\.([^.]*)$', 1)) when 'mp4' then 'video' when 'cr2' then 'raw' else 'photo' end as media_type,
 case lower(regexp_extract(file_name, '\\.([^.]*)$', 1)) when 'mp4' then 'video/mp4' when 'cr2' then 'image/x-canon-cr2' else 'image/jpeg' end as mime_type from media_files""",
    "media_files",
)
def classify_media(lib: Library) -> DataFrame:
    kind, mime = ingest.classify(F.col("file_name"))
    return lib.media_files.select("id", kind.alias("media_type"), mime.alias("mime_type"))


@query("select id, id % 4 < 3 as ignored from media_files", "media_files")
def ignored_paths(lib: Library) -> DataFrame:
    tail = F.regexp_replace("file_path", "^/", "")
    path = F.when(F.col("id") % 4 == 0, F.concat(F.lit("/nas/@eaDir/"), tail)).when(F.col("id") % 4 == 1, F.concat(F.lit("/nas/x.LRDATA/"), tail)).when(F.col("id") % 4 == 2, F.concat(F.lit("/nas/.hidden/"), tail)).otherwise(F.concat(F.lit("/nas/./_ok/../"), tail))
    return lib.media_files.select("id", ingest.ignored_path(path).alias("ignored"))


@query("select file_path, library_id from media_files", "media_files")
def library_for_path(lib: Library) -> DataFrame:
    wide = lib.libraries.unionByName(lib.spark.createDataFrame([(900, "/", True, 0), (901, "/lib1/d1/", False, 0)], "id long, path string, is_active boolean, created_at long"))
    return ingest.library_of(lib.media_files, wide)


@query("select id from media_files where directory = '/lib1/d1'", "media_files")
def subtree(lib: Library) -> DataFrame:
    return ingest.under(lib.media_files, "/lib1/d1").select("id")


@query("select m.id, m.file_path from media_files m where not exists (select 1 from discovered d where d.file_path = m.file_path)", "media_files", "discovered")
def prune_missing(lib: Library) -> DataFrame:
    return ingest.missing(lib.media_files, lib.discovered)


@query("select id, file_path from (select *, row_number() over (partition by lower(regexp_replace(file_path, '[0-9]+\\.', '.')) order by id desc) as k from media_files) where k > 1", "media_files")
def prune_repeated(lib: Library) -> DataFrame:
    cut = lib.media_files.withColumns({"whole": F.col("file_path"), "file_path": F.regexp_replace("file_path", r"[0-9]+\.", ".")})
    gone = ingest.repeated_paths(cut).select("id")
    return lib.media_files.join(gone, "id", "left_semi").select("id", "file_path")


@query()
def content_hash(lib: Library) -> DataFrame:
    return lib.base("documents").select("doc_id", ingest.content_hash(F.col("text").cast("binary")).alias("file_hash"))


# people


@query(
    """select p.id, p.name, p.cover_face_id, m.file_path as cover_file_path, (select count(distinct media_id) from media_faces f where f.person_id = p.id) as face_count
 from persons p left join media_faces c on c.id = p.cover_face_id left join media_files m on m.id = c.media_id""",
    "persons",
    "media_faces",
    "media_files",
)
def people_list(lib: Library) -> DataFrame:
    return people.people(lib.persons, lib.media_faces, lib.media_files).select("id", "name", "cover_face_id", "cover_file_path", "face_count")


@query("select id, name from persons p where name is null and (select count(distinct media_id) from media_faces f where f.person_id = p.id) >= 2", "persons", "media_faces")
def people_filter(lib: Library) -> DataFrame:
    return people.named(people.people(lib.persons, lib.media_faces, lib.media_files), "Unnamed", 2).select("id", "name")


@query("select id, file_path from media_files where id in (select media_id from media_faces where person_id = 2)", "media_files", "media_faces")
def person_media(lib: Library) -> DataFrame:
    return people.media_of(2, lib.media_faces, lib.media_files).select("id", "file_path")


@query("select f.id, f.media_id, f.person_id, p.name as person_name, f.confidence from media_faces f left join persons p on p.id = f.person_id", "media_faces", "persons")
def media_faces(lib: Library) -> DataFrame:
    return people.faces_with_names(lib.media_faces, lib.persons).select("id", "media_id", "person_id", "person_name", "confidence")


_CENTROIDS = """with each as (select person_id, k, sum(cast(embedding[k] as double)) as x from media_faces, range(1, 65) r(k) where person_id is not null group by 1, 2),
 unit as (select person_id, k, x / sqrt(sum(x * x) over (partition by person_id)) as x from each)"""


@query(f"{_CENTROIDS} select person_id, round(sum(x * k), 4) as moment, round(max(x), 4) as largest, (select count(*) from media_faces f where f.person_id = u.person_id) as face_count from unit u group by person_id", "media_faces")
def person_centroids(lib: Library) -> DataFrame:
    moment = F.aggregate(F.transform("centroid", lambda x, k: x * (k + 1)), F.lit(0.0), lambda a, x: a + x)
    return people.centroids(lib.media_faces).select("person_id", F.round(moment, 4).alias("moment"), F.round(F.array_max("centroid"), 4).alias("largest"), "face_count")


@query(
    f"""{_CENTROIDS}, likeness as (select f.id, u.person_id, round(sum(cast(f.embedding[u.k] as double) * u.x), 6) as likeness from media_faces f, unit u group by 1, 2)
 select id, case when likeness >= 0.6 then person_id end as person_id, likeness from (select *, row_number() over (partition by id order by likeness desc, person_id) as r from likeness) where r = 1""",
    "media_faces",
)
def face_match(lib: Library) -> DataFrame:
    return people.match(lib.media_faces, people.centroids(lib.media_faces))


@query("select count(*) filter (media_type in ('photo', 'raw')) as total, count(*) filter (media_type in ('photo', 'raw') and face_scanned) as scanned, (select count(*) from media_faces) as faces, (select count(*) from persons) as people from media_files", "media_files", "media_faces", "persons")
def face_scan_stats(lib: Library) -> DataFrame:
    return people.scan_stats(lib.media_files, lib.media_faces, lib.persons)


@query("select id, file_path from media_files where not face_scanned and media_type in ('photo', 'raw') order by id limit 15", "media_files")
def face_queue(lib: Library) -> DataFrame:
    return people.scan_queue(lib.media_files).select("id", "file_path")


@query("select id, case when id % 6 = 1 then 3 when id = 12 then 900 else person_id end as person_id from media_faces", "media_faces")
def faces_assigned(lib: Library) -> DataFrame:
    given = lib.media_faces.filter("id % 6 = 1").select("id", F.lit(3).cast("long").alias("person_id"))
    return people.create_person(lib.persons, people.assign(lib.media_faces, given), 900, "new", 12)[1].select("id", "person_id")


@query("select id, case when id = 2 then 'someone' else name end as name, cover_face_id from persons union all select 900, 'new', 12", "persons")
def people_changed(lib: Library) -> DataFrame:
    return people.rename(people.create_person(lib.persons, lib.media_faces, 900, "new", 12)[0], 2, "someone")


@query("select id, media_id, person_id from media_faces union all select id + 1000000, media_id, null from media_faces where id % 10 = 3", "media_faces")
def faces_inserted(lib: Library) -> DataFrame:
    found = lib.media_faces.filter("id % 10 = 3")
    return people.insert_faces(lib.media_faces, found.unionByName(found.withColumn("id", F.col("id") + 1_000_000))).select("id", "media_id", "person_id")


@query("select f.id as face_id, f.media_id, m.file_path, m.orientation from media_faces f join media_files m on m.id = f.media_id where f.id = 4 limit 1", "media_faces", "media_files")
def face_crop_source(lib: Library) -> DataFrame:
    return people.face_crop_source(4, lib.media_faces, lib.media_files).select("face_id", "media_id", "file_path", "orientation")


@query("select id, round(greatest(least(bbox_x + bbox_w, 0.7) - greatest(bbox_x, 0.2), 0) * greatest(least(bbox_y + bbox_h, 0.6) - greatest(bbox_y, 0.1), 0) / (bbox_w * bbox_h + 0.25 - greatest(least(bbox_x + bbox_w, 0.7) - greatest(bbox_x, 0.2), 0) * greatest(least(bbox_y + bbox_h, 0.6) - greatest(bbox_y, 0.1), 0)), 6) as overlap from media_faces", "media_faces")
def box_overlaps(lib: Library) -> DataFrame:
    fixed = {c: F.lit(v) for c, v in {"x": 0.2, "y": 0.1, "w": 0.5, "h": 0.5}.items()}
    return lib.media_faces.select("id", F.round(vectors.iou({c: F.col(f"bbox_{c}") for c in "xywh"}, fixed), 6).alias("overlap"))


@query("select id, case when person_id in (3, 4) then 2 else person_id end as person_id from media_faces", "media_faces")
def merge_people(lib: Library) -> DataFrame:
    return people.merge(lib.persons, lib.media_faces, 2, [2, 3, 4])[1].select("id", "person_id")


@query("select id from media_faces where confidence >= 0.62 and bbox_w > 0.025 and bbox_h > 0.025 and bbox_w / bbox_h between 0.4 and 2.2", "media_faces")
def face_candidates(lib: Library) -> DataFrame:
    return people.plausible(lib.media_faces).select("id")


_UNTURN = """(select id, case o when 2 then 1 - u when 3 then 1 - u when 5 then v when 6 then v when 7 then 1 - v when 8 then 1 - v else u end as x, case o when 3 then 1 - v when 4 then 1 - v when 5 then u when 6 then 1 - u when 7 then 1 - u when 8 then u else v end as y
 from (select id, 1 + id % 8 as o, unnest([bbox_x, bbox_x + bbox_w]) as u, unnest([bbox_y, bbox_y + bbox_h]) as v from media_faces))"""


@query(f"select id, round(least(greatest(min(x), 0), 1), 6) as x, round(least(greatest(min(y), 0), 1), 6) as y, round(least(greatest(max(x) - least(greatest(min(x), 0), 1), 0), 1), 6) as w, round(least(greatest(max(y) - least(greatest(min(y), 0), 1), 0), 1), 6) as h from {_UNTURN} group by id", "media_faces")
def bbox_untransform(lib: Library) -> DataFrame:
    box = vectors.upright_to_raw(*[F.col(f"bbox_{c}") for c in "xywh"], 1 + F.col("id") % 8)
    return lib.media_faces.select("id", box.alias("b")).select("id", *[F.round(f"b.{c}", 6).alias(c) for c in "xywh"])


@query("select id, round(greatest(bbox_x - bbox_w * 0.2, 0), 6) as x, round(greatest(bbox_y - bbox_h * 0.2, 0), 6) as y, round(least(bbox_x + bbox_w * 1.2, 1) - greatest(bbox_x - bbox_w * 0.2, 0), 6) as w, round(least(bbox_y + bbox_h * 1.2, 1) - greatest(bbox_y - bbox_h * 0.2, 0), 6) as h from media_faces", "media_faces")
def face_crops(lib: Library) -> DataFrame:
    box = vectors.face_crop(*[F.col(f"bbox_{c}") for c in "xywh"])
    return lib.media_faces.select("id", box.alias("b")).select("id", *[F.round(f"b.{c}", 6).alias(c) for c in "xywh"])


_BOXES = "select id, media_id, row_number() over (partition by media_id order by confidence desc, id) as r, bbox_x as x, bbox_y as y, bbox_w as w, bbox_h as h from media_faces"
_OVER = "greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0)"


@query(
    f"""with recursive ranked as ({_BOXES}),
 hits as (select a.media_id, a.r as r, b.r as by_r from ranked a join ranked b on a.media_id = b.media_id and b.r < a.r where ({_OVER}) / (a.w * a.h + b.w * b.h - ({_OVER})) >= 0.35),
 fates as (select media_id, list(by_r) as hit_by, r from hits group by media_id, r),
 walk(media_id, r, kept) as (select media_id, 1, [1] from ranked where r = 1
  union all select k.media_id, k.r + 1, case when len(list_intersect(k.kept, coalesce(f.hit_by, []))) > 0 then k.kept else list_append(k.kept, k.r + 1) end
  from walk k join ranked n on n.media_id = k.media_id and n.r = k.r + 1 left join fates f on f.media_id = n.media_id and f.r = n.r)
 select n.id, n.media_id from (select media_id, max_by(kept, r) as kept from walk group by 1) k join ranked n on n.media_id = k.media_id and list_contains(k.kept, n.r)""",
    "media_faces",
)
def iou_nms(lib: Library) -> DataFrame:
    return people.suppress(lib.media_faces).select("id", "media_id")


@query()
def online_clusters(lib: Library) -> DataFrame:
    return people.cluster_online(lib.media_faces)


@query("select id, case when orientation in (6) then 90 when orientation = 3 then 180 when orientation = 8 then 270 else 0 end as degrees, cast(least(5, rating) as integer) as rating from media_files", "media_files")
def orientation_degrees(lib: Library) -> DataFrame:
    return lib.media_files.select("id", vectors.degrees(F.col("orientation")).alias("degrees"), F.least(F.lit(5), "rating").alias("rating"))


@query(
    """select id, cast(case when greatest(w, h) <= 384 then w else greatest(round(w * (384.0::double / greatest(w, h))), 1) end as integer) as width, cast(case when greatest(w, h) <= 384 then h else greatest(round(h * (384.0::double / greatest(w, h))), 1) end as integer) as height,
 case when d > 1 then least(d * 0.1::double, 3) else 0.5 end as still_at from (select id, 1 + id % 5000 as w, 1 + id % 97 as h, cast(id % 50 as double) as d from media_files)""",
    "media_files",
)
def preview_plans(lib: Library) -> DataFrame:
    size = vectors.fit_within(1 + F.col("id") % 5000, 1 + F.col("id") % 97)
    return lib.media_files.select("id", size.alias("s"), vectors.seek_seconds((F.col("id") % 50).cast("double")).alias("still_at")).select("id", "s.width", "s.height", "still_at")


@query("select id, case when media_type = 'video' and id % 3 < 2 then 'pending' else thumbnail_status end as thumbnail_status from media_files", "media_files")
def film_previews_reset(lib: Library) -> DataFrame:
    path = F.when(F.col("id") % 3 == 1, "x.WEBP").when(F.col("id") % 3 == 2, "x.jpg")
    return libraries.reset_film_previews(lib.media_files.withColumn("thumbnail_path", path)).select("id", "thumbnail_status")


@query("select id, path, created_at from libraries union all select 90, '/new', 7", "libraries")
def library_registered(lib: Library) -> DataFrame:
    return libraries.register(libraries.register(lib.libraries, 90, "/new", 7), 91, "/lib1", 8).filter("is_active").select("id", "path", "created_at")


@query("select id, case when id = 3 then 'trip' else name end as name, case when id = 3 then 4 else cover_media_id end as cover_media_id from albums where id <> 5 union all select 5000, 'fresh', null", "albums")
def album_changes(lib: Library) -> DataFrame:
    made = curation.update_album(curation.create_album(lib.albums, 5000, "fresh", None, 9), 3, "trip", "d", 4)
    return curation.delete_album(made, lib.album_media, 5)[0].select("id", "name", "cover_media_id")


@query("select case when count(*) filter (name is not null and id in (4, 3, 7)) > 0 then (select id from (select p.id, p.name, count(distinct f.media_id) as n from persons p left join media_faces f on f.person_id = p.id where p.id in (4, 3, 7) group by 1, 2) where name is not null order by n desc, id limit 1) else 4 end as target from persons", "persons", "media_faces")
def merge_choice(lib: Library) -> DataFrame:
    return people.merge_choice(people.people(lib.persons, lib.media_faces, lib.media_files), [4, 3, 7])


@query("select id, 'none' as lens_model, rating from media_files", "media_files")
def columns_added(lib: Library) -> DataFrame:
    return libraries.with_columns(lib.media_files, {"lens_model": ("string", "none"), "rating": ("int", 9)}).select("id", "lens_model", "rating")


# logs and events


@query("select event_id, case when event_type in ('purchase', 'error') then 'ERROR' else 'WARN' end as level, substr(props, 1, 2000) as message from events")
def log_sanitize(lib: Library) -> DataFrame:
    level = F.when(F.col("event_type") == "purchase", "Error").otherwise(F.col("event_type"))
    return lib.base("events").select("event_id", text.log_level(level).alias("level"), text.log_message(F.col("props")).alias("message"))


@query("select event_id as seq from events where event_type = 'purchase' order by event_id desc limit 100")
def log_alerts(lib: Library) -> DataFrame:
    lines = lib.base("events").select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", F.concat(F.lit("[ERROR] "), "props")).otherwise(F.col("props")).alias("line"))
    return ops.alerts(lines).select("seq")


@query(
    """with marked as (select user_id, (epoch_us(ts) // 1000) as ms, case when (epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) over (partition by user_id order by ts, event_id) < 3600000 then 0 else 1 end as fresh, event_id, ts from events),
 numbered as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as session from marked) select user_id, min(ms) as first_ms, max(ms) as last_ms, count(*) as events from numbered group by user_id, session"""
)
def debounced_sessions(lib: Library) -> DataFrame:
    return windows.sessions(windows.timed(lib.base("events")), "user_id", 3_600_000)


@query(
    """with recursive e as (select event_id, event_type as k, epoch_us(ts) // 1000 as ms, row_number() over (partition by event_type order by epoch_us(ts) // 1000, event_id) as r from events),
 nexts as (select a.k, a.r, a.ms, (select min(b.r) from e b where b.k = a.k and b.ms > a.ms + 60000) as after from e a),
 starts(k, r, ms, after) as (select k, r, ms, after from nexts where r = 1 union all select n.k, n.r, n.ms, n.after from starts s join nexts n on n.k = s.k and n.r = s.after)
 select event_id, r - start < 30 as allowed from (select e.event_id, e.r, max(s.r) as start from e join starts s on s.k = e.k and s.r <= e.r group by 1, 2)"""
)
def log_rate_limit(lib: Library) -> DataFrame:
    return windows.rate_limited(windows.timed(lib.base("events")), "event_type", 60_000, 30).select("event_id", "allowed")
