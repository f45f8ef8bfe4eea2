"""The media library's tables, derived from the driver's star schema.

Each table is one SQL text that both Spark and an oracle database can run: the only token that differs is EPOCH_MS(x),
the milliseconds since 1970 of a timestamp in UTC.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

#: Tables of the star schema that the derived tables read.
BASE = ("orders", "lineitem", "part", "supplier", "embeddings", "documents", "events", "customer")

DERIVED = {
    "media_files": """
        select id, library_id, directory || '/' || file_name as file_path, directory, file_name, file_size,
               file_modified_at, file_hash, media_type, orientation, captured_at, latitude, longitude,
               camera_make, thumbnail_status, is_favorite, rating, face_scanned
        from (
          select o_orderkey as id,
                 1 + o_orderkey % 3 as library_id,
                 '/lib' || cast(1 + o_orderkey % 3 as string) || '/d' || cast(o_custkey % 50 as string) as directory,
                 case when o_orderkey % 17 = 0 then 'copy_' when o_orderkey % 13 = 0 then 'VID_' else 'IMG_' end
                   || cast(o_orderkey as string)
                   || case when o_orderkey % 13 = 0 then '.mp4' when o_orderkey % 7 = 0 then '.CR2' else '.jpg' end as file_name,
                 1000 + (o_custkey * 37 + (o_orderkey % 4) * 11) % 900000 as file_size,
                 EPOCH_MS(o_orderdate) + 86400000 * (o_orderkey % 40) as file_modified_at,
                 md5(cast(o_custkey as string) || '-' || cast(o_orderkey % 4 as string)) as file_hash,
                 case when o_orderkey % 13 = 0 then 'video' when o_orderkey % 7 = 0 then 'raw' else 'photo' end as media_type,
                 cast(1 + o_orderkey % 8 as int) as orientation,
                 case when o_orderkey % 11 = 0 then null else EPOCH_MS(o_orderdate) end as captured_at,
                 case when o_orderkey % 5 = 0 then null
                      else cast(-90 as double) + cast((o_orderkey * 7919) % 180000 as double) / cast(1000 as double) end as latitude,
                 case when o_orderkey % 5 = 0 then null
                      else cast(-180 as double) + cast((o_orderkey * 104729) % 360000 as double) / cast(1000 as double) end as longitude,
                 case when o_orderstatus = 'F' then 'Sony' when o_orderstatus = 'O' then 'Canon' end as camera_make,
                 case when o_orderkey % 10 < 3 then 'pending' when o_orderkey % 10 = 3 then 'failed' else 'ready' end as thumbnail_status,
                 o_orderkey % 9 = 0 as is_favorite,
                 cast(o_orderkey % 6 as int) as rating,
                 o_orderkey % 2 = 0 as face_scanned
          from {orders}
        ) x
    """,
    "libraries": """
        select library_id as id, '/lib' || cast(library_id as string) as path, true as is_active, library_id * 1000 as created_at
        from (select distinct 1 + o_orderkey % 3 as library_id from {orders}) x
    """,
    "albums": """
        select s_suppkey as id, s_name as name, cast(null as string) as description,
               case when s_suppkey % 10 = 0 then null else m.cover end as cover_media_id,
               s_suppkey * 1000 as created_at
        from {supplier} left join (select l_suppkey, min(l_orderkey) as cover from {lineitem} group by l_suppkey) m on s_suppkey = m.l_suppkey
    """,
    "album_media": """
        select l_suppkey as album_id, l_orderkey as media_id, max(EPOCH_MS(l_shipdate)) as added_at
        from {lineitem} group by l_suppkey, l_orderkey
    """,
    "tags": """
        select cast(p_size as bigint) as id, 'tag_' || cast(p_size as string) as name,
               case when p_size % 2 = 0 then '#3b82f6' else '#10b981' end as color
        from (select distinct p_size from {part}) x
    """,
    "media_tags": """
        select distinct l_orderkey as media_id, cast(p_size as bigint) as tag_id
        from {lineitem} join {part} on l_partkey = p_partkey
    """,
    "persons": """
        select cast(label + 1 as bigint) as id,
               case when label % 3 = 0 then null else 'person_' || cast(label as string) end as name,
               min(vec_id) as cover_face_id
        from {embeddings} group by label
    """,
    "media_faces": """
        select vec_id as id, vec_id % 400 as media_id,
               case when vec_id % 10 = 0 then null else cast(label + 1 as bigint) end as person_id,
               cast(vec_id % 7 as double) / cast(10 as double) as bbox_x, cast(vec_id % 5 as double) / cast(10 as double) as bbox_y,
               cast(1 + vec_id % 3 as double) / cast(10 as double) as bbox_w, cast(1 + vec_id % 4 as double) / cast(10 as double) as bbox_h,
               cast(50 + vec_id % 50 as double) / cast(100 as double) as confidence, embedding
        from {embeddings}
    """,
    "discovered": """
        select file_path, directory, file_size, file_modified_at + case when id % 19 = 0 then 1 else 0 end as file_modified_at
        from {media_files} where id % 23 <> 0
    """,
    "stored": """
        select * from {media_files} where id % 29 <> 0
    """,
}

_EPOCH = re.compile(r"EPOCH_MS\(([^()]+)\)")


def oracle_with(*names: str) -> str:
    """A WITH clause of the named derived tables and of those they read, for the oracle database."""
    need: list[str] = []

    def visit(name: str) -> None:
        for used in re.findall(r"\{(\w+)\}", DERIVED[name]):
            if used in DERIVED:
                visit(used)
        if name not in need:
            need.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} as ({_EPOCH.sub(lambda m: f'epoch_ms({m[1]})', re.sub(r'[{}]', '', DERIVED[n])).strip()})" for n in need]
    return "with " + ",\n".join(parts)


class Library:
    """The tables of a library as DataFrames, each built when it is first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _derived(self, name: str) -> DataFrame:
        text = _EPOCH.sub(lambda m: f"unix_millis(cast({m[1]} as timestamp))", DERIVED[name])
        used = {t: getattr(self, t) if t in DERIVED else self.base(t) for t in re.findall(r"\{(\w+)\}", text)}
        return self.spark.sql(text, **used)


def _table(name: str) -> cached_property:
    found = cached_property(lambda self: self._derived(name))
    found.__set_name__(Library, name)
    return found


for _name in DERIVED:
    setattr(Library, _name, _table(_name))
