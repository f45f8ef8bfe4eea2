"""Albums, tags, favourites and ratings.

Tables are values: every change is a new DataFrame, to be written as a new version. Links of rows that do not exist are
dropped where the change says so and kept as they are otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import extension, stem
from .ordering import number

TAG_COLOR = "#3b82f6"
MOST_STARS = 5


@dataclass(frozen=True)
class Tables:
    """The tables that refer to media; a change returns another set of them."""

    media_files: DataFrame
    albums: DataFrame
    album_media: DataFrame
    media_tags: DataFrame
    media_faces: DataFrame


def _counted(links: DataFrame, key: str) -> DataFrame:
    return links.groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("media_count"))


def albums(albums_: DataFrame, album_media: DataFrame, media: DataFrame) -> DataFrame:
    """Every album with its number of files and its cover's path and hash."""
    covers = media.select(F.col("id").alias("cover_media_id"), F.col("file_path").alias("cover_file_path"), F.col("file_hash").alias("cover_file_hash"))
    out = albums_.join(_counted(album_media, "album_id"), "id", "left").join(covers, "cover_media_id", "left")
    return out.select("id", "name", "description", "cover_media_id", "created_at", F.coalesce("media_count", F.lit(0)).alias("media_count"), "cover_file_path", "cover_file_hash")


def albums_of(media_id: int, albums_: DataFrame, album_media: DataFrame, media: DataFrame) -> DataFrame:
    """The albums that hold a file, as `albums` has them."""
    inside = album_media.filter(F.col("media_id") == media_id).select(F.col("album_id").alias("id"))
    return albums(albums_.join(inside, "id", "left_semi"), album_media, media)


def tags(tags_: DataFrame, media_tags: DataFrame) -> DataFrame:
    """Every tag with its number of files."""
    out = tags_.join(_counted(media_tags, "tag_id"), "id", "left")
    return out.select("id", "name", "color", F.coalesce("media_count", F.lit(0)).alias("media_count"))


def tags_of(media_id: int, tags_: DataFrame, media_tags: DataFrame) -> DataFrame:
    """The tags of a file; here a tag counts for one file."""
    on = media_tags.filter(F.col("media_id") == media_id).select(F.col("tag_id").alias("id"))
    return tags_.join(on, "id", "left_semi").select("id", "name", "color", F.lit(1).cast("long").alias("media_count"))


def create_album(albums_: DataFrame, id_: int, name: str, description: str | None, as_of: int) -> DataFrame:
    """With an album more; a name that is there already raises when the result is computed elsewhere, so it is looked for here."""
    if not albums_.filter(F.col("name") == name).isEmpty():
        raise ValueError(f"there is an album {name!r}")
    new = albums_.sparkSession.createDataFrame([(id_, name, description, None, as_of)], albums_.select("id", "name", "description", "cover_media_id", "created_at").schema)
    return albums_.unionByName(new, allowMissingColumns=True)


def update_album(albums_: DataFrame, id_: int, name: str, description: str | None, cover_media_id: int | None) -> DataFrame:
    """A new name and description; the cover changes only if one is given."""
    here = F.col("id") == id_
    cover = F.coalesce(F.lit(cover_media_id).cast("long"), F.col("cover_media_id"))
    return albums_.withColumns({"name": F.when(here, name).otherwise(F.col("name")), "description": F.when(here, F.lit(description)).otherwise(F.col("description")), "cover_media_id": F.when(here, cover).otherwise(F.col("cover_media_id"))})


def delete_album(albums_: DataFrame, album_media: DataFrame, id_: int) -> tuple[DataFrame, DataFrame]:
    return albums_.filter(F.col("id") != id_), album_media.filter(F.col("album_id") != id_)


def add_to_album(albums_: DataFrame, album_media: DataFrame, album_id: int, media_ids: list[int], as_of: int) -> tuple[DataFrame, DataFrame]:
    """Links that are there stay as they are; the first id becomes the cover of an album without one."""
    if not media_ids:
        return albums_, album_media
    spark = albums_.sparkSession
    new = spark.createDataFrame([(album_id, m, as_of) for m in dict.fromkeys(media_ids)], "album_id long, media_id long, added_at long")
    # the album's own links, not those of all albums, tell what is there already
    there = album_media.filter(F.col("album_id") == album_id)
    new = new.join(there, ["album_id", "media_id"], "left_anti")
    bare = (F.col("id") == album_id) & F.col("cover_media_id").isNull()
    covered = albums_.withColumn("cover_media_id", F.when(bare, F.lit(media_ids[0]).cast("long")).otherwise(F.col("cover_media_id")))
    return covered, album_media.unionByName(new)


def remove_from_album(albums_: DataFrame, album_media: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the links `removed` (album_id, media_id). A cover that is no longer in its album gives way to the file added last (the largest id of equal times)."""
    left = album_media.join(removed, ["album_id", "media_id"], "left_anti")
    newest = left.groupBy(F.col("album_id").alias("id")).agg(F.max_by("media_id", F.struct("added_at", "media_id")).alias("newest"))
    touched = removed.select(F.col("album_id").alias("id"), F.col("media_id").alias("cover_media_id")).distinct().withColumn("gone", F.lit(True))
    out = albums_.join(touched, ["id", "cover_media_id"], "left").join(newest, "id", "left")
    cover = F.when(F.col("gone"), F.col("newest")).otherwise(F.col("cover_media_id"))
    return out.withColumn("cover_media_id", cover).select(*albums_.columns), left


def upsert_tag(tags_: DataFrame, id_: int, name: str, color: str | None = None) -> DataFrame:
    """A tag of this name: a new one with this id, or the one that is there, whose colour changes only if one is given."""
    new = tags_.sparkSession.createDataFrame([(id_, name, color or TAG_COLOR)], "id long, name string, color string")
    recoloured = tags_.withColumn("color", F.when((F.col("name") == name) & F.lit(color is not None), F.lit(color)).otherwise(F.col("color")))
    return recoloured.unionByName(new.join(tags_.select("name"), "name", "left_anti").select("id", "name", "color"))


def delete_tag(tags_: DataFrame, media_tags: DataFrame, id_: int) -> tuple[DataFrame, DataFrame]:
    return tags_.filter(F.col("id") != id_), media_tags.filter(F.col("tag_id") != id_)


def add_tags(media_tags: DataFrame, links: DataFrame) -> DataFrame:
    """With the links (media_id, tag_id) that are not there yet."""
    return media_tags.unionByName(links.select("media_id", "tag_id").distinct().join(media_tags, ["media_id", "tag_id"], "left_anti"))


def remove_tags(media_tags: DataFrame, links: DataFrame) -> DataFrame:
    return media_tags.join(links, ["media_id", "tag_id"], "left_anti")


def _set(media: DataFrame, chosen: Column, column: str, value: Column, as_of: int) -> DataFrame:
    out = media.withColumn(column, F.when(chosen, value.cast(media.schema[column].dataType)).otherwise(F.col(column)))
    return out.withColumn("updated_at", F.when(chosen, F.lit(as_of)).otherwise(F.col("updated_at"))) if "updated_at" in media.columns else out


def favourite(media: DataFrame, chosen: Column, on: bool, as_of: int = 0) -> DataFrame:
    return _set(media, chosen, "is_favorite", F.lit(on), as_of)


def rate(media: DataFrame, chosen: Column, stars: int, as_of: int = 0) -> DataFrame:
    return _set(media, chosen, "rating", F.lit(min(stars, MOST_STARS)), as_of)


def orient(media: DataFrame, chosen: Column, orientation: int, as_of: int = 0) -> DataFrame:
    """Quarter turns may be given in degrees."""
    known = {90: 6, 180: 3, 270: 8}
    return _set(media, chosen, "orientation", F.lit(known.get(orientation, orientation)), as_of)


def delete_media(tables: Tables, gone: DataFrame) -> Tables:
    """Without the files `gone` (id): links and faces go with them, covers that were one are null."""
    by = lambda c: gone.select(F.col("id").alias(c)).distinct()
    covers = tables.albums.join(by("cover_media_id").withColumn("gone", F.lit(True)), "cover_media_id", "left")
    covers = covers.withColumn("cover_media_id", F.when(F.col("gone"), F.lit(None)).otherwise(F.col("cover_media_id"))).select(*tables.albums.columns)
    without = lambda t, c: t.join(by(c), c, "left_anti").select(*t.columns)
    return replace(tables, media_files=without(tables.media_files, "id"), albums=covers, album_media=without(tables.album_media, "media_id"), media_tags=without(tables.media_tags, "media_id"), media_faces=without(tables.media_faces, "media_id"))


def deleted_paths(media: DataFrame, gone: DataFrame) -> DataFrame:
    """id and file_path of the files `gone` (id) that are there: what is to be removed from the disk."""
    return media.join(gone.select("id").distinct(), "id", "left_semi").select("id", "file_path")


def newest_first(albums_: DataFrame) -> DataFrame:
    """Albums in the order of lists: the last created first (of equal times the larger id)."""
    return albums_.orderBy(F.desc("created_at"), F.desc("id"))


def by_name(rows: DataFrame) -> DataFrame:
    """Tags, and the albums of a file, in the order of lists."""
    return rows.orderBy("name", "id")


#: Ids that are put in order together.
ID_SLICE = 100_000
#: A name that ends in a number of this form may be one that another file would get.
_NUMBERED = r"^(.*)_([1-9][0-9]{0,17})$"


def export_names(media: DataFrame) -> DataFrame:
    """id and the name that each file gets in one folder, no two the same.

    The first file of a name, by id, keeps it. The others get _1, _2 and so on after its stem in the order of ids; numbers
    that would make a name that some file has of its own are left out. Names that are made so differ in their stem, their
    number or their extension, so they can't meet each other.
    """
    name = F.col("file_name")
    dot = F.when(extension(name) != "", F.concat(F.lit("."), F.regexp_extract(name, r"\.([^.]*)$", 1))).otherwise("")
    names = media.groupBy("file_name").agg(F.count(F.lit(1)).alias("n"))
    repeated = names.filter("n > 1").select(F.col("file_name").alias("of_name"))
    made = names.filter(stem(name).rlike(_NUMBERED)).select(F.concat(F.regexp_extract(stem(name), _NUMBERED, 1), dot).alias("of_name"), F.regexp_extract(stem(name), _NUMBERED, 2).cast("long").alias("number"))
    # the i-th number that is taken moves all from number - i + 1 on
    taken = number(made.join(repeated, "of_name", "left_semi").distinct(), [F.col("of_name")], F.floor(F.col("number") / ID_SLICE), [F.col("number")], "_i")
    moves = taken.select(F.col("of_name").alias("file_name"), (F.col("number") - F.col("_i")).alias("_at"), F.lit(None).cast("long").alias("id"))
    numbered = number(media.select("id", "file_name"), [name], F.floor(F.col("id") / ID_SLICE), [F.col("id")], "_n")
    # among rows and moves in one order, a row's place is its own number and what has moved it
    met = numbered.join(moves.select("file_name").distinct(), "file_name", "left_semi").select("file_name", F.col("_n").alias("_at"), "id")
    placed = number(moves.unionByName(met), [name], F.floor(F.col("_at") / ID_SLICE), [F.col("_at"), F.col("id").isNotNull()], "_place")
    moved = placed.filter("id is not null").select("id", (F.col("_place") - F.col("_at")).alias("_moved"))
    again = F.concat(stem(name), F.lit("_"), (F.col("_n") + F.coalesce("_moved", F.lit(0))).cast("string"), dot)
    return numbered.join(moved, "id", "left").select("id", F.when(F.col("_n") == 0, name).otherwise(again).alias("export_name"))
