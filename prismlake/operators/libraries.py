"""Libraries as roots of the catalogue: registering, removing, pages of a table, columns that are added later."""

from __future__ import annotations

import os
import shutil
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .curation import Tables, delete_media, export_names


def register(libraries: DataFrame, id_: int, path: str, as_of: int) -> DataFrame:
    """With a library of this path: the one that is there, active again, or a new one of this id."""
    again = libraries.withColumn("is_active", F.col("is_active") | (F.col("path") == path))
    new = libraries.sparkSession.createDataFrame([(id_, path, True, as_of)], "id long, path string, is_active boolean, created_at long")
    return again.unionByName(new.join(libraries.select("path"), "path", "left_anti").select(*new.columns), allowMissingColumns=True)


def remove(libraries: DataFrame, tables: Tables, id_: int) -> tuple[DataFrame, Tables]:
    """Without a library and its files, and what refers to these."""
    gone = tables.media_files.filter(F.col("library_id") == id_).select("id")
    return libraries.filter(F.col("id") != id_), delete_media(tables, gone)


def with_columns(df: DataFrame, wanted: dict[str, tuple[str, object]]) -> DataFrame:
    """With the columns (name: type, default) that a table of an older version lacks; those that are there stay."""
    return df.withColumns({c: F.lit(default).cast(kind) for c, (kind, default) in wanted.items() if c not in df.columns})


def reset_film_previews(media: DataFrame) -> DataFrame:
    """Films whose preview is missing or of the old kind (webp) get a new one."""
    old = F.col("thumbnail_path").isNull() | F.lower("thumbnail_path").endswith(".webp")
    return media.withColumn("thumbnail_status", F.when((F.col("media_type") == "video") & old, "pending").otherwise(F.col("thumbnail_status")))


def reset_scan(tables: Tables, persons: DataFrame) -> tuple[Tables, DataFrame]:
    """No faces, no people, and every file to be looked at again."""
    fresh = tables.media_files.withColumn("face_scanned", F.lit(False))
    return replace(tables, media_files=fresh, media_faces=tables.media_faces.limit(0)), persons.limit(0)


def mark_scanned(media: DataFrame, done: DataFrame) -> DataFrame:
    """The files `done` (id) count as looked at."""
    seen = done.select("id").distinct().withColumn("_seen", F.lit(True))
    return media.join(seen, "id", "left").withColumn("face_scanned", F.col("face_scanned") | F.coalesce("_seen", F.lit(False))).select(*media.columns)


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """The rows of one page and, if there are more, one beyond it."""
    return df.orderBy(*order).offset(offset).limit(limit + 1)


def export(media: DataFrame, folder: str) -> DataFrame:
    """Copy files into a folder that all executors share, under names that do not collide; id, export_name and ok.

    A file that cannot be read is not ok; one that was copied by an earlier attempt of the task is copied again.
    """

    def copy(parts):
        for pdf in parts:
            ok = []
            for path, name in zip(pdf["file_path"], pdf["export_name"], strict=True):
                try:
                    shutil.copyfile(path, os.path.join(folder, name))
                    ok.append(True)
                except OSError:
                    ok.append(False)
            yield pd.DataFrame({"id": pdf["id"], "export_name": pdf["export_name"], "ok": ok})

    named = media.select("id", "file_path", "file_name").join(export_names(media), "id")
    return named.select("id", "file_path", "export_name").mapInPandas(copy, "id long, export_name string, ok boolean")
