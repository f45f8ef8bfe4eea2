"""From a listing of files to rows of the catalogue: what is ignored, what a file is, what has changed, what is written."""

from __future__ import annotations

import json

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dates import from_name, from_sidecar
from ..functions.text import extension, fold, within

# fixed values: the extensions that are listed, and what they are
TYPES = {
    "jpg": ("photo", "image/jpeg"), "jpeg": ("photo", "image/jpeg"), "png": ("photo", "image/png"), "webp": ("photo", "image/webp"),
    "heic": ("photo", "image/heic"), "heif": ("photo", "image/heic"), "tiff": ("photo", "image/tiff"), "tif": ("photo", "image/tiff"),
    "avif": ("photo", "image/avif"), "dng": ("raw", "image/x-adobe-dng"), "cr2": ("raw", "image/x-canon-cr2"), "cr3": ("raw", "image/x-canon-cr2"),
    "nef": ("raw", "image/x-nikon-nef"), "arw": ("raw", "image/x-sony-arw"), "rw2": ("raw", "image/x-panasonic-rw2"),
    "orf": ("raw", "image/x-olympus-orf"), "raf": ("raw", "image/x-fuji-raf"), "mp4": ("video", "video/mp4"), "mov": ("video", "video/quicktime"),
    "m4v": ("video", "video/x-m4v"), "mkv": ("video", "video/x-matroska"), "webm": ("video", "video/webm"), "avi": ("video", "video/x-msvideo"),
}
OTHER = ("photo", "application/octet-stream")

# fixed values: names of folders and files that are never listed, whatever their case
IGNORED = (
    ".git", ".svn", "node_modules", "$recycle.bin", "system volume information",
    ".trash", ".trashes", "__macosx", ".cache", ".tmp",
    "$windows.~bt", "$winreagent", "config.msi", "recovery",
    "found.000", "found.001",
    "@eadir", "@recycle", "#recycle", "#snapshot", "@sharebin",
    ".thumbnails", ".picasaoriginals", "_gsdata_",
    "my pictures", "my music", "my videos", "application data", "local settings",
    "nethood", "printhood", "recent", "sendto", "start menu", "templates", "cookies",
)
IGNORED_ENDS = (".lrdata", ".appledouble")

#: Files up to this size are hashed whole; larger ones by their first, middle and last bytes and their size.
WHOLE, HEAD, PART = 1 << 20, 512 << 10, 64 << 10


def ignored_name(name: Column) -> Column:
    low = fold(name)
    hidden = name.startswith(".") & (F.length(name) > 1)
    return hidden | low.isin(*IGNORED) | low.endswith(IGNORED_ENDS[0]) | low.endswith(IGNORED_ENDS[1])


def ignored_path(path: Column) -> Column:
    """Whether any part of a path is ignored; . and .. are no names."""
    parts = F.filter(F.split(path, r"[/\\]"), lambda p: ~p.isin("", ".", ".."))
    return F.exists(parts, ignored_name)


def supported(name: Column) -> Column:
    return extension(name).isin(*TYPES)


def classify(name: Column) -> tuple[Column, Column]:
    """media_type and mime_type of a file name; what is not known counts as a photo."""
    ext = extension(name)
    names = lambda k: F.create_map(*[F.lit(x) for e, t in TYPES.items() for x in (e, t[k])])
    pick = lambda k: F.coalesce(F.try_element_at(names(k), ext), F.lit(OTHER[k]))
    return pick(0), pick(1)


def fast_hash(content: bytes) -> str:
    """XXH64 of a file's content as 16 hexadecimal digits; of a large file, of its parts and its size."""
    h = xxhash.xxh64()
    n = len(content)
    if n <= WHOLE:
        h.update(content)
    else:
        h.update(content[:HEAD])
        h.update(content[n // 2 : n // 2 + PART])
        h.update(content[-PART:])
        h.update(n.to_bytes(8, "little"))
    return f"{h.intdigest():016x}"


def hash_file(path: str) -> str:
    """`fast_hash` of a file, of which a large one's parts are read only."""
    with open(path, "rb") as f:
        n = f.seek(0, 2)
        f.seek(0)
        if n <= WHOLE:
            return fast_hash(f.read())
        h = xxhash.xxh64(f.read(HEAD))
        for at in (n // 2, n - PART):
            f.seek(at)
            h.update(f.read(PART))
        h.update(n.to_bytes(8, "little"))
        return f"{h.intdigest():016x}"


def file_hashes(path: Column) -> Column:
    """The fast hash of files that every executor can open; null of those that can't be read."""

    def one(p):
        try:
            return None if p is None else hash_file(p)
        except OSError:
            return None

    @F.pandas_udf("string")
    def run(paths):
        return paths.map(one, na_action=None)

    return run(path)


def content_hash(content: Column) -> Column:
    """The fast hash of binary contents (Spark's own xxhash64 has another seed)."""

    @F.pandas_udf("string")
    def run(values):
        return values.map(lambda b: None if b is None else fast_hash(bytes(b)))

    return run(content)


def reconcile(stored: DataFrame, discovered: DataFrame, library_id: Column) -> DataFrame:
    """file_path, id and what is to be done with it: `remove` (stored, not found), `add` (found, not stored), `extract` (time or size differ), `fix` (library or a failed preview to repair), `keep`.

    `stored`: id, file_path, library_id, file_size, file_modified_at, thumbnail_status; `discovered`: file_path, file_size,
    file_modified_at. `library_id` is the found file's library. A path that is found twice counts once.
    """
    found = discovered.select("file_path", F.col("file_size").alias("new_size"), F.col("file_modified_at").alias("new_time"), library_id.alias("new_library")).dropDuplicates(["file_path"])
    both = stored.select("id", "file_path", "library_id", "file_size", "file_modified_at", "thumbnail_status").join(found, "file_path", "full_outer")
    action = (
        F.when(F.col("new_time").isNull(), "remove")
        .when(F.col("id").isNull(), "add")
        .when((F.col("file_modified_at") != F.col("new_time")) | (F.col("file_size") != F.col("new_size")), "extract")
        .when((F.col("library_id") != F.col("new_library")) | (F.col("thumbnail_status") == "failed"), "fix")
        .otherwise("keep")
    )
    return both.select("file_path", "id", action.alias("action"))


def reconcile_cased(stored: DataFrame, discovered: DataFrame, library_id: Column) -> DataFrame:
    """`reconcile` where paths that differ in case only are one file, told with what a fix has to set.

    Of stored rows of one file the one whose path is the found one stays, else the smallest id; the others are removed. Of
    found paths that differ in case the least counts. id, file_path (stored, else found), action, new_path, new_directory,
    new_library, moved (the path's case differs) and retry (the preview had failed).
    """
    key = F.lower("file_path").alias("key")
    found = discovered.select(key, F.col("file_path").alias("new_path"), F.col("directory").alias("new_directory"), F.col("file_size").alias("new_size"), F.col("file_modified_at").alias("new_time"), library_id.alias("new_library"))
    found = found.groupBy("key").agg(F.min(F.struct("new_path", "new_directory", "new_size", "new_time", "new_library")).alias("f")).select("key", "f.*")
    both = stored.select(key, "id", "file_path", "library_id", "file_size", "file_modified_at", "thumbnail_status").join(found, "key", "full_outer")
    turn = F.row_number().over(Window.partitionBy("key").orderBy(F.when(F.col("file_path") == F.col("new_path"), 0).otherwise(1), "id"))
    both = both.withColumn("turn", turn).withColumns({"moved": F.coalesce(F.col("file_path") != F.col("new_path"), F.lit(False)), "retry": F.coalesce(F.col("thumbnail_status") == "failed", F.lit(False))})
    action = (
        F.when(F.col("new_path").isNull() | (F.col("turn") > 1), "remove")
        .when(F.col("id").isNull(), "add")
        .when((F.col("file_modified_at") != F.col("new_time")) | (F.col("file_size") != F.col("new_size")), "extract")
        .when(F.col("moved") | F.col("retry") | (F.col("library_id") != F.col("new_library")), "fix")
        .otherwise("keep")
    )
    return both.select("id", F.coalesce("file_path", "new_path").alias("file_path"), action.alias("action"), "new_path", "new_directory", "new_library", "moved", "retry")


def apply_fixes(stored: DataFrame, plan: DataFrame, as_of: int) -> DataFrame:
    """`stored` after a plan of reconcile_cased: without what is removed, with paths, folders and libraries set right, and previews that failed to be made again. Rows to extract anew only get their path."""
    fixed = plan.filter("id is not null and (action in ('remove', 'fix') or (action = 'extract' and moved))").select("id", "action", "new_path", "new_directory", "new_library", "retry")
    rows = stored.join(fixed, "id", "left").filter("action is null or action <> 'remove'")
    met = F.col("action").isNotNull()
    new = {"file_path": F.col("new_path"), "directory": F.col("new_directory"), "library_id": F.col("new_library"), "updated_at": F.lit(as_of)}
    status = F.when((F.col("action") == "fix") & F.col("retry"), "pending").otherwise(F.col("thumbnail_status"))
    out = {c: F.when(met, v).otherwise(F.col(c)) for c, v in new.items() if c in stored.columns} | {"thumbnail_status": status}
    return rows.select(*[out.get(c, F.col(c)).alias(c) for c in stored.columns])


def unchanged(stored: DataFrame, files: DataFrame) -> DataFrame:
    """The files (file_path, file_modified_at, file_size) that are stored as they are."""
    return files.join(stored, ["file_path", "file_modified_at", "file_size"], "left_semi")


#: Columns that an update of a stored file takes over; others keep what they have.
TAKEN = ("library_id", "directory", "file_name", "file_size", "file_modified_at", "file_hash", "width", "height", "duration", "captured_at", "captured_at_local", "timezone_offset", "latitude", "longitude", "altitude", "geohash", "camera_make", "camera_model", "lens_model", "focal_length", "aperture", "iso", "exposure_time", "updated_at")


def upsert(stored: DataFrame, incoming: DataFrame, sequence: str | None = None) -> DataFrame:
    """`stored` with the rows of `incoming` by file_path.

    A stored row takes over what describes the file; its orientation stays if the hash is the same, its preview is to be
    made again if the hash differs or the preview had failed, and what the user has set stays. Of a path that comes several
    times the row of the largest `sequence` counts (without one, of the largest id).
    """
    last = Window.partitionBy("file_path").orderBy(F.desc(sequence or "id"))
    new = incoming.withColumn("_turn", F.row_number().over(last)).filter("_turn = 1").select(*stored.columns)
    s, n = stored.alias("s"), new.alias("n")
    both = s.join(n, F.col("s.file_path") == F.col("n.file_path"), "full_outer")
    is_new, is_met = F.col("s.file_path").isNull(), F.col("s.file_path").isNotNull() & F.col("n.file_path").isNotNull()
    same = F.col("s.file_hash") == F.col("n.file_hash")
    out = []
    for c in stored.columns:
        old, fresh = F.col(f"s.{c}"), F.col(f"n.{c}")
        met = fresh if c in TAKEN else old
        if c == "orientation":
            met = F.when(same, old).otherwise(fresh)
        elif c == "thumbnail_status":
            met = F.when(~same | (old == "failed"), "pending").otherwise(old)
        out.append(F.when(is_new, fresh).when(is_met, met).otherwise(old).alias(c))
    return both.select(*out)


def repair_dates(media: DataFrame, as_of_year: int, sidecars: DataFrame | None = None) -> DataFrame:
    """captured_at of rows without one from their file names, else from `sidecars` (file_path, json)."""
    found = from_name(F.col("file_name"), as_of_year)
    out = media
    if sidecars is not None:
        out = media.join(sidecars.select("file_path", F.col("json").alias("_json")), "file_path", "left")
        found = F.coalesce(found, from_sidecar(F.col("_json"), as_of_year))
    return out.withColumn("captured_at", F.coalesce("captured_at", found)).select(*media.columns)


def sidecar_of(files: DataFrame, listing: DataFrame) -> DataFrame:
    """file_path and the sidecar that is there (listing: path), by the order of the names it may have."""
    name, path = F.col("file_name"), F.col("directory")
    base = F.regexp_replace(name, r"\.[^.]*$", "")
    names = F.array(F.concat(name, F.lit(".json")), F.concat(base, F.lit(".json")), F.concat(name, F.lit(".supplemental-metadata.json")), F.concat(F.substring(name, 1, 46), F.lit(".json")))
    candidates = files.select("file_path", F.posexplode(F.transform(names, lambda n: F.concat(path, F.lit("/"), n))).alias("k", "path"))
    return candidates.join(listing.select("path").distinct(), "path").groupBy("file_path").agg(F.min_by("path", "k").alias("sidecar"))


#: So many libraries' paths go to the tasks as they are.
FEW_ROOTS = 1024


def library_of(files: DataFrame, libraries: DataFrame) -> DataFrame:
    """file_path and library_id: the active library with the longest path that the file lies in (of equal paths the largest id); null if it lies in none.

    A file's folders are looked up in a map of the libraries' paths, from the longest on, so files don't move. If there are more than
    FEW_ROOTS of them, files meet them by their folders, by equality and not by comparing all pairs.
    """
    roots = libraries.filter("is_active").groupBy(F.regexp_replace("path", r"[/\\]+$", "").alias("root")).agg(F.max("id").alias("library_id"))
    parts = F.split("file_path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    few = roots.limit(FEW_ROOTS + 1).collect()
    if len(few) <= FEW_ROOTS:
        ids = F.from_json(F.lit(json.dumps({r["root"]: r["library_id"] for r in few})), "map<string,long>")
        within = F.filter(folders, lambda f: F.map_contains_key(ids, f))
        return files.select("file_path", F.try_element_at(ids, F.try_element_at(within, F.lit(-1))).alias("library_id"))
    each = files.select("file_path", F.explode(folders).alias("root"))
    best = each.join(roots, "root").groupBy("file_path").agg(F.max_by("library_id", F.length("root")).alias("library_id"))
    return files.select("file_path").join(best, "file_path", "left")


def under(media: DataFrame, root: str) -> DataFrame:
    """The rows of a folder and of what is below it."""
    return media.filter((F.col("file_path") == root) | within(F.col("directory"), F.lit(root)))


def repeated_paths(media: DataFrame) -> DataFrame:
    """The rows to prune: of paths that differ in case only, all but the one of the largest id."""
    order = Window.partitionBy(F.lower("file_path")).orderBy(F.desc("id"))
    return media.withColumn("_k", F.row_number().over(order)).filter("_k > 1").select("id", "file_path")


def missing(media: DataFrame, listing: DataFrame) -> DataFrame:
    """The rows to prune: not in the listing (file_path, file_size), empty there, or ignored."""
    there = listing.filter("file_size > 0").select("file_path")
    return media.join(there, "file_path", "left_anti").select("id", "file_path").unionByName(media.join(there, "file_path", "left_semi").filter(ignored_path(F.col("file_path"))).select("id", "file_path"))
