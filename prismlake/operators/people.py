"""People: faces, who they are, how alike they are, and merging."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import LEAST_NORM, dot, iou
from . import online_clusters
from .best_person import FACES_A_STEP, _usable, best_person

#: Least likeness of a face to a person, and least overlap that makes two boxes one.
MATCH, OVERLAP = 0.60, 0.35
LEAST_SCORE, LEAST_SIDE, ASPECTS = 0.62, 0.025, (0.4, 2.2)


def people(persons: DataFrame, faces: DataFrame, media: DataFrame) -> DataFrame:
    """Every person with the number of files they are on and their cover face's file."""
    counts = faces.filter("person_id is not null").groupBy(F.col("person_id").alias("id")).agg(F.count_distinct("media_id").alias("face_count"))
    covers = faces.select(F.col("id").alias("cover_face_id"), F.col("media_id").alias("cover_media_id"))
    files = media.select(F.col("id").alias("cover_media_id"), F.col("file_path").alias("cover_file_path"), F.col("file_hash").alias("cover_file_hash"))
    out = persons.join(covers, "cover_face_id", "left").join(files, "cover_media_id", "left").join(counts, "id", "left")
    return out.select("id", "name", "cover_face_id", "cover_file_path", "cover_file_hash", F.coalesce("face_count", F.lit(0)).alias("face_count"))


def most_seen_first(people_: DataFrame) -> DataFrame:
    """People in the order of lists: by the number of their files, of equal ones the smaller id."""
    return people_.orderBy(F.desc("face_count"), "id")


def insert_faces(faces: DataFrame, new: DataFrame) -> DataFrame:
    """With the faces `new`, of no person yet; an id that is there stays as it is."""
    fresh = new.dropDuplicates(["id"]).join(faces.select("id"), "id", "left_anti").withColumn("person_id", F.lit(None).cast("long"))
    return faces.unionByName(fresh.select(*[F.col(c) if c in fresh.columns else F.lit(None).cast(faces.schema[c].dataType).alias(c) for c in faces.columns]))


def assign(faces: DataFrame, given: DataFrame) -> DataFrame:
    """Faces with the persons that `given` (id, person_id) says; of a face that is given twice the largest person counts, null takes the person away."""
    last = given.groupBy("id").agg(F.max("person_id").alias("_to"), F.lit(True).alias("_given"))
    to = F.when(F.col("_given"), F.col("_to")).otherwise(F.col("person_id"))
    return faces.join(last, "id", "left").withColumn("person_id", to).select(*faces.columns)


def create_person(persons: DataFrame, faces: DataFrame, id_: int, name: str | None, cover_face_id: int) -> tuple[DataFrame, DataFrame]:
    """With a person more, whose cover is a face that becomes theirs."""
    spark = persons.sparkSession
    new = spark.createDataFrame([(id_, name, cover_face_id)], "id long, name string, cover_face_id long")
    return persons.unionByName(new, allowMissingColumns=True), assign(faces, spark.createDataFrame([(cover_face_id, id_)], "id long, person_id long"))


def rename(persons: DataFrame, id_: int, name: str | None) -> DataFrame:
    return persons.withColumn("name", F.when(F.col("id") == id_, F.lit(name)).otherwise(F.col("name")))


def named(people_: DataFrame, q: str = "", min_count: int = 0) -> DataFrame:
    """People on at least so many files whose name has the text in it; no name reads `unnamed`."""
    name = F.coalesce(F.lower(F.nullif(F.col("name"), F.lit(""))), F.lit("unnamed"))
    return people_.filter((F.col("face_count") >= min_count) & name.contains(q.strip().lower()))


def media_of(person_id: int, faces: DataFrame, media: DataFrame) -> DataFrame:
    return media.join(faces.filter(F.col("person_id") == person_id).select(F.col("media_id").alias("id")), "id", "left_semi")


def faces_with_names(faces: DataFrame, persons: DataFrame) -> DataFrame:
    return faces.join(persons.select(F.col("id").alias("person_id"), F.col("name").alias("person_name")), "person_id", "left")


def face_crop_source(face_id: int, faces: DataFrame, media: DataFrame) -> DataFrame:
    one = faces.filter(F.col("id") == face_id).select(F.col("id").alias("face_id"), "media_id", "bbox_x", "bbox_y", "bbox_w", "bbox_h")
    return one.join(media.select(F.col("id").alias("media_id"), "file_path", "file_hash", "orientation"), "media_id").limit(1)


def _person_sums(final: bool):
    """Rows (person_id, vector, faces) added up by person. Of rows in order of persons each person's sum once (`final`), else each batch's."""

    def added(ids: np.ndarray, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(ids, kind="stable")
        ids, x, n = ids[order], x[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        return ids[first], np.add.reduceat(x, first, axis=0), np.add.reduceat(n, first)

    def rows(ids: np.ndarray, x: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).reshape(-1)))
        return pa.RecordBatch.from_arrays([pa.array(ids), vectors, pa.array(n)], names=["person_id", "vector", "faces"])

    def run(batches):
        held = None
        for batch in batches:
            for at in range(0, batch.num_rows, FACES_A_STEP):
                part = batch.slice(at, FACES_A_STEP)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                got = part.column(0).to_numpy(), x, part.column(2).to_numpy()
                if held is not None:
                    got = tuple(np.concatenate([a, b]) for a, b in zip(held, got, strict=True))
                got = added(*got)
                if not final:
                    yield rows(*got)
                    continue
                # the last person may go on
                held = tuple(v[-1:] for v in got)
                if len(got[0]) > 1:
                    yield rows(*(v[:-1] for v in got))
        if held is not None:
            yield rows(*held)

    return run


def centroids(faces: DataFrame) -> DataFrame:
    """person_id, centroid and face_count: the sum of a person's vectors, scaled to length one. Vectors are of one length and hold no nulls; faces without a vector count, but add nothing, and a person with no other has no row.

    Vectors are added up a batch at a time before they move, so that a person of any number of faces is a row for each batch.
    """
    some = faces.filter("person_id is not null and embedding is not null").select("person_id", F.col("embedding").cast("array<double>").alias("vector"), F.lit(1).cast("long").alias("faces"))
    schema = "person_id long, vector array<double>, faces long"
    each = some.mapInArrow(_person_sums(False), schema)
    whole = each.repartition("person_id").sortWithinPartitions("person_id").mapInArrow(_person_sums(True), schema)
    n = F.sqrt(dot(F.col("vector"), F.col("vector")))
    unit = F.when(n > LEAST_NORM, F.transform("vector", lambda x: x / n)).otherwise(F.col("vector"))
    out = whole.select("person_id", unit.alias("centroid"), "faces")
    without = faces.filter("person_id is not null and embedding is null").groupBy("person_id").agg(F.count(F.lit(1)).alias("more"))
    return out.join(without, "person_id", "left").select("person_id", "centroid", (F.col("faces") + F.coalesce("more", F.lit(0))).alias("face_count"))


def match(faces: DataFrame, centroids_: DataFrame, least: float = MATCH) -> DataFrame:
    """id and person_id and likeness of every face: the person it is most like, if it is enough; ties to the smaller id."""
    best = best_person(faces, centroids_)
    return best.select("id", F.when(F.col("likeness") >= least, F.col("person_id")).alias("person_id"), "likeness")


def scan_stats(media: DataFrame, faces: DataFrame, persons: DataFrame) -> DataFrame:
    """One row: files that can have faces, those looked at, faces and people."""
    able = F.col("media_type").isin("photo", "raw")
    one = media.agg(F.count_if(able).alias("total"), F.count_if(able & F.col("face_scanned")).alias("scanned"))
    return one.crossJoin(faces.agg(F.count(F.lit(1)).alias("faces"))).crossJoin(persons.agg(F.count(F.lit(1)).alias("people")))


def scan_queue(media: DataFrame, limit: int = 15) -> DataFrame:
    """The next files to look at: the smallest ids."""
    return media.filter(~F.col("face_scanned") & F.col("media_type").isin("photo", "raw")).select("id", "file_path", "file_hash").orderBy("id").limit(limit)


def merge(persons: DataFrame, faces: DataFrame, target: int, sources: list[int]) -> tuple[DataFrame, DataFrame]:
    """The sources' faces become the target's and the sources go; the target among the sources is passed over."""
    others = [s for s in sources if s != target]
    moved = F.when(F.col("person_id").isin(others), F.lit(target).cast("long")).otherwise(F.col("person_id")) if others else F.col("person_id")
    return persons.filter(~F.col("id").isin(others)) if others else persons, faces.withColumn("person_id", moved)


def merge_choice(people_: DataFrame, selected: list[int]) -> DataFrame:
    """target, one row: the first of the selected in the list's order (most files first, then smaller id) that has a name, else the first selected."""
    named_ = F.col("id").isin(selected) & (F.coalesce("name", F.lit("")) != "")
    first = F.min_by("id", F.when(named_, F.struct(-F.col("face_count"), F.col("id"))))
    return people_.filter(named_).agg(F.coalesce(first, F.lit(selected[0]).cast("long")).alias("target"))


def merge_target(people_: DataFrame, selected: list[int]) -> int:
    """merge_choice as a number."""
    return merge_choice(people_, selected).first()["target"]


def plausible(candidates: DataFrame) -> DataFrame:
    """Detector boxes that may be faces: sure enough, not tiny, neither flat nor tall."""
    aspect = F.when(F.col("bbox_h") > 0, F.col("bbox_w") / F.col("bbox_h")).otherwise(0.0)
    return candidates.filter((F.col("confidence") >= LEAST_SCORE) & (F.col("bbox_w") > LEAST_SIDE) & (F.col("bbox_h") > LEAST_SIDE) & aspect.between(*ASPECTS))


def suppress(boxes: DataFrame, overlap: float = OVERLAP) -> DataFrame:
    """Of each file's boxes those that no surer kept one overlaps; surer first, ties by id. A file has a handful of boxes, so they are one array."""
    sides = ("x", "y", "w", "h")
    entry = F.struct((-F.col("confidence")).alias("order"), "id", *[F.col(f"bbox_{c}").cast("double").alias(c) for c in sides])
    of = lambda b: {c: b[c] for c in sides}
    each = boxes.groupBy("media_id").agg(F.array_sort(F.collect_list(entry)).alias("boxes"))
    none = F.filter("boxes", lambda _: F.lit(False))
    keep = F.aggregate("boxes", none, lambda kept, b: F.when(F.exists(kept, lambda k: iou(of(k), of(b)) >= overlap), kept).otherwise(F.concat(kept, F.array(b))))
    return boxes.join(each.select(F.explode(keep).alias("k")).select("k.id"), "id", "left_semi").select(*boxes.columns)


def cluster_online(faces: DataFrame, least: float = MATCH, group: str | None = None) -> DataFrame:
    """id, scope and cluster (its first face) of every face, met in the order of ids: it joins the most alike running centroid if that is enough (ties to the older one), else begins a cluster.

    The order makes the result, so what is met in order is one task's work, but of large scopes only faces that are like
    another one (online_clusters). `group` names a column (a library, an event) within which clusters form. Without one,
    faces first meet those of the same largest component, and then the clusters that have formed meet each other in the
    same way, in the order of their first faces and each with the weight of its faces. Only vectors of one length meet; a face
    whose vector is null, empty or holds nulls or no numbers is a cluster of its own.
    """
    largest = F.array_position("embedding", F.array_max("embedding"))
    rows = faces.select("id", F.col("embedding").cast("array<double>").alias("vector"), (F.col(group) if group else largest).cast("string").alias("scope"), _usable("embedding").alias("usable"))
    able = rows.filter("usable").select(F.concat_ws(":", F.size("vector").cast("string"), "scope").alias("at"), "scope", "id", "vector", F.lit(1.0).alias("faces"))
    alone = rows.filter(~F.col("usable")).select("id", "scope", F.col("id").alias("cluster"))
    found = online_clusters.met(able, least)
    of_face = found.filter("id is not null").select("id", "scope", "cluster")
    if group:
        return of_face.unionByName(alone)
    tops = found.filter("id is null").select(F.size("centroid").cast("string").alias("at"), F.lit(None).cast("string").alias("scope"), F.col("cluster").alias("id"), F.col("centroid").alias("vector"), "faces")
    merged = online_clusters.met(tops, least).filter("id is not null").select(F.col("id").alias("cluster"), F.col("cluster").alias("merged"))
    return of_face.join(merged, "cluster").select("id", "scope", F.col("merged").alias("cluster")).unionByName(alone)
