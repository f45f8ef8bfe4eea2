"""The most alike of many persons for each face, without comparing all pairs.

Persons lie in cells around pivots (persons that are far from each other). Of a cell its radius is known, so by the
inequality of Cauchy and Schwarz a face f is like nobody in it by more than f.pivot + |f| * radius, and like somebody by
f.pivot. A face asks only the cells that can hold somebody at least as alike as its best pivot is; the answer is the same as if
it had asked all. There are at most MOST_CELLS pivots, so tasks get them whole; cells of more than PERSONS_A_BLOCK persons are
several blocks. So few persons that they are one block go to the tasks as they are. Faces travel packed, a row for each task's batch and cell, and meet the cell's blocks by an equi-join, which
Spark splits where a cell is hot.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_CELLS, PERSONS_A_BLOCK = 4096, 1024
#: Persons of which pivots are chosen, for each cell.
DRAWS = 8
#: Likeness is told to six digits, so what is less apart may be equal; and faces that are compared at a time.
SLACK, FACES_A_STEP = 2e-6, 2048


@dataclass
class Cells:
    """Pivots (one a row), how far members of each cell are from it, and the length of vectors."""

    pivots: np.ndarray
    radius: np.ndarray | None = None

    @property
    def width(self) -> int:
        return self.pivots.shape[1]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector, and how far it is from the pivot."""
        away = (self.pivots**2).sum(axis=1)[None] - 2 * (x @ self.pivots.T)
        best = away.argmin(axis=1)
        return best, np.sqrt(((x - self.pivots[best]) ** 2).sum(axis=1))

    def ask(self, x: np.ndarray) -> np.ndarray:
        """Which cells (columns) can hold the most alike person of each vector (rows)."""
        like = x @ self.pivots.T
        reach = like + np.sqrt((x**2).sum(axis=1))[:, None] * self.radius
        return reach >= like.max(axis=1, keepdims=True) - SLACK


def far_apart(x: np.ndarray, n: int) -> np.ndarray:
    """At most n of the vectors, each the farthest from those before it."""
    chosen = [0]
    away = ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < n and away.max() > 0:
        k = int(away.argmax())
        chosen.append(k)
        away = np.minimum(away, ((x - x[k]) ** 2).sum(axis=1))
    return x[chosen]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _usable(column: str, width: int | None = None):
    whole = F.forall(column, lambda v: F.coalesce(v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(column) == width if width is not None else F.size(column) > 0) & whole, F.lit(False))


def cells_of(persons: DataFrame) -> tuple[Cells | None, DataFrame | None]:
    """The cells of `persons` (person_id, centroid), and the persons with their cell. Centroids of another length than most, and those with nulls or no numbers, are nobody's."""
    some = persons.filter(_usable("centroid"))
    widths = some.groupBy(F.size("centroid").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if widths is None:
        return None, None
    some = some.filter(F.size("centroid") == widths["width"]).select("person_id", F.col("centroid").cast("array<double>").alias("centroid"))
    n = min(MOST_CELLS, max(1, math.isqrt(widths["n"]) * 2))
    unit = F.shiftrightunsigned(F.xxhash64("person_id"), 11).cast("double") / float(1 << 53)
    drawn = some.filter(unit < min(1.0, 2.0 * n * DRAWS / widths["n"])).orderBy(F.xxhash64("person_id"), "person_id").limit(n * DRAWS).select("centroid").collect()
    cells = Cells(far_apart(np.array([r["centroid"] for r in drawn]), n))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cell, away = cells.nearest(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(away)], names=["person_id", "centroid", "cell", "away"])

    placed = some.mapInArrow(run, "person_id long, centroid array<double>, cell int, away double")
    radius = np.full(len(cells.pivots), -np.inf)
    for r in placed.groupBy("cell").agg(F.max("away").alias("radius")).collect():
        # rounding is on the side of asking
        radius[r["cell"]] = r["radius"] * (1 + 1e-9) + 1e-9
    cells.radius = radius
    return cells, placed


def _packed(cells: Cells):
    """Faces by the cells that they ask: a row for each cell of a batch."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, FACES_A_STEP):
                part = batch.slice(at, FACES_A_STEP)
                x, ids = _matrix(part.column(1)), part.column(0).to_numpy()
                asked = cells.ask(x)
                rows = [(int(c), ids[hit].tobytes(), x[hit].tobytes()) for c in np.flatnonzero(asked.any(axis=0)) for hit in [asked[:, c]]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["cell", "ids", "faces"])

    return run


def _best(x: np.ndarray, persons: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The greatest likeness of each face, and who has it: of equal likeness to six digits the smaller id."""
    like = np.round(x @ centroids.T, 6)
    best = like.max(axis=1)
    return best, np.where(like == best[:, None], persons[None], np.iinfo(np.int64).max).min(axis=1)


FOUND = "id long, likeness double, person_id long, compared long"


def _row(ids: np.ndarray, best: np.ndarray, who: np.ndarray, compared: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(best), pa.array(who), pa.array(np.full(len(ids), compared))], names=["id", "likeness", "person_id", "compared"])


def _others(faces: DataFrame, width: int) -> DataFrame:
    """Rows for faces that can't be compared."""
    return faces.filter(~_usable("embedding", width)).select(F.col("id").cast("long"), F.lit(None).cast("long").alias("person_id"), F.lit(None).cast("double").alias("likeness"), F.lit(0).cast("long").alias("compared"))


def _among_few(faces: DataFrame, few: list) -> DataFrame:
    """best_person of at most PERSONS_A_BLOCK persons."""
    lengths = [len(r["centroid"]) for r in few]
    width = max(set(lengths), key=lambda w: (lengths.count(w), w))
    few = [r for r in few if len(r["centroid"]) == width]
    persons, centroids = np.array([r["person_id"] for r in few], dtype=np.int64), np.array([r["centroid"] for r in few])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, FACES_A_STEP):
                part = batch.slice(at, FACES_A_STEP)
                yield _row(part.column(0).to_numpy(), *_best(_matrix(part.column(1)), persons, centroids), len(persons))

    able = faces.filter(_usable("embedding", width)).select(F.col("id").cast("long"), F.col("embedding").cast("array<double>"))
    return able.mapInArrow(run, FOUND).select("id", "person_id", "likeness", "compared").unionByName(_others(faces, width))


def _compared(width: int):
    """The most alike person of a block for each packed face."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                ids = np.frombuffer(batch.column(0)[k].as_py(), np.int64)
                x = np.frombuffer(batch.column(1)[k].as_py(), np.float64).reshape(-1, width)
                persons = batch.column(2)[k].values.to_numpy()
                yield _row(ids, *_best(x, persons, _matrix(batch.column(3)[k].values)), len(persons))

    return run


def best_person(faces: DataFrame, persons: DataFrame) -> DataFrame:
    """id, person_id, likeness (to six digits) and compared (how many persons and pivots the face was compared with) of every face (id, embedding): the most alike of `persons` (person_id, centroid), of equally alike ones the smaller id. Nulls for faces whose vector has another length, nulls or no numbers. Without persons no rows."""
    few = persons.filter(_usable("centroid")).select("person_id", F.col("centroid").cast("array<double>")).limit(PERSONS_A_BLOCK + 1).collect()
    if 0 < len(few) <= PERSONS_A_BLOCK:
        return _among_few(faces, few)
    cells, placed = cells_of(persons)
    if cells is None:
        return faces.select("id", F.lit(None).cast("long").alias("person_id"), F.lit(None).cast("double").alias("likeness"), F.lit(None).cast("long").alias("compared")).limit(0)
    # a cell's persons in blocks of about one size
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PERSONS_A_BLOCK).alias("blocks"))
    dealt = placed.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("person_id"), F.col("blocks")))
    blocks = dealt.groupBy("cell", "block").agg(F.collect_list("person_id").alias("persons"), F.collect_list("centroid").alias("centroids"))
    able = faces.filter(_usable("embedding", cells.width)).select(F.col("id").cast("long"), F.col("embedding").cast("array<double>"))
    packed = able.mapInArrow(_packed(cells), "cell int, ids binary, faces binary")
    met = packed.join(blocks, "cell").select("ids", "faces", "persons", "centroids")
    found = met.mapInArrow(_compared(cells.width), FOUND)
    best = found.groupBy("id").agg(F.max_by(F.struct("person_id", "likeness"), F.struct("likeness", -F.col("person_id"))).alias("best"), (F.sum("compared") + len(cells.pivots)).alias("compared"))
    return best.select("id", "best.person_id", "best.likeness", "compared").unionByName(_others(faces, cells.width))
