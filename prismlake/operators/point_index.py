"""Points in files by a space-filling curve, so that a box reads little of them.

The curve (Hilbert's) visits the cells of a grid of 2**BITS by 2**BITS over the globe so that neighbours on it are
neighbours on the map. Rows are dealt into files by ranges of it and are in its order within a file, and their place on it
is a column, of which the files' statistics tell the least and greatest of every row group. A box is turned into at most
MOST_RANGES ranges of the curve, which reach the scan as filters: row groups outside of them are not read. What is read is
then tested exactly. Rows without both coordinates are on no map and not stored.

Rows that come later are added as files of their own, in the same order; `rewrite` brings all into one order again.
"""

from __future__ import annotations

import math
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spatial import Box, in_box

BITS, MOST_RANGES = 16, 64
#: Of the files: bytes of a row group at most, and rows of a file.
GROUP_BYTES, ROWS_A_FILE = 4 << 20, 4_000_000
PLACE = "curve"


def _cell(value: Column, low: float, span: float) -> Column:
    n = 1 << BITS
    return F.least(F.greatest(F.floor((value - low) / span * n), F.lit(0)), F.lit(n - 1)).cast("long")


def curve(lat: Column, lon: Column) -> Column:
    """A point's place on the curve. Null without both coordinates."""

    def step(s, side):
        right, up = (s["x"].bitwiseAND(side) != 0).cast("long"), (s["y"].bitwiseAND(side) != 0).cast("long")
        d = s["d"] * 4 + (3 * right).bitwiseXOR(up)
        # quadrants below are turned, so that the curve goes on where it ends
        mask = side - 1
        x = F.when((up == 0) & (right == 1), mask - s["x"].bitwiseAND(mask)).otherwise(s["x"].bitwiseAND(mask))
        y = F.when((up == 0) & (right == 1), mask - s["y"].bitwiseAND(mask)).otherwise(s["y"].bitwiseAND(mask))
        return F.struct(F.when(up == 0, y).otherwise(x).alias("x"), F.when(up == 0, x).otherwise(y).alias("y"), d.alias("d"))

    first = F.struct(_cell(lon, -180.0, 360.0).alias("x"), _cell(lat, -90.0, 180.0).alias("y"), F.lit(0).cast("long").alias("d"))
    sides = F.array(*[F.lit(1 << k).cast("long") for k in reversed(range(BITS))])
    return F.when(lat.isNotNull() & lon.isNotNull(), F.aggregate(sides, first, step, lambda s: s["d"]))


def place(x: int, y: int) -> int:
    """The place of a cell of the grid on the curve."""
    d = 0
    for k in reversed(range(BITS)):
        side = 1 << k
        right, up = int(x & side != 0), int(y & side != 0)
        d = 4 * d + ((3 * right) ^ up)
        x, y = x & side - 1, y & side - 1
        if not up:
            if right:
                x, y = side - 1 - x, side - 1 - y
            x, y = y, x
    return d


def _corners(box: Box) -> list[tuple[int, int, int, int]]:
    """The cells that a box meets: one rectangle, or two if it crosses the date line."""
    n = 1 << BITS
    at = lambda v, low, span: min(n - 1, max(0, math.floor((v - low) / span * n)))
    y = sorted(at(max(-90.0, min(90.0, v)), -90.0, 180.0) for v in (box.min_lat, box.max_lat))
    x0, x1 = at(box.min_lon, -180.0, 360.0), at(box.max_lon, -180.0, 360.0)
    if abs(box.max_lon - box.min_lon) >= 360:
        spans = [(0, n - 1)]
    elif box.min_lon > box.max_lon:
        spans = [(x0, n - 1), (0, x1)]
    else:
        spans = [(x0, x1)]
    return [(a, y[0], b, y[1]) for a, b in spans]


def ranges(box: Box, most: int = MOST_RANGES) -> list[tuple[int, int]]:
    """At most so many ranges (first, last) of the curve that hold every cell that the box meets. Squares are halved from the largest on, as long as that leaves out cells and ranges stay few; the closest ranges become one."""
    found: list[tuple[int, int]] = []
    for x0, y0, x1, y1 in _corners(box):
        edge = [(0, 0, BITS)]  # squares that the box meets but does not hold
        held: list[tuple[int, int, int]] = []
        while edge and edge[0][2] and len(edge) + len(held) <= 4 * most:
            level = edge[0][2] - 1
            next_edge = []
            for a, b, _ in edge:
                for u, v in ((a, b), (a + (1 << level), b), (a, b + (1 << level)), (a + (1 << level), b + (1 << level))):
                    last = (1 << level) - 1
                    if u > x1 or v > y1 or u + last < x0 or v + last < y0:
                        continue
                    inside = u >= x0 and v >= y0 and u + last <= x1 and v + last <= y1
                    (held if inside else next_edge).append((u, v, level))
            edge = next_edge
        for a, b, level in held + edge:
            first = place(a, b) >> 2 * level << 2 * level
            found.append((first, first + (1 << 2 * level) - 1))
    found.sort()
    out: list[tuple[int, int]] = []
    for a, b in found:
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    while len(out) > most:
        k = min(range(1, len(out)), key=lambda i: out[i][0] - out[i - 1][1])
        out[k - 1 : k + 1] = [(out[k - 1][0], out[k][1])]
    return out


class PointIndex:
    """The points of a table in a folder, in versions: of each the parts that were added since the last rewriting."""

    def __init__(self, spark: SparkSession, folder: str, rows_a_file: int = ROWS_A_FILE, group_bytes: int = GROUP_BYTES):
        self.spark, self.folder, self.rows_a_file, self.group_bytes = spark, folder, rows_a_file, group_bytes

    def add(self, media: DataFrame) -> None:
        """Store the points of `media`: files by ranges of the curve, of about rows_a_file rows, in its order."""
        points = media.filter("latitude is not null and longitude is not null").withColumn(PLACE, curve(F.col("latitude"), F.col("longitude")))
        n = max(1, -(-media.count() // self.rows_a_file))
        dealt = points.repartitionByRange(n, PLACE).sortWithinPartitions(PLACE)
        dealt.write.mode("append").option("parquet.block.size", self.group_bytes).parquet(self.folder)

    def rewrite(self, folder: str) -> PointIndex:
        """All points in one order, in another folder."""
        out = PointIndex(self.spark, folder, self.rows_a_file, self.group_bytes)
        out.add(self.points().drop(PLACE))
        return out

    def points(self) -> DataFrame:
        return self.spark.read.parquet(self.folder)

    def near(self, box: Box, most: int = MOST_RANGES) -> DataFrame:
        """The stored rows in the box's ranges of the curve: all that are in the box, and some around it."""
        parts = [F.col(PLACE).between(a, b) for a, b in ranges(box, most)]
        return self.points().filter(reduce(lambda a, b: a | b, parts))

    def in_box(self, box: Box, limit: int | None = None) -> DataFrame:
        """The points in a box; with a limit those of the smallest ids."""
        return in_box(self.near(box), box, limit)

    def nearest(self, lat: float, lon: float, km: float) -> DataFrame:
        """The rows within so many kilometres of a point, with `km`, nearest first: a box around the circle, then the exact distance."""
        from ..functions.geo import EARTH_KM, haversine_km

        up = math.degrees(km / EARTH_KM)
        top, bottom = lat + up, lat - up
        if top >= 90 or bottom <= -90:  # the circle holds a pole
            box = Box(bottom, top, -180.0, 180.0)
        else:
            wide = math.degrees(math.asin(min(1.0, math.sin(km / EARTH_KM) / math.cos(math.radians(lat))))) if km < EARTH_KM * math.pi / 2 else 180.0
            box = Box(bottom, top, lon - wide, lon + wide)
            if wide >= 180:
                box = replace(box, min_lon=-180.0, max_lon=180.0)
            elif box.min_lon < -180:
                box = replace(box, min_lon=box.min_lon + 360)
            elif box.max_lon > 180:
                box = replace(box, max_lon=box.max_lon - 360)
        away = haversine_km(F.col("latitude"), F.col("longitude"), F.lit(lat), F.lit(lon))
        return self.near(box).withColumn("km", away).filter(F.col("km") <= km).orderBy("km", "id")
