"""Boxes, clusters and places on the map. Rows without both coordinates are on no map."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import geohash, haversine_km, mercator
from ..sources.places import CELL_DEG, cover, in_order

#: Distances up to which a place names a point, and is near it.
AT_KM, NEAR_KM = 85.0, 160.0
RADIUS_PX, TILE_PX, MAX_ZOOM = 60, 512, 16


@dataclass(frozen=True)
class Box:
    min_lat: float
    max_lat: float
    min_lon: float
    max_lon: float

    def holds(self) -> Column:
        """Latitudes in either order, cut at the poles. A box that is as wide as the world has no longitudes; one whose first longitude is the larger crosses the date line."""
        lat, lon = F.col("latitude"), F.col("longitude")
        low, high = max(-90.0, min(self.min_lat, self.max_lat)), min(90.0, max(self.min_lat, self.max_lat))
        rows = lat.between(low, high) & lon.isNotNull()
        if abs(self.max_lon - self.min_lon) >= 360:
            return rows
        if self.min_lon > self.max_lon:
            return rows & ((lon >= self.min_lon) | (lon <= self.max_lon))
        return rows & lon.between(max(-180.0, self.min_lon), min(180.0, self.max_lon))


def in_box(media: DataFrame, box: Box, limit: int | None = None) -> DataFrame:
    """The points in a box; with a limit those of the smallest ids."""
    found = media.filter(box.holds()).select("id", "latitude", "longitude", "file_hash", "media_type", "captured_at", "is_favorite", "rating")
    return found if limit is None else found.orderBy("id").limit(limit)


def tiles(media: DataFrame, precision: int = 3) -> DataFrame:
    """tile, count and the mean point of the geohash tiles of a precision."""
    found = media.filter("latitude is not null and longitude is not null")
    found = found.groupBy(geohash(F.col("latitude"), F.col("longitude"), precision).alias("tile"))
    return found.agg(F.count(F.lit(1)).alias("count"), F.round(F.avg("latitude"), 6).alias("latitude"), F.round(F.avg("longitude"), 6).alias("longitude"))


def cells(zoom: int) -> tuple[Column, Column]:
    """The grid cell of a point: squares of RADIUS_PX of the web map at a zoom."""
    x, y = mercator(F.col("latitude"), F.col("longitude"))
    n = F.lit(TILE_PX * 2.0**zoom / RADIUS_PX)
    return F.floor(x * n).cast("long"), F.floor(y * n).cast("long")


def clusters(media: DataFrame, zoom: int) -> DataFrame:
    """Points that share a grid cell at a zoom (MAX_ZOOM and above: at MAX_ZOOM): cell, count, mean point, smallest id."""
    x, y = cells(min(zoom, MAX_ZOOM))
    found = media.filter("latitude is not null and longitude is not null").groupBy(x.alias("cell_x"), y.alias("cell_y"))
    return found.agg(F.count(F.lit(1)).alias("count"), F.round(F.avg("latitude"), 6).alias("latitude"), F.round(F.avg("longitude"), 6).alias("longitude"), F.min("id").alias("first_id"))


def expansion_zoom(media: DataFrame, zoom: int) -> DataFrame:
    """For each cluster of two or more at a zoom, the first deeper zoom at which it falls apart, one beyond MAX_ZOOM at most."""
    x, y = cells(zoom)
    spread = []
    for z in range(zoom + 1, MAX_ZOOM + 1):
        zx, zy = cells(z)
        spread += [F.min(F.struct(zx, zy)).alias(f"a{z}"), F.max(F.struct(zx, zy)).alias(f"b{z}")]
    found = media.filter("latitude is not null and longitude is not null").groupBy(x.alias("cell_x"), y.alias("cell_y"))
    found = found.agg(F.count(F.lit(1)).alias("count"), *spread).filter("count > 1")
    first = F.coalesce(*[F.when(F.col(f"a{z}") != F.col(f"b{z}"), z) for z in range(zoom + 1, MAX_ZOOM + 1)], F.lit(MAX_ZOOM + 1))
    return found.select("cell_x", "cell_y", "count", first.cast("long").alias("expansion_zoom"))


def pyramid(media: DataFrame, first: int = 0, last: int = MAX_ZOOM) -> DataFrame:
    """The clusters of all zooms from `first` to `last`: zoom, and what `clusters` has, the mean not rounded; and for each the zoom at which it falls apart, as expansion_zoom has it (one beyond MAX_ZOOM for a single point's and others that never do).

    A cell of a zoom is four of the next finer one, so each zoom is made from the cells of that one: points are read once and
    counted at MAX_ZOOM, and every zoom above moves a row for each cell at most. A cluster falls apart at the next zoom if it has
    several cells there, else where its only cell does.
    """
    x, y = cells(MAX_ZOOM)
    points = media.filter("latitude is not null and longitude is not null").groupBy(x.alias("cell_x"), y.alias("cell_y"))
    level = points.agg(F.count(F.lit(1)).alias("count"), F.sum("latitude").alias("_lat"), F.sum("longitude").alias("_lon"), F.min("id").alias("first_id"), F.lit(MAX_ZOOM + 1).cast("long").alias("expansion_zoom"))
    found = []
    for zoom in range(MAX_ZOOM, first - 1, -1):
        if zoom < MAX_ZOOM:
            above = level.groupBy(F.shiftright("cell_x", 1).alias("cell_x"), F.shiftright("cell_y", 1).alias("cell_y"))
            apart = F.when(F.count(F.lit(1)) > 1, F.lit(zoom + 1).cast("long")).otherwise(F.max("expansion_zoom"))
            level = above.agg(F.sum("count").alias("count"), F.sum("_lat").alias("_lat"), F.sum("_lon").alias("_lon"), F.min("first_id").alias("first_id"), apart.alias("expansion_zoom"))
        if zoom <= last:
            mean = lambda c, name: (F.col(c) / F.col("count")).alias(name)
            found.append(level.select(F.lit(zoom).alias("zoom"), "cell_x", "cell_y", "count", mean("_lat", "latitude"), mean("_lon", "longitude"), "first_id", "expansion_zoom"))
    return reduce(DataFrame.unionByName, found)


def badge(count: Column) -> Column:
    """What a cluster's mark says."""
    return F.when(count >= 1000, F.concat(F.round(count / 1000, 1).cast("string"), F.lit("k"))).otherwise(count.cast("string"))


def _unit(lat: Column, lon: Column) -> list[Column]:
    """A point of the globe as a vector of length one."""
    a, b = F.radians(lat), F.radians(lon)
    return [F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)]


def nearest_place(media: DataFrame) -> DataFrame:
    """id, distance_km and place of every point: the nearest place's name, `Near` it beyond AT_KM, null beyond NEAR_KM.

    The globe is covered by cells of which it is known which one or few places can be nearest, so a point looks up its
    cell and is compared with those only: the one whose unit vector has the largest product with the point's, whose distance
    is then worked out. Points that are on no globe are compared with all places.
    """
    places = [(k, p[0], p[2], p[4], p[5]) for k, p in enumerate(in_order())]
    table = media.sparkSession.createDataFrame(places, "k int, city string, country string, lat double, lon double")
    place = F.struct("k", "city", "country", "lat", "lon", *[c.alias(n) for n, c in zip("xyz", _unit(F.col("lat"), F.col("lon")), strict=True)])
    one_row = table.agg(F.array_sort(F.collect_list(place)).alias("places"))
    points = media.filter("latitude is not null and longitude is not null").select("id", "latitude", "longitude")
    at = lambda v, low, span: F.least(F.floor((v - low) / CELL_DEG), F.lit(span // CELL_DEG - 1))
    known = F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180)
    cell = at(F.col("latitude"), -90.0, 180) * (360 // CELL_DEG) + at(F.col("longitude"), -180.0, 360)
    near = F.get(F.from_json(F.lit(json.dumps(cover())), "array<array<int>>"), cell.cast("int"))
    everywhere = F.sequence(F.lit(0), F.lit(len(places) - 1))
    points = points.withColumns({f"p{n}": c for n, c in zip("xyz", _unit(F.col("latitude"), F.col("longitude")), strict=True)})
    points = points.withColumn("near", F.when(known, near).otherwise(everywhere)).join(F.broadcast(one_row))
    of = lambda k: F.get("places", k)
    like = lambda k: F.struct((F.col("px") * of(k)["x"] + F.col("py") * of(k)["y"] + F.col("pz") * of(k)["z"]).alias("product"), (-k).alias("k"))
    first = F.when(F.size("near") == 1, F.get("near", F.lit(0))).otherwise(-F.array_max(F.transform("near", like))["k"])
    best = points.select("id", "latitude", "longitude", of(first).alias("best"))
    km = haversine_km(F.col("latitude"), F.col("longitude"), F.col("best.lat"), F.col("best.lon"))
    name = F.concat_ws(", ", F.col("best.city"), F.col("best.country"))
    found = best.select("id", km.alias("km"), name.alias("name"))
    what = F.when(F.col("km") <= AT_KM, F.col("name")).when(F.col("km") <= NEAR_KM, F.concat(F.lit("Near "), F.col("name")))
    return found.select("id", F.round("km", 3).alias("distance_km"), what.alias("place"))
