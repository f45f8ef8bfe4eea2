"""Vectors as arrays and boxes as four numbers, without Python in the tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A vector of a smaller norm is not scaled.
LEAST_NORM = 1e-6


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Column) -> Column:
    n = norm(a)
    return F.when(n > LEAST_NORM, F.transform(a, lambda x: x / n)).otherwise(a)


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of two boxes x, y, w, h; 0 without a union."""
    over = lambda p, s: F.greatest(F.least(a[p] + a[s], b[p] + b[s]) - F.greatest(a[p], b[p]), F.lit(0.0))
    both = over("x", "w") * over("y", "h")
    union = a["w"] * a["h"] + b["w"] * b["h"] - both
    return F.when(union <= 0, 0.0).otherwise(both / union)


def upright_to_raw(x: Column, y: Column, w: Column, h: Column, orientation: Column) -> Column:
    """A box of the upright picture in the coordinates of the stored one, for EXIF orientations 1 to 8."""

    def corner(u: Column, v: Column) -> tuple[Column, Column]:
        us = F.when(orientation.isin(2, 3), 1 - u).when(orientation.isin(5, 6), v).when(orientation.isin(7, 8), 1 - v).otherwise(u)
        vs = F.when(orientation.isin(3, 4), 1 - v).when(orientation.isin(5, 8), u).when(orientation.isin(6, 7), 1 - u).otherwise(v)
        return us, vs

    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    (x1, y1), (x2, y2) = corner(x, y), corner(x + w, y + h)
    left, top = unit(F.least(x1, x2)), unit(F.least(y1, y2))
    return F.struct(left.alias("x"), top.alias("y"), unit(F.greatest(x1, x2) - left).alias("w"), unit(F.greatest(y1, y2) - top).alias("h"))


def degrees(orientation: Column) -> Column:
    """Quarter turns of an orientation, which may also be given in degrees."""
    return F.when(orientation.isin(6, 90), 90).when(orientation.isin(3, 180), 180).when(orientation.isin(8, 270), 270).otherwise(0)


def fit_within(width: Column, height: Column, most: int = 384) -> Column:
    """Sizes of a preview that fits in a square, each side at least 1; smaller pictures stay as they are."""
    scale = F.least(F.lit(1.0), most / F.greatest(width, height).cast("double"))
    side = lambda s: F.greatest(F.round(s * scale), F.lit(1)).cast("int")
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def seek_seconds(duration: Column) -> Column:
    """Where a film's still is taken: a tenth of it, 3 seconds at most; half a second of very short ones."""
    return F.when(duration > 1, F.least(duration * 0.1, F.lit(3.0))).otherwise(0.5)


def face_crop(x: Column, y: Column, w: Column, h: Column, margin: float = 0.2) -> Column:
    """A box with a margin around it, cut at the picture's edges."""
    left, top = F.greatest(x - w * margin, F.lit(0.0)), F.greatest(y - h * margin, F.lit(0.0))
    right, bottom = F.least(x + w * (1 + margin), F.lit(1.0)), F.least(y + h * (1 + margin), F.lit(1.0))
    return F.struct(left.alias("x"), top.alias("y"), (right - left).alias("w"), (bottom - top).alias("h"))


def from_bytes(content: Column, width: int = 128) -> Column:
    """Vectors stored as little-endian floats: shorter ones are filled with zeros, longer ones cut; null stays null."""

    @F.pandas_udf("array<float>")
    def run(values):
        def one(b):
            if b is None:
                return None
            v = np.zeros(width, dtype="<f4")
            got = np.frombuffer(bytes(b)[: 4 * min(width, len(b) // 4)], dtype="<f4")
            v[: len(got)] = got
            return v

        return values.map(one)

    return run(content)
