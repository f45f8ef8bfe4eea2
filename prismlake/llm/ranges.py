"""Range partitioning by sampled splitters, with DataFrame functions only.

A record's key is a number; its weight says how likely it is drawn. Quantiles of the drawn keys are the boundaries of
ranges of about equal weight. A key that makes up a range of its own (a group that holds a good part of everything) gets
exactly that, and ranges that turn out overfull are subdivided by a second number. Only boundaries and one sum for each
range come to the driver: their number is a parameter, not the table's size.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys drawn for each range, on average.
DRAWS = 24
#: Of keys: percentiles are found in double precision, which holds as many exactly.
BITS = 52


def hash52(c: Column) -> Column:
    """A number of BITS bits from a text, as md5 has it."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _unit(*columns: str) -> Column:
    """A number from 0 to 1 that a row's columns decide."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / float(1 << 53)


def splitters(df: DataFrame, key: str, weight: str, total: float, ranges: int, seed: list[str]) -> list[int]:
    """Boundaries of at most `ranges` ranges of `key` and of one more for each heavy key: a range holds keys from one boundary up to the next."""
    if ranges < 2 or not total:
        return []
    drawn = df.filter(_unit(*seed) < F.col(weight) * (ranges * DRAWS / float(total)))
    cuts = [k / ranges for k in range(1, ranges)]
    found = drawn.agg(F.percentile_approx(key, cuts, 100 * ranges).alias("q")).first()["q"] or []
    twice = {a for a, b in zip(found, found[1:], strict=False) if a == b}
    return sorted({int(q) for q in found} | {int(q) + 1 for q in twice})


def range_of(key: Column, bounds: list[int]) -> Column:
    """The number of boundaries that are not above a key, by bisection."""
    if not bounds:
        return F.lit(0)
    n = len(bounds)
    values = F.array(*[F.lit(b).cast("long") for b in bounds]) if n < 64 else F.from_json(F.lit(str(bounds)), "array<long>")
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(n.bit_length()))])
    hit = lambda at, s: (at + s <= n) & (F.coalesce(F.get(values, at + s - 1), F.lit(0)) <= key)
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(hit(at, s), at + s).otherwise(at))


def lookup(values: list, at: Column, kind: str) -> Column:
    """The entry of a list of plain values that a column's number names."""
    return F.get(F.from_json(F.lit(json.dumps(list(values))), f"array<{kind}>"), at)


@dataclass
class Cells:
    """Ranges of a key and their subdivisions (cells, in order), and how much and how many rows are before each."""

    bounds: list[int]
    parts: list[int]
    weights: list[int] = field(default_factory=list)
    counts: list[int] = field(default_factory=list)
    #: For cells of a key that has several, what the key has in all and what is before its end; else null.
    whole: list[int | None] = field(default_factory=list)
    end: list[int | None] = field(default_factory=list)

    def single(self, k: int) -> bool:
        """Whether a range is one key's own."""
        return 0 < k < len(self.bounds) and self.bounds[k] == self.bounds[k - 1] + 1

    def cell(self, key: Column, second: Column) -> Column:
        """The cell of a row. An overfull range of one key is subdivided by the second number, any other by where keys lie in it."""
        at = range_of(key, self.bounds)
        if max(self.parts) == 1:
            return at
        b, many = self.bounds, range(len(self.parts))
        single = [self.single(k) for k in many]
        low = [b[k - 1] if k else 0 for k in many]
        width = [max(1, (b[k] if k < len(b) else 1 << BITS) - low[k]) for k in many]
        inside = (key.cast("double") - lookup(low, at, "double")) / lookup(width, at, "double")
        share = F.when(lookup(single, at, "boolean"), second / float(1 << BITS)).otherwise(inside)
        n = lookup(self.parts, at, "int")
        first = lookup([sum(self.parts[:k]) for k in many], at, "int")
        return first + F.least(F.greatest(F.floor(share * n), F.lit(0)), n - 1).cast("int")

    def before(self, cell: Column) -> tuple[Column, Column]:
        """What is before a row's cell: weight and number of rows."""
        return lookup(self.weights, cell, "long"), lookup(self.counts, cell, "long")

    def group(self, cell: Column) -> tuple[Column, Column]:
        """Of a key that has several cells: what it has in all, and what is before its end; nulls for other rows."""
        return lookup(self.whole, cell, "long"), lookup(self.end, cell, "long")


def cut(df: DataFrame, key: str, second: str, weight: str, total: int, ranges: int, seed: list[str], measure: str | None = None) -> tuple[DataFrame, Cells]:
    """`df` with `cell`: cells are in the order of (key, second), and overfull ranges are several.

    `second` is a number of BITS bits that differs where keys are equal. Ranges are even in `weight`, of which `total` is
    the sum; what is before a cell is told in `measure` (by default the same).
    """
    bounds = splitters(df, key, weight, total, ranges, seed)
    sums = {r["at"]: r["w"] for r in df.groupBy(range_of(F.col(key), bounds).alias("at")).agg(F.sum(weight).alias("w")).collect()}
    even = max(1, total // ranges)
    cells = Cells(bounds, [-(-sums.get(k, 0) // even) if sums.get(k, 0) > 2 * even else 1 for k in range(len(bounds) + 1)])
    placed = df.withColumn("cell", cells.cell(F.col(key), F.col(second)))
    found = {r["cell"]: (r["w"], r["n"]) for r in placed.groupBy("cell").agg(F.sum(measure or weight).alias("w"), F.count(F.lit(1)).alias("n")).collect()}
    before, rows = 0, 0
    for k in range(sum(cells.parts)):
        cells.weights.append(before)
        cells.counts.append(rows)
        w, n = found.get(k, (0, 0))
        before, rows = before + w, rows + n
    stops = [*cells.weights[1:], before]
    at = 0
    for k, n in enumerate(cells.parts):
        split = n > 1 and cells.single(k)
        cells.whole += [stops[at + n - 1] - cells.weights[at] if split else None] * n
        cells.end += [stops[at + n - 1] if split else None] * n
        at += n
    return placed, cells
