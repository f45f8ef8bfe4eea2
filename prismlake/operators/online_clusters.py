"""Clusters of faces that are met in order, of any number of faces.

A face joins the most alike running centroid, if that is alike enough, else it begins a cluster. The order makes the result,
so who joins whom is one task's work; but most faces of a large scope are like nobody and need not go there:

1. Blocks of faces meet each other, a task for each pair of blocks. A cluster's second face is like its first one, so faces
   that are like no other face begin no cluster of two or more.
2. The others are met in order by one task for each scope, which tells every centroid that a joining face has made.
3. The faces left out meet those centroids, again by blocks. One that is like a centroid which was there before it might have
   joined; if there is any, all such faces go to those that are met in order, and steps 2 and 3 are done again.

If there is none, nobody that was left out joins anything, so the result is that of meeting all in order: the first face to
join wrongly would have found just the centroids of step 2. Comparisons by blocks are in single precision and pass what is
nearly enough; a face too many in step 2 changes nothing. Scopes of at most FEW faces are met in order at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import LEAST_NORM
from ..sources.shared import shared_folder

#: Faces of a scope that are met in order as they are; faces of a block; faces that are compared at a time.
FEW, BLOCK, STEP = 16_384, 32_768, 1024
#: What single precision may be off, for vectors of length one.
NEARLY = 1e-5
MET = "at string, scope string, id long, cluster long, centroid array<double>, faces double"


def kept(df: DataFrame, name: str) -> DataFrame:
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Running:
    """Running centroids of clusters, in the order in which they begin."""

    def __init__(self, width: int, least: float):
        self.least, self.n, self.longest = least, 0, 1.0
        self.centroids, self.counts, self.first = np.zeros((64, width)), np.zeros(64), np.zeros(64, dtype=np.int64)

    def step(self) -> int:
        """How many vectors to compare with all centroids at a time: 64 MB of numbers."""
        return max(1, min(STEP, (8 << 20) // max(self.n, 1)))

    def meet(self, ids: np.ndarray, vectors: np.ndarray, counts: np.ndarray) -> list[tuple[int, np.ndarray | None, float]]:
        """For each vector of so many faces, in order, the first face of the cluster that it joins or begins, the centroid that it has made by joining, and the cluster's faces."""
        old, out = self.n, []
        like = vectors @ self.centroids[:old].T
        fresh: dict[int, int] = {}  # clusters that have changed or begun since, and where they are in `recent`
        recent = np.zeros_like(vectors)
        for r, (i, x, count) in enumerate(zip(ids, vectors, counts, strict=True)):
            near = recent[: len(fresh)] @ x
            top = max(like[r].max(initial=-np.inf), near.max(initial=-np.inf))
            # the last digits depend on how many are compared at a time, so close ones are compared by themselves
            off = 1e-9 * max(1.0, float(np.linalg.norm(x)) * self.longest)
            best, k = -np.inf, -1
            if top >= self.least - off:
                for c in sorted([*np.flatnonzero(like[r] >= top - off), *(c for c, v in zip(fresh, near, strict=True) if v >= top - off)]):
                    if (v := float(self.centroids[c] @ x)) > best:
                        best, k = v, int(c)
            joins = k >= 0 and best >= self.least
            if joins:
                v = self.centroids[k] * self.counts[k] + x * count
                n = np.linalg.norm(v)
                self.centroids[k], self.counts[k] = (v / n if n > LEAST_NORM else v), self.counts[k] + count
            else:
                k = self._begin(i, x, count)
            if k < old and k not in fresh:
                like[:, k] = -np.inf
            recent[fresh.setdefault(k, len(fresh))] = self.centroids[k]
            out.append((int(self.first[k]), self.centroids[k].copy() if joins else None, self.counts[k]))
        return out

    def _begin(self, i: int, x: np.ndarray, count: float) -> int:
        if self.n == len(self.counts):
            self.centroids, self.counts, self.first = (np.concatenate([v, np.zeros_like(v)]) for v in (self.centroids, self.counts, self.first))
        self.centroids[self.n], self.counts[self.n], self.first[self.n] = x, count, i
        self.longest = max(self.longest, float(np.linalg.norm(x)))
        self.n += 1
        return self.n - 1


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _runs(keys: list) -> list[tuple[int, int]]:
    starts = [k for k in range(len(keys)) if not k or keys[k] != keys[k - 1]]
    return list(zip(starts, [*starts[1:], len(keys)], strict=True))


def in_order(nodes: DataFrame, least: float) -> DataFrame:
    """Every row of `nodes` (at, scope, id, vector, faces), met in the order of ids within `at`: its cluster, and the centroid it has made by joining. A row without id for each cluster has its last centroid."""

    def ended(at, scope, running):
        for k in range(0, running.n, STEP):
            m = min(STEP, running.n - k)
            yield _rows([at] * m, [scope] * m, [None] * m, running.first[k : k + m], list(running.centroids[k : k + m]), running.counts[k : k + m])

    def run(batches):
        now = scope = running = None
        for batch in batches:
            ats = batch.column(0).to_pylist()
            for i, j in _runs(ats):
                part = batch.slice(i, j - i)
                if running is None or ats[i] != now:
                    if running is not None:
                        yield from ended(now, scope, running)
                    now, scope, running = ats[i], part.column(1)[0].as_py(), Running(len(part.column(3)[0]), least)
                ids, x, n = part.column(2).to_numpy(), _matrix(part.column(3)), part.column(4).to_numpy()
                k = 0
                while k < len(ids):
                    m = k + running.step()
                    got = running.meet(ids[k:m], x[k:m], n[k:m])
                    yield _rows([now] * len(got), [scope] * len(got), ids[k:m], *zip(*got, strict=True))
                    k = m
        if running is not None:
            yield from ended(now, scope, running)

    return nodes.select("at", "scope", "id", "vector", "faces").repartition("at").sortWithinPartitions("at", "id").mapInArrow(run, MET)


def _rows(at, scope, ids, cluster, centroid, faces) -> pa.RecordBatch:
    vectors = pa.array([None if c is None else np.ascontiguousarray(c) for c in centroid], pa.list_(pa.float64()))
    columns = [pa.array(at, pa.string()), pa.array(scope, pa.string()), pa.array(ids, pa.int64()), pa.array(cluster, pa.int64()), vectors, pa.array(faces, pa.float64())]
    return pa.RecordBatch.from_arrays(columns, names=["at", "scope", "id", "cluster", "centroid", "faces"])


def _blocks(nodes: DataFrame, n: str) -> DataFrame:
    """at, n, block, ids, vectors: rows of `nodes` (at, id, vector and in `n` how many blocks) packed by blocks, vectors in single precision."""

    def run(batches):
        key, ids, vectors = None, [], []

        def packed():
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*key, np.concatenate(ids).tobytes(), np.concatenate(vectors).tobytes()), (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["at", "n", "block", "ids", "vectors"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
            for i, j in _runs(keys):
                if ids and (keys[i] != key or sum(map(len, ids)) >= 2 * BLOCK):
                    yield packed()
                    ids, vectors = [], []
                key = keys[i]
                part = batch.slice(i, j - i)
                ids.append(part.column(3).to_numpy())
                vectors.append(_matrix(part.column(4)).astype(np.float32))
        if ids:
            yield packed()

    dealt = nodes.select("at", F.col(n).cast("long").alias("n"), F.pmod(F.xxhash64("id"), F.col(n)).cast("long").alias("block"), "id", "vector")
    schema = "at string, n long, block long, ids binary, vectors binary"
    return kept(dealt.repartition("at", "block").sortWithinPartitions("at", "n", "block").mapInArrow(run, schema), "blocks")


def _near(least: float, later: bool):
    """at, id of those of block x that are near one of block y; `later`, of those that are earlier, else of any but themselves, and then of both blocks."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                at, ix, vx, iy, vy = (c[k].as_py() for c in batch.columns)
                same = not later and ix == iy
                ix, iy = np.frombuffer(ix, np.int64), np.frombuffer(iy, np.int64)
                x, y = (np.frombuffer(v, np.float32).reshape(len(i), -1) for v, i in ((vx, ix), (vy, iy)))
                lengths = [np.sqrt((v.astype(np.float64) ** 2).sum(axis=1).max()) for v in (x, y)]
                enough = np.float32(least - NEARLY * max(1.0, lengths[0] * lengths[1]))
                hit_x, hit_y = np.zeros(len(ix), bool), np.zeros(len(iy), bool)
                for i in range(0, len(ix), STEP):
                    for j in range(0, len(iy), 4 * STEP):
                        # what is no number passes
                        near = ~(x[i : i + STEP] @ y[j : j + 4 * STEP].T < enough)
                        if later:
                            near &= ix[i : i + STEP, None] > iy[None, j : j + 4 * STEP]
                        elif same and j <= i < j + 4 * STEP:
                            near[np.arange(near.shape[0]), np.arange(near.shape[0]) + i - j] = False
                        if not near.any():
                            continue
                        hit_x[i : i + STEP] |= near.any(axis=1)
                        hit_y[j : j + 4 * STEP] |= near.any(axis=0)
                ids = ix[hit_x] if later else np.concatenate([ix[hit_x], iy[hit_y]])
                yield pa.RecordBatch.from_arrays([pa.array([at] * len(ids), pa.string()), pa.array(ids)], names=["at", "id"])

    return run


def _pairs(x: DataFrame, y: DataFrame, least: float, later: bool) -> DataFrame:
    """at, id: _near of pairs of blocks, a task for about each pair."""
    of_y = y.groupBy("at").agg(F.max("n").alias("of_y"))
    of_x = x.groupBy("at").agg(F.max("n").alias("of_x"))
    tasks = of_x.join(of_y, "at").agg(F.sum(F.col("of_x") * F.col("of_y"))).first()[0] or 1
    x = x.join(F.broadcast(of_y), "at").withColumn("y", F.explode(F.sequence("block" if not later else F.lit(0).cast("long"), F.col("of_y") - 1)))
    y = y.join(F.broadcast(of_x), "at").withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("block") if not later else F.col("of_x") - 1)))
    x = x.select("at", F.col("block").alias("x"), "y", F.col("ids").alias("ix"), F.col("vectors").alias("vx")).repartition(int(tasks), "at", "x", "y")
    y = y.select("at", "x", F.col("block").alias("y"), F.col("ids").alias("iy"), F.col("vectors").alias("vy")).repartition(int(tasks), "at", "x", "y")
    return x.hint("merge").join(y, ["at", "x", "y"]).select("at", "ix", "vx", "iy", "vy").mapInArrow(_near(least, later), "at string, id long").distinct()


def met(nodes: DataFrame, least: float) -> DataFrame:
    """What in_order says about `nodes`, with the large scopes' rows that are like nobody left out of it and added again."""
    nodes = kept(nodes, "nodes")
    large = kept(nodes.groupBy("at").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > FEW), "large")
    if large.isEmpty():
        return kept(in_order(nodes, least), "met")
    blocks_of = large.select("at", F.ceil(F.col("rows") / BLOCK).alias("blocks"))
    small = in_order(nodes.join(F.broadcast(large), "at", "left_anti"), least)
    nodes = nodes.join(F.broadcast(blocks_of), "at")
    blocks = _blocks(nodes, "blocks")
    company = kept(_pairs(blocks, blocks, least, False), "company")
    while True:
        found = kept(in_order(nodes.join(company, ["at", "id"], "left_semi"), least), "met")
        made = found.filter("id is not null and centroid is not null").select("at", "id", F.col("centroid").alias("vector"))
        sizes = made.groupBy("at").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
        centroids = _blocks(made.join(F.broadcast(sizes), "at"), "blocks")
        more = kept(_pairs(blocks, centroids, least, True).join(company, ["at", "id"], "left_anti"), "more")
        if more.isEmpty():
            break
        company = kept(company.unionByName(more), "company")
    alone = nodes.join(company, ["at", "id"], "left_anti")
    began = alone.select("at", "scope", "id", F.col("id").alias("cluster"), F.lit(None).cast("array<double>").alias("centroid"), "faces")
    ended = alone.select("at", "scope", F.lit(None).cast("long").alias("id"), F.col("id").alias("cluster"), F.col("vector").alias("centroid"), "faces")
    return kept(small.unionByName(found).unionByName(began).unionByName(ended), "met")
