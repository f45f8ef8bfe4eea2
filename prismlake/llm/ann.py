"""Approximate nearest neighbours by learned partitions.

On a sample of at most about SAMPLE vectors the neighbour graph is found by brute force and cut into many small balanced
parts, with few neighbours apart. A small classifier (a linear softmax over the parts, which begins at their means) learns
in which parts a vector's neighbours lie. It deals every row of the table to its most probable part and sends every query to
several: as many as it takes for RECALL of the neighbours of sample vectors that it has not learnt from. Within the parts
asked, distances are shortlisted by matrix products and the shortlist is compared exactly, in double precision.

Parts that follow each other are stored in groups of about ROWS_A_GROUP, which is how rows and queries meet: a query goes to
a group once, with the parts it asks there. Rows and queries of a group are dealt into blocks of at most about ROWS_A_BLOCK
and QUERIES_A_BLOCK, so that a part of any size (a vector that a third of the rows share) is spread over tasks, and the best
of each block are merged.

Defined cases: a vector takes no part if it is null, empty, zero, of another length than most, or holds a null or a number that is not
finite; a row of a null id takes no part; rows that repeat an id are the same candidate at its nearest, and none for a
query of that id, and of the vectors of a query's id the smallest asks; a query of fewer than k candidates in its parts is
asked in all parts; ties go to the smaller id; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

SAMPLE, NEIGHBOURS, EPOCHS, SEED = 20_000, 10, 4, 5
RECALL, BALANCE, ROWS_A_PART, MOST_PARTS = 0.93, 1.15, 8, 4096
#: Share of the sample that the classifier doesn't learn from.
HELD = 0.1
ROWS_A_GROUP, ROWS_A_BLOCK, QUERIES_A_BLOCK = 4_000, 8_000, 500


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of every vector, by brute force in blocks."""
    k = min(k, len(x) - 1)
    x = x.astype(np.float32)
    norms = (x * x).sum(axis=1)
    out = np.empty((len(x), k), dtype=np.int64)
    for at in range(0, len(x), 512):
        d = norms[None, :] - 2 * x[at : at + 512] @ x.T
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        out[at : at + 512] = np.argpartition(d, k - 1, axis=1)[:, :k] if k else np.empty((len(d), 0), np.int64)
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """A part for every vertex: halved along principal directions, then moved to where most neighbours are while there is room. Parts from the same halves have numbers that follow each other."""
    heap, made = [(-len(x), 0, 0.0, np.arange(len(x)))], 1
    while made < parts:
        _, _, place, g = heapq.heappop(heap)
        y = x[g] - x[g].mean(axis=0)
        v = rng.normal(size=x.shape[1])
        for _ in range(6):
            v = y.T @ (y @ v)
            v /= np.linalg.norm(v) + 1e-30
        order = g[np.argsort(y @ v, kind="stable")]
        for k, half in enumerate((order[: len(order) // 2], order[len(order) // 2 :])):
            made += k
            heapq.heappush(heap, (-len(half), made, place + k * 0.5 ** (np.log2(len(x) / max(len(half), 1)) + 1), half))
    label = np.zeros(len(x), dtype=np.int64)
    for k, (_, _, _, g) in enumerate(sorted(heap, key=lambda e: (e[2], e[1]))):
        label[g] = k
    room = max(2, int(np.ceil(BALANCE * len(x) / parts)))
    # edges count both ways
    u = np.concatenate([np.repeat(np.arange(len(x)), graph.shape[1]), graph.reshape(-1)])
    v = np.concatenate([graph.reshape(-1), np.repeat(np.arange(len(x)), graph.shape[1])])
    for _ in range(6):
        votes, n = np.unique(u * parts + label[v], return_counts=True)
        of, to = votes // parts, votes % parts
        here = np.bincount(of, weights=n * (to == label[of]), minlength=len(x))
        gain = n - here[of]
        size = np.bincount(label, minlength=parts)
        moved = np.zeros(len(x), dtype=bool)
        for k in np.argsort(-gain, kind="stable"):
            if gain[k] <= 0:
                break
            i, t = of[k], to[k]
            if not moved[i] and size[t] < room:
                size[label[i]] -= 1
                size[t] += 1
                label[i], moved[i] = t, True
        if moved.sum() < len(x) // 200:
            break
    return label


@dataclass
class Router:
    """A linear softmax: weights and offsets of the parts, and how many parts a query asks."""

    mean: np.ndarray
    scale: float
    w: np.ndarray
    b: np.ndarray
    probes: int = 1

    @property
    def parts(self) -> int:
        return len(self.b)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) * self.scale).astype(np.float32) @ self.w + self.b

    def best(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n most probable parts of every vector, the most probable first."""
        out = np.empty((len(x), n), dtype=np.int64)
        for at in range(0, len(x), 1024):
            s = -self.scores(x[at : at + 1024])
            out[at : at + 1024] = s.argmin(axis=1)[:, None] if n == 1 else np.argsort(s, axis=1, kind="stable")[:, :n]
        return out


def train(x: np.ndarray, graph: np.ndarray, label: np.ndarray, parts: int, rows: np.ndarray, rng: np.random.Generator) -> Router:
    """Learn from the vectors `rows` in which parts they and their neighbours lie."""
    mean = x.mean(axis=0)
    z = (x - mean).astype(np.float32)
    scale = 1 / (float(np.sqrt((z * z).sum(axis=1).mean())) + 1e-30)
    z *= np.float32(scale)
    means = np.zeros((parts, x.shape[1]), dtype=np.float32)
    np.add.at(means, label, z)
    means /= np.maximum(np.bincount(label, minlength=parts), 1)[:, None]
    # as probabilities of parts of equal spread
    spread = float(((z - means[label]) ** 2).sum(axis=1).mean()) / x.shape[1] + 1e-6
    w = (means / spread).T.astype(np.float32).copy()
    b = (-(means * means).sum(axis=1) / (2 * spread)).astype(np.float32)
    near = np.concatenate([label[:, None], label[graph]], axis=1)
    for epoch in range(EPOCHS):
        rate = np.float32(2.0 * (1 - epoch / EPOCHS))
        order = rng.permutation(rows)
        for at in range(0, len(order), 256):
            i = order[at : at + 256]
            p = z[i] @ w + b
            p = np.exp(p - p.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            np.subtract.at(p, (np.repeat(np.arange(len(i)), near.shape[1]), near[i].reshape(-1)), np.float32(1 / near.shape[1]))
            p /= len(i)
            w -= rate * z[i].T @ p
            b -= rate * p.sum(axis=0)
    return Router(mean, scale, w, b)


def fit(vectors: DataFrame, n: int) -> Router:
    """A router from a hash-chosen sample of `vectors` (vec_id, vector), of which there are n."""
    unit = F.shiftrightunsigned(F.xxhash64("vec_id", F.lit(SEED)), 11) / float(1 << 53)
    rows = vectors.filter(unit < min(1.0, SAMPLE / max(n, 1))).toPandas().sort_values("vec_id", kind="stable")
    # copies would be each other's neighbours
    x = np.unique(np.stack(rows["vector"].to_numpy()).astype(np.float64), axis=0) if len(rows) else np.zeros((0, 1))
    parts = min(MOST_PARTS, n // ROWS_A_PART, len(x) // 3) if n >= 1000 else 1
    if parts <= 1:
        return Router(np.zeros(x.shape[1]), 1.0, np.zeros((x.shape[1], 1), np.float32), np.zeros(1, np.float32))
    rng = np.random.default_rng(SEED)
    graph = neighbour_graph(x, NEIGHBOURS)
    label = balanced_parts(x, graph, parts, rng)
    held = rng.random(len(x)) < HELD
    router = train(x, graph, label, parts, np.flatnonzero(~held), rng)
    # the rank of each neighbour's part among those that a vector would ask
    dealt = router.best(x, 1)[:, 0]
    ranks = []
    for at in range(0, held.sum(), 256):
        i = np.flatnonzero(held)[at : at + 256]
        s = router.scores(x[i])
        rank = np.argsort(np.argsort(-s, axis=1, kind="stable"), axis=1, kind="stable")
        ranks.append(np.take_along_axis(rank, dealt[graph[i]], axis=1).reshape(-1))
    router.probes = int(np.quantile(np.concatenate(ranks), RECALL, method="higher")) + 1 if ranks else parts
    return router


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _route(router: Router, groups: np.ndarray | None):
    """Each row's part; or, with the group of each part, for queries the groups they ask and there the parts: the most probable ones, and then those of all."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            if groups is None:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(router.best(x, 1)[:, 0].astype(np.int32))], names=["vec_id", "vector", "part"])
                continue
            best = np.sort(router.best(x, router.probes), axis=1)
            for at in range(batch.num_rows):
                asked, first = np.unique(groups[best[at]], return_index=True)
                parts = [p.tolist() for p in np.split(best[at], first[1:])]
                n = len(asked)
                same = [batch.column(k).take(pa.array(np.full(n, at))) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(asked.astype(np.int32)), pa.array(parts, pa.list_(pa.int32()))], names=["vec_id", "vector", "group", "parts"])

    return run


def nearest(x: np.ndarray, ids: np.ndarray, part: np.ndarray, q: np.ndarray, own: np.ndarray, parts: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For queries `q` of ids `own` the k nearest ids among the rows of the parts that each one asks (None: all), each at its nearest row, without its own: numbers of queries, ids, distances. Of distances equal in the k-th place all are told. `ids` are sorted."""
    asks = np.ones((len(q), len(x)), dtype=bool)
    if any(p is not None for p in parts):
        present, column = np.unique(part, return_inverse=True)
        wanted = np.zeros((len(q), len(present)), dtype=bool)
        for i, p in enumerate(parts):
            wanted[i] = np.isin(present, p) if p is not None else True
        asks = wanted[:, column]
    asks &= own[:, None] != ids[None, :]
    norms, own_norms = (x * x).sum(axis=1), (q * q).sum(axis=1)
    d = np.full(asks.shape, np.inf)
    if len(q) * len(x) > 4 * asks.sum() and len(x) > 64:
        # few rows are asked: part by part
        for c in range(asks.shape[1] and len(present)):
            rows, who = np.flatnonzero(column == c), np.flatnonzero(wanted[:, c])
            if len(who):
                d[np.ix_(who, rows)] = norms[rows] - 2 * q[who] @ x[rows].T + own_norms[who, None]
        d[~asks] = np.inf
    else:
        d = np.where(asks, norms[None, :] - 2 * q @ x.T + own_norms[:, None], np.inf)
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    by_id = np.minimum.reduceat(d, first, axis=1)
    last = np.partition(by_id, k - 1, axis=1)[:, k - 1] if by_id.shape[1] > k else np.full(len(q), np.inf)
    # products round: what may be as near as the k-th is compared exactly
    slack = 1e-9 * (own_norms + norms.max(initial=0.0))
    i, r = np.nonzero(d <= (last + slack)[:, None]) if len(x) else (np.zeros(0, int), np.zeros(0, int))
    finite = np.isfinite(d[i, r])
    i, r = i[finite], r[finite]
    exact = np.sqrt(((x[r] - q[i]) ** 2).sum(axis=1))
    order = np.lexsort((exact, ids[r], i))
    i, named, exact = i[order], ids[r][order], exact[order]
    once = np.concatenate([[True], (i[1:] != i[:-1]) | (named[1:] != named[:-1])]) if len(i) else np.zeros(0, bool)
    return i[once], named[once], exact[once]


def _compare(k: int):
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or queries.empty:
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        rows = rows.sort_values("vec_id", kind="stable")
        x, q = (np.stack(df["vector"].to_numpy()).astype(np.float64) for df in (rows, queries))
        own = queries["vec_id"].to_numpy()
        i, ids, d = nearest(x, rows["vec_id"].to_numpy(), rows["part"].to_numpy(), q, own, list(queries["parts"]), k)
        return pd.DataFrame({"query_id": own[i], "vec_id": ids, "score": d})

    return run


def _ask(rows: DataFrame, queries: DataFrame, row_blocks: list[int], query_blocks: list[int], k: int) -> DataFrame:
    """The k best of every block for every query: `rows` (vec_id, vector, part, group) against `queries` (vec_id, vector, group, parts)."""
    pick = lambda values: F.get(F.from_json(F.lit(str(values)), "array<int>"), F.col("group"))
    salt = lambda n: F.pmod(F.xxhash64("vec_id"), pick(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), pick(n) - 1))
    a = rows.withColumn("row_block", salt(row_blocks)).withColumn("query_block", every(query_blocks))
    b = queries.withColumn("query_block", salt(query_blocks)).withColumn("row_block", every(row_blocks))
    keys = ["group", "row_block", "query_block"]
    compare = _compare(k)
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(lambda x, q: compare(x, q), "query_id long, vec_id long, score double")


def grouped(counts: dict[int, int], parts: int) -> np.ndarray:
    """The group of each part: parts that follow each other, until they have ROWS_A_GROUP."""
    before = np.concatenate([[0], np.cumsum([counts.get(p, 0) for p in range(parts)])[:-1]])
    return np.unique(before // ROWS_A_GROUP, return_inverse=True)[1]


def search(table: DataFrame, is_query: Column, k: int = 10, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows found for every row of `table` where `is_query` holds."""
    typed = table.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    typed = typed.filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    widths = typed.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    d, n = (widths["d"], widths["n"]) if widths else (0, 0)
    typed = typed.filter(F.size("vector") == d)
    router = fit(typed.select("vec_id", "vector"), n)
    rows = typed.select("vec_id", "vector").mapInArrow(_route(router, None), "vec_id long, vector array<double>, part int")
    rows = materialize(rows, "routed")
    counts = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    groups = grouped(counts, router.parts)
    sizes = np.bincount(groups, weights=[counts.get(p, 0) for p in range(router.parts)]).astype(int)
    row_blocks = [max(1, -(-int(s) // ROWS_A_BLOCK)) for s in sizes]
    rows = rows.withColumn("group", F.get(F.from_json(F.lit(str(groups.tolist())), "array<int>"), F.col("part")))
    asking = typed.filter("asks").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asked = materialize(asking.mapInArrow(_route(router, groups), "vec_id long, vector array<double>, group int, parts array<int>"), "queries")

    def best(queries: DataFrame) -> DataFrame:
        asking = {r["group"]: r["n"] for r in queries.groupBy("group").agg(F.count(F.lit(1)).alias("n")).collect()}
        query_blocks = [max(1, -(-asking.get(g, 0) // QUERIES_A_BLOCK)) for g in range(len(sizes))]
        found = _ask(rows, queries, row_blocks, query_blocks, k)
        # an id may stand in several rows: it counts once, at its nearest
        found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    first = materialize(best(asked), "found")
    out = first
    if router.probes < router.parts:
        enough = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("found")).filter(F.col("found") >= k).select(F.col("query_id").alias("vec_id"))
        short = materialize(asked.select("vec_id", "vector").dropDuplicates(["vec_id"]).join(enough, "vec_id", "left_anti"), "short")
        if not short.isEmpty():
            everywhere = F.explode(F.sequence(F.lit(0), F.lit(len(sizes) - 1)))
            again = best(short.select("vec_id", "vector", everywhere.alias("group"), F.lit(None).cast("array<int>").alias("parts")))
            out = first.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again)
    return out.select("query_id", "rank", "vec_id", "score")
