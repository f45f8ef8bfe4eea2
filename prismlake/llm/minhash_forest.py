"""MinHash near-duplicates by an LSH forest.

A document's set of 5-word shingles gets a signature of TREES * DEPTH minima. Each tree reads it in an order of its own
(a rotation that starts at the tree's DEPTH components), and all signatures are sorted in that order. Documents whose
longest common prefix reaches DEPTH stand side by side and form a region.

1. Documents of equal sets are one class, and its smallest id stands for it. Classes go through the forest.
2. In a region each class takes as candidates the region's first class and its neighbour in the order. Of all trees'
   candidates, those that most trees agree on are confirmed on the full sets, which joins most near copies.
3. In regions whose classes are not all joined by then, every pair of classes from different components is looked at by
sizes and sketches. A region of up to PAIRS_A_ROW such pairs for each of its rows, and of REGION_BYTES, is one task's work. The
classes of all larger regions are joined by prefixes instead: under one order of all shingles, rare ones first, two sets
of similarity 0.75 share a shingle among the first quarter of the larger and the first seventh of the smaller, and where
their first common one stands bounds how many they can share. What thousands share (a template) is late in the order, so
few pairs meet by it. Pairs that meet either way are confirmed on the full sets, first those of each two components that
share most, then those of components that are still apart.

So a link is missed only if no tree has the two documents in one region: with J = 0.75 once in (1 - 0.75**4)**-32, about
190,000 times, and a component only if that happens to all links that hold it; or if their sketches fall short (SPARE).
The orders are dealt out by range, and prefixes by shingle, so that a region of any size is spread over tasks; a region
that a range cuts is put together again by its key before it is compared. No tree is read shallower than DEPTH.

Defined cases: a null text or one without words has no shingles, links with nothing and is its own component; texts of
fewer than five words have one shingle, all of their words; a null id takes no part and comes back with null component;
repeated rows come back as often as they are there; an id with several texts links with all that any of them links with; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, sieve
from .components import components
from .shingles import WORDS, mix, shingle_set

TREES, DEPTH, DEEPER = 32, 4, 8
#: All components; their lowest bytes are a sketch that spares most pairs below the threshold the comparison of full sets.
SIGNATURE = TREES * DEPTH
PAIRS_A_ROW = 64
#: Candidates of a class that are confirmed before regions are compared in full.
FIRST_TRIES = 3
#: Pairs of two components that are confirmed before the others of those that are still apart, and how many times as many each time after.
PAIR_TRIES, MORE_TRIES = 4, 8
#: Agreeing components that a pair at the threshold falls short of less than once in ten million times.
SPARE = 5.5
REGION_BYTES = 64 << 20
#: Bits of a set's parities, which stand behind its sketch.
PARITIES = 1024
#: Shingles are ordered by how often their bucket occurs; any number of buckets gives the same links.
BUCKETS = 1 << 18

_seeds = mix(np.arange(1, SIGNATURE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minima of a set under SIGNATURE hash functions, as 32-bit numbers."""
    low = np.full(SIGNATURE, np.uint32(0xFFFFFFFF))
    multipliers = (_seeds >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    offsets = (_seeds & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    folded = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(folded), 512):
        h = folded[at : at + 512, None] * multipliers
        h += offsets
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        low = np.minimum(low, h.min(axis=0))
    return low


def _describe(batches, words: int):
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            ids, texts = batch.column(0)[at : at + 512], batch.column(1)[at : at + 512].to_pylist()
            n, low, high, sig = [], [], [], []
            for text in texts:
                s = shingle_set(text, words)
                d = xxhash.xxh3_128_digest(s.tobytes())
                n.append(len(s))
                low.append(int.from_bytes(d[:8], "little", signed=True))
                high.append(int.from_bytes(d[8:], "little", signed=True))
                sig.append(signature(s).tobytes())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "low", "high", "sig"])


def _plant(batches):
    """For each tree a row with its key (the first DEPTH components), what follows them in the tree's order, and the class."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            sig = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.uint32).reshape(part.num_rows, SIGNATURE)
            ids = part.column(0).to_numpy()
            keys, deeper = [], []
            for tree in range(TREES):
                order = np.roll(np.arange(SIGNATURE), -tree * DEPTH)
                key = np.full(len(ids), np.uint64(tree + 1))
                for c in order[:DEPTH]:
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, c])
                tail = np.zeros(len(ids), dtype=np.uint64)
                for c in order[DEPTH : DEPTH + DEEPER]:
                    tail = (tail << np.uint64(8)) | (sig[:, c] & np.uint32(0xFF)).astype(np.uint64)
                keys.append(key)
                deeper.append(tail)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (keys, deeper)] + [pa.array(np.tile(ids, TREES))], names=["key", "deeper", "rep"])


def _neighbours(batches):
    """From rows in the trees' order, those of regions of two classes or more, each with its region's first class and the class before it. A task's first and last region may go on in another task, so they are told whatever their size."""
    last_key = last_rep = first = None
    held, begun = None, False  # a region's first row, until a second one shows; whether the task's first region is over
    for batch in batches:
        out = []
        for key, deeper, rep in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != last_key:
                if held and not begun:
                    out.append(held)
                begun = last_key is not None
                last_key, first, held = key, rep, (key, deeper, rep, rep, rep)
            else:
                if held:
                    out.append(held)
                    held = None
                out.append((key, deeper, rep, first, last_rep))
            last_rep = rep
        yield _neighbour_rows(out)
    if held:
        yield _neighbour_rows([held])


def _neighbour_rows(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * 5)], names=["key", "deeper", "rep", "first", "before"])


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union holds for two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            a, b, sa, sb = (c.to_pylist() for c in batch.columns)
            keep = [k for k in range(len(a)) if linked(np.frombuffer(sa[k], np.uint64), np.frombuffer(sb[k], np.uint64), percent)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for k in keep], pa.int64()) for x in (a, b)], names=["u", "v"])

    return run


def _least(percent: int) -> float:
    """So many components of their sketches two sets of the threshold agree in, all but once in ten million times."""
    j = percent / 100
    return SIGNATURE * j - SPARE * np.sqrt(SIGNATURE * j * (1 - j))


def _sketch(shingles: np.ndarray) -> bytes:
    """The lowest bytes of a set's minima, then for each of PARITIES buckets whether it has an odd number of the shingles."""
    odd = np.bincount((shingles % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return (signature(shingles) & np.uint32(0xFF)).astype(np.uint8).tobytes() + np.packbits(odd.astype(bool)).tobytes()


def _sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, SIGNATURE + PARITIES // 8)


def _open(na, nb, sa: np.ndarray, sb: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of sets may reach the threshold by their sizes and sketches, and in how many components these agree.

    Buckets of unlike parity are at most as many as the shingles that only one of two sets has, so no link falls short of that bound.
    """
    same = (sa[:, :SIGNATURE] == sb[..., :SIGNATURE]).sum(axis=1)
    unlike = np.bitwise_count(sa[:, SIGNATURE:] ^ sb[..., SIGNATURE:]).sum(axis=1, dtype=np.int64)
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (same >= _least(percent)) & ((100 + percent) * unlike <= (100 - percent) * (na + nb)), same


def _agree(percent: int):
    """Of pairs (a, b, na, nb, sa, sb) those whose sizes and sketches leave it open whether they are linked."""

    def run(batches):
        for batch in batches:
            a, b, na, nb = (c.to_numpy() for c in batch.columns[:4])
            sa, sb = (_sketches(c.to_pylist()) for c in batch.columns[4:])
            keep, _ = _open(na, nb, sa, sb, percent)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (a, b)], names=["a", "b"])

    return run


def _alike(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs a, b that _agree() leaves open; sketches travel for it, not sets."""
    joined = pairs.join(sets.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
    joined = joined.join(sets.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
    return joined.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_agree(percent), "a long, b long")


def _complete(percent: int):
    """a, b, low, high, n: pairs of classes of different components (low, high) that sizes and sketches leave open, and in how many components these agree; from whole regions in order: key, rep, component, n, sketch."""

    def pairs(rows: list):
        rep, comp, n = (np.array([r[k] for r in rows]) for k in (1, 2, 3))
        sketch = _sketches([r[4] for r in rows])
        for k in range(1, len(rows)):
            open_ = np.flatnonzero(comp[:k] != comp[k])
            keep, same = _open(n[open_], n[k], sketch[open_], sketch[k], percent)
            open_, same = open_[keep], same[keep]
            if len(open_):
                yield np.stack([np.minimum(rep[open_], rep[k]), np.maximum(rep[open_], rep[k]), np.minimum(comp[open_], comp[k]), np.maximum(comp[open_], comp[k]), same])

    def told(found: list):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in np.concatenate(found, axis=1)], names=["a", "b", "low", "high", "n"])

    def run(batches):
        rows: list = []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and row[0] != rows[0][0]:
                    out += pairs(rows)
                    rows = []
                rows.append(row)
            if out:
                yield told(out)
        if rows and (out := [*pairs(rows)]):
            yield told(out)

    return run


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles % np.uint64(BUCKETS)).astype(np.int64)


def _occurrences(batches):
    """How often each bucket of shingles occurs in a task's sets."""
    n = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        for s in batch.column(0).to_pylist():
            np.add.at(n, _bucket(np.frombuffer(s, np.uint64)), 1)
    seen = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n[seen])], names=["bucket", "n"])


def _prefixes(percent: int, shared):
    """Of each set (rep, component, shingles) its first shingles, one of which any partner has, each with its place and whether partners that are not smaller have one up to there."""

    def run(batches):
        often = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                out = []
                for rep, component, packed in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns), strict=True):
                    s = np.frombuffer(packed, np.uint64)
                    n = len(s)
                    take, short = n + percent * n // -100 + 1, n + 2 * percent * n // -(100 + percent) + 1
                    first = s[np.lexsort((s, often[_bucket(s)]))[:take]]
                    place = np.arange(take)
                    out.append((first.view(np.int64), np.full(take, rep), np.full(take, component), np.full(take, n), place, place < short))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["shingle", "rep", "component", "n", "place", "short"])

    return run


def _by_prefixes(crowd: DataFrame, percent: int) -> DataFrame:
    """a, b, low, high, n: all pairs of `crowd` (rep, component, shingles) from different components (low, high) that can reach the threshold, and how many prefix shingles they share."""
    counted = crowd.select("shingles").mapInArrow(_occurrences, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    often = np.zeros(BUCKETS, dtype=np.int64)
    often[counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    run = _prefixes(percent, crowd.sparkSession.sparkContext.broadcast(often))
    prefixes = materialize(crowd.select("rep", "component", "shingles").mapInArrow(run, "shingle long, rep long, component long, n long, place long, short boolean"), "prefixes")
    shared = prefixes.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high").select("shingle")
    prefixes = materialize(prefixes.join(shared, "shingle", "left_semi"), "shared")
    x, y = prefixes.filter("short").alias("x"), prefixes.alias("y")
    met = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.component") != F.col("y.component"))
    met &= (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.rep") < F.col("y.rep")))
    left = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    met &= (100 * F.col("x.n") >= percent * F.col("y.n")) & ((100 + percent) * left >= percent * (F.col("x.n") + F.col("y.n")))
    pairs = x.join(y, met).groupBy(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))
    low, high = F.least("x.component", "y.component"), F.greatest("x.component", "y.component")
    return pairs.agg(F.min(low).alias("low"), F.min(high).alias("high"), F.count(F.lit(1)).alias("n"))


def _joined(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """u, v: links that join all components that `pairs` (as _by_prefixes has them) can join. Pairs of components that have been joined by then are left out, so a group of near copies is not compared with each of its stragglers in full."""
    order = Window.partitionBy("low", "high").orderBy(F.desc("n"), "a", "b")
    left = materialize(pairs.withColumn("k", F.row_number().over(order)), "pairs")
    upto, links = PAIR_TRIES, None
    while True:
        now = left.filter(F.col("k") <= upto).select("a", "b")
        found = materialize(_confirmed(now, _of_pairs(now, sets), percent), "links")
        links = found if links is None else links.unionByName(found)
        rest = left.filter(F.col("k") > upto)
        if rest.isEmpty():
            return links
        tried = left.select(F.col("a").alias("u"), F.col("b").alias("v"), "low", "high")
        whole = components(found.join(tried, ["u", "v"]).select(F.col("low").alias("u"), F.col("high").alias("v")))
        for side in ("low", "high"):
            moved = whole.select(F.col("node").alias(side), F.col("component").alias("now"))
            rest = rest.join(moved, side, "left").withColumn(side, F.coalesce("now", side)).drop("now")
        left, upto = materialize(rest.filter("low != high"), "pairs"), upto * MORE_TRIES


def _only(sets: DataFrame, reps: DataFrame, rows: int) -> DataFrame:
    """Of all sets, those of `reps` (one column, about `rows` of them) and of a few others, so that no more are shuffled."""
    asked = sieve(reps, rows)
    return sets.filter(asked(F.col("rep")))


def _of_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    return _only(sets, pairs.select(F.explode(F.array("a", "b")).alias("rep")), 2 * pairs.count())


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """u, v: those of the pairs a, b whose full sets reach the threshold."""
    joined = pairs.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb")), "b")
    joined = joined.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), "a")
    return joined.select("a", "b", "sa", "sb").mapInArrow(_confirm(percent), "u long, v long")


def near_duplicates(docs: DataFrame, percent: int = 75, words: int = WORDS, pairs_a_row: int = PAIRS_A_ROW) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs` (doc_id, text). `pairs_a_row` sets how regions are compared, not what is found."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = materialize(docs.mapInArrow(lambda b: _describe(b, words), "doc_id long, n_shingles long, low long, high long, sig binary"), "signatures")
    filled = described.filter("n_shingles > 0 and doc_id is not null")
    classes = materialize(filled.groupBy("low", "high").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "classes")
    reps = classes.select("rep", "sig")
    order = ["key", "deeper", "rep"]
    planted = reps.mapInArrow(_plant, "key long, deeper long, rep long")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    regions = materialize(planted.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_neighbours, "key long, deeper long, rep long, first long, before long"), "regions")

    # the sets of the classes that have company, from their texts
    # (and of a few others, which the sieve lets pass and nothing asks for)
    met = sieve(regions.select("rep"), regions.count())
    texts = docs.filter(F.col("doc_id").isNotNull() & met(F.col("doc_id"))).dropDuplicates(["doc_id", "text"])
    sets = materialize(texts.mapInArrow(lambda b: _sets(b, words), "rep long, n long, shingles binary, sketch binary"), "sets")

    tries = regions.select("rep", F.explode(F.array("first", "before")).alias("other")).filter("rep != other")
    tries = tries.groupBy(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    best = tries.withColumn("k", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("n"), "a"))).filter(F.col("k") <= FIRST_TRIES)
    likely = materialize(_alike(best.select("a", "b"), sets, percent), "likely")
    first = materialize(_confirmed(likely, _of_pairs(likely, sets), percent), "links")

    labelled = regions.select("key", "rep").join(components(first).withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    labelled = materialize(labelled, "labelled")
    unsettled = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high").select("key")
    rows = materialize(labelled.join(unsettled, "key", "left_semi").join(sets.select("rep", "n"), "rep"), "unsettled")
    parts_of = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("n") * 8 + 512).alias("bytes"))
    sizes = parts_of.groupBy("key").agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("n")).alias("same"), F.sum("bytes").alias("bytes"))
    many = (F.col("rows") * F.col("rows") - F.col("same") > 2 * pairs_a_row * F.col("rows")) | (F.col("bytes") > REGION_BYTES)
    crowded = materialize(sizes.filter(many).select("key"), "crowded")
    small = rows.join(crowded, "key", "left_anti").select("key", "rep", "component").join(sets.select("rep", "n", "sketch"), "rep").select("key", "rep", "component", "n", "sketch")
    pairs = small.repartition(parts, "key").sortWithinPartitions("key", "rep").mapInArrow(_complete(percent), "a long, b long, low long, high long, n long")
    if not crowded.isEmpty():
        crowd = materialize(rows.join(crowded, "key", "left_semi").select("rep", "component").distinct(), "crowded")
        crowd = materialize(crowd.join(_only(sets, crowd.select("rep"), crowd.count()), "rep").select("rep", "component", "shingles"), "crowd")
        pairs = pairs.unionByName(_by_prefixes(crowd, percent))
    # trees and prefixes meet the same pairs again
    pairs = pairs.groupBy("a", "b").agg(F.min("low").alias("low"), F.min("high").alias("high"), F.max("n").alias("n"))
    more = _joined(pairs, sets, percent)
    of_rep = components(first.unionByName(more)).withColumnRenamed("node", "rep")

    of_class = classes.select("low", "high", "rep").join(of_rep, "rep", "left").select("low", "high", F.coalesce("component", "rep").alias("class_component"))
    out = described.select("doc_id", "n_shingles", "low", "high").join(of_class, ["low", "high"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("class_component", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _sets(batches, words: int):
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            found = [shingle_set(t, words) for t in batch.column(1)[at : at + 512].to_pylist()]
            sketch = [_sketch(s) for s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + 512], pa.array([len(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary()), pa.array(sketch, pa.binary())], names=["rep", "n", "shingles", "sketch"])
