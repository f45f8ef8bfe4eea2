"""Vector codes by product quantisation, its codebooks found by Lloyd's rounds with heaps (Heap Lloyd).

A vector is cut into parts, and each part's position has a codebook of its own. Vectors lie in blocks of BLOCK_ROWS, one row
of a table each. A block keeps, for each codebook entry, a heap of the parts that are assigned to it, keyed by what a
part's second nearest entry is farther than its nearest one (lower bound minus upper bound) when it was last looked at. As
entries move, the key of every part of an entry shrinks by as much at most: by what the entry has moved and what the farthest
mover of the others has. So one number for each entry, its cumulative drift, tells which parts could have another nearest
entry by now: those whose key, with the drift at the time it was taken, does not exceed it. Only these are popped, compared
with all entries exactly, and pushed again; all others keep their entry without being looked at. A heap is kept as an array in
order of its keys, of which what has to be popped is a prefix.

All sums are of integers, so results are exact and do not depend on blocks. Square roots in keys are rounded towards popping.
A round is one job over the blocks, without a shuffle of vectors: it writes the blocks with their new heaps to the shared
folder, and next to them what popped parts add to and take from the sums of entries, of which the driver gets one total:
as many numbers as the codebooks have.

Defined cases: vectors that are null, hold null or non-finite components, or components beyond +-LARGEST (their squared distances
fit no long) take no part, and so do those of another length than the first of the order by vec_id; a length that is no multiple
of the parts gives parts of two lengths, the longer ones last; rows without an id come after all others; rows of equal ids are
ordered by their vectors; with fewer rows than entries there are as many entries as rows; no rows, no result; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LARGEST = 65_536
BLOCK_ROWS = 1024
#: Labels with at least one row in so many are joined apart.
HOT = 1000
#: Share of a key that rounding may be off by.
SLOP = 1e-12


@dataclass
class Codebooks:
    """Entries of all parts: (entries, length of the vectors), cut at `edges`; what entries have drifted since the first round, (parts, entries)."""

    entries: np.ndarray
    edges: list[int]
    drift: np.ndarray

    @property
    def parts(self) -> list[slice]:
        return [slice(a, b) for a, b in zip(self.edges, self.edges[1:], strict=False)]

    def moved(self, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
        """Each entry at the floor of its parts' mean; those without parts stay."""
        new = self.entries.copy()
        drift = self.drift.copy()
        for p, cut in enumerate(self.parts):
            used = counts[p] > 0
            new[used, cut] = sums[used, cut] // counts[p][used, None]
            far = np.sqrt(((new[:, cut] - self.entries[:, cut]).astype(np.float64) ** 2).sum(axis=1))
            others = np.array([np.delete(far, e).max(initial=0.0) for e in range(len(far))])
            drift[p] += far + others
        return Codebooks(new, self.edges, drift)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for cut in self.parts for row in self.entries[:, cut].tolist() for x in row).encode()).hexdigest()


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, ties to the lower one, and how much farther the second nearest is at least."""
    away = np.stack([((x - e) ** 2).sum(axis=1) for e in entries], axis=1)
    best = away.argmin(axis=1)
    first = np.sqrt(away[np.arange(len(x)), best].astype(np.float64))
    if len(entries) == 1:
        return best, np.full(len(x), np.inf)
    second = np.sqrt(np.partition(away, 1, axis=1)[:, 1].astype(np.float64))
    return best, second - first - SLOP * (second + first)


class Heaps:
    """Of one part position of a block: each row's entry and key, and the rows in order of (entry, key)."""

    def __init__(self, entry: np.ndarray, key: np.ndarray, order: np.ndarray):
        self.entry, self.key, self.order = entry, key, order

    @staticmethod
    def of(x: np.ndarray, entries: np.ndarray, drift: np.ndarray) -> Heaps:
        entry, slack = nearest(x, entries)
        key = slack + drift[entry]
        return Heaps(entry.astype(np.uint8), key, np.lexsort([key, entry]).astype(np.int32))

    def pop(self, drift: np.ndarray) -> np.ndarray:
        """Take out the rows whose entry may be another one."""
        ends = np.cumsum(np.bincount(self.entry, minlength=len(drift)))
        out, rest = [], []
        for e, (a, b) in enumerate(zip([0, *ends.tolist()], ends.tolist(), strict=False)):
            cut = a + int(np.searchsorted(self.key[self.order[a:b]], drift[e] * (1 + SLOP), side="right"))
            out.append(self.order[a:cut])
            rest.append(self.order[cut:b])
        self.order = np.concatenate(rest)
        return np.concatenate(out)

    def push(self, rows: np.ndarray, entry: np.ndarray, key: np.ndarray) -> None:
        """Put rows back, with their entries and keys of now."""
        self.entry[rows], self.key[rows] = entry, key
        new = rows[np.lexsort([key, entry])]
        # where each new row comes among those that have stayed in its entry's heap
        held = self.entry[self.order]
        at = np.empty(len(new), dtype=np.int64)
        own = self.entry[new]
        for e in np.unique(own):
            a, b = np.searchsorted(held, [e, e + 1])
            mine = own == e
            at[mine] = a + np.searchsorted(self.key[self.order[a:b]], self.key[new[mine]])
        self.order = np.insert(self.order, at, new)


def _pack(heaps: list[Heaps]) -> bytes:
    return b"".join(x.tobytes() for h in heaps for x in (h.entry, h.key, h.order))


def _unpack(payload: bytes, parts: int, n: int) -> list[Heaps]:
    out, at = [], 0
    for _ in range(parts):
        entry = np.frombuffer(payload, np.uint8, n, at).copy()
        key = np.frombuffer(payload, np.float64, n, at + n).copy()
        out.append(Heaps(entry, key, np.frombuffer(payload, np.int32, n, at + 9 * n)))
        at += 13 * n
    return out


def _change(books: Codebooks, x: np.ndarray, entry: np.ndarray, p: int, sign: int, sums: np.ndarray, counts: np.ndarray) -> None:
    np.add.at(sums[:, books.parts[p]], entry, sign * x)
    np.add.at(counts[p], entry, sign)


def _blocks(batches) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """Ids, labels and integer vectors of up to BLOCK_ROWS rows."""
    held, n = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, BLOCK_ROWS - n)
            held.append(part)
            n, at = n + part.num_rows, at + part.num_rows
            if n == BLOCK_ROWS:
                yield _joined(held)
                held, n = [], 0
    if n:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> tuple[pa.Array, pa.Array, np.ndarray]:
    rows = pa.Table.from_batches(held).combine_chunks()
    ids, labels, vectors = (c.combine_chunks() for c in rows.columns)
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
    return ids, labels, np.floor(SCALE * x).astype(np.int32)


def _first(books: Codebooks):
    """Blocks from rows, every part assigned to its nearest entry."""

    def run(batches):
        for ids, labels, x in _blocks(batches):
            wide = x.astype(np.int64)
            sums, counts = np.zeros_like(books.entries), np.zeros_like(books.drift, dtype=np.int64)
            heaps = []
            for p, cut in enumerate(books.parts):
                heaps.append(Heaps.of(wide[:, cut], books.entries[:, cut], books.drift[p]))
                _change(books, wide[:, cut], heaps[-1].entry, p, 1, sums, counts)
            yield _row(ids, labels, x.tobytes(), heaps, sums, counts, len(ids) * len(heaps))

    return run


def _row(ids: pa.Array, labels: pa.Array, x: bytes, heaps: list[Heaps], sums: np.ndarray, counts: np.ndarray, popped: int) -> pa.RecordBatch:
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    columns = [one(ids), one(labels), pa.array([x], pa.binary()), pa.array([_pack(heaps)], pa.binary()), pa.array([sums.tobytes() + counts.tobytes()], pa.binary()), pa.array([popped], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["ids", "labels", "x", "heaps", "change", "popped"])


def _walk(books: Codebooks, batches) -> Iterator[tuple[pa.Array, pa.Array, bytes, list[Heaps], np.ndarray, np.ndarray, int]]:
    """Each block after its round: popped parts rescanned, and what that changes in sums and counts."""
    for batch in batches:
        for k in range(batch.num_rows):
            ids, labels = batch.column(0)[k].values, batch.column(1)[k].values
            data = batch.column(2)[k].as_py()
            x = np.frombuffer(data, np.int32).reshape(len(ids), -1)
            heaps = _unpack(batch.column(3)[k].as_py(), len(books.parts), len(ids))
            sums, counts, popped = np.zeros_like(books.entries), np.zeros_like(books.drift, dtype=np.int64), 0
            for p, (cut, h) in enumerate(zip(books.parts, heaps, strict=True)):
                rows = h.pop(books.drift[p])
                if not len(rows):
                    continue
                popped += len(rows)
                wide, before = x[rows, cut].astype(np.int64), h.entry[rows]
                entry, slack = nearest(wide, books.entries[:, cut])
                other = entry != before
                _change(books, wide[other], before[other], p, -1, sums, counts)
                _change(books, wide[other], entry[other], p, 1, sums, counts)
                h.push(rows, entry, slack + books.drift[p][entry])
            yield ids, labels, data, heaps, sums, counts, popped


def _round(books: Codebooks):
    def run(batches):
        for ids, labels, data, heaps, sums, counts, popped in _walk(books, batches):
            yield _row(ids, labels, data, heaps, sums, counts, popped)

    return run


def _last(books: Codebooks):
    """vec_id, label, code and error of every row."""

    def run(batches):
        for ids, labels, data, heaps, *_ in _walk(books, batches):
            x = np.frombuffer(data, np.int32).reshape(len(ids), -1).astype(np.int64)
            error = np.zeros(len(ids), dtype=np.int64)
            for cut, h in zip(books.parts, heaps, strict=True):
                error += ((x[:, cut] - books.entries[h.entry, cut]) ** 2).sum(axis=1)
            digits, width = np.stack([h.entry for h in heaps], axis=1).tobytes().hex(), 2 * len(heaps)
            codes = [digits[k : k + width] for k in range(0, len(digits), width)]
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array(codes, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def _totals(blocks: DataFrame, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """What all blocks change in sums and counts."""
    size, wide = books.entries.size, books.entries.size + books.drift.size

    def run(batches):
        total = np.zeros(wide, dtype=np.int64)
        for batch in batches:
            for change in batch.column(0):
                total += np.frombuffer(change.as_buffer(), np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "value"])

    rows = blocks.select("change").mapInArrow(run, "at long, value long").groupBy("at").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(wide, dtype=np.int64)
    for r in rows:
        total[r["at"]] = r["value"]
    return total[:size].reshape(books.entries.shape), total[size:].reshape(books.drift.shape)


def usable(vector: Column) -> Column:
    """Whether a vector takes part, its length aside."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda v: F.coalesce(v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= LARGEST), F.lit(False))), F.lit(False))


@dataclass
class Compressed:
    """vec_id, label, code and error of every vector, the codebooks, how many parts each round has looked at, and all rows."""

    rows: DataFrame
    books: Codebooks
    popped: list[int]
    n: int


def compress(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Compressed | None:
    """Codes of all vectors of `table` (vec_id, embedding, label); None if it has no vector."""
    kept = table.select(F.col("vec_id").cast("long"), "label", F.col("embedding").cast("array<double>").alias("vector")).filter(usable(F.col("vector")))
    order = [F.col("vec_id").asc_nulls_last(), F.col("vector")]
    first = kept.orderBy(*order).select("vector").first()
    if first is None:
        return None
    length = len(first["vector"])
    kept = kept.filter(F.size("vector") == length)
    seeds = np.floor(SCALE * np.array([r["vector"] for r in kept.orderBy(*order).select("vector").limit(entries).collect()])).astype(np.int64)
    books = Codebooks(seeds, [length * k // parts for k in range(parts + 1)], np.zeros((parts, len(seeds))))
    label = kept.schema["label"].dataType.simpleString()
    schema = f"ids array<long>, labels array<{label}>, x binary, heaps binary, change binary, popped long"
    blocks, popped = None, []
    sums, counts = np.zeros_like(seeds), np.zeros((parts, len(seeds)), dtype=np.int64)
    for k in range(rounds):
        source = kept.select("vec_id", "label", "vector").mapInArrow(_first(books), schema) if k == 0 else blocks.mapInArrow(_round(books), schema)
        before, blocks = blocks, materialize(source, f"vectors{k}")
        if before is not None:
            drop(before)
        change, changed = _totals(blocks, books)
        popped.append(blocks.agg(F.sum("popped")).first()[0])
        sums, counts = sums + change, counts + changed
        books = books.moved(sums, counts)
    rows = materialize(blocks.mapInArrow(_last(books), f"vec_id long, label {label}, code string, error long"), "codes")
    drop(blocks)
    return Compressed(rows, books, popped, int(counts[0].sum()))


def with_label_error(found: Compressed) -> DataFrame:
    """The rows with the error summed over those of equal labels. Of labels that many rows have there are few (HOT at most), so they are broadcast; the others meet by a shuffle."""
    rows, same = found.rows, lambda side: F.col("label").eqNullSafe(side["of"])
    sums = materialize(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("rows")).withColumnRenamed("label", "of"), "labels")
    many = F.col("rows") * HOT >= found.n
    hot, cold = sums.filter(many), sums.filter(~many)
    columns = ["vec_id", "label", "code", "error", "label_error"]
    one = rows.join(F.broadcast(hot), same(hot), "left")
    others = one.filter("rows is null").drop("of", "label_error", "rows")
    return one.filter("rows is not null").select(columns).unionByName(others.join(cold, same(cold)).select(columns))


def digests(table: DataFrame) -> DataFrame:
    """The contract's columns."""
    found = compress(table)
    if found is None:
        return table.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    return with_label_error(found).select("vec_id", "code", "error", "label_error", F.lit(found.books.sha256()).alias("codebooks_sha256"))
