"""Periodic runs of words by partition refinement (Crochemore).

Positions of a text are in one class of level q if the q words from them are equal. The classes of level q + 1 are those of
level q, split by the classes of the positions that follow: all classes that a class was split into but the largest split
their predecessors, so that a position is in a splitting class at most log n times. Where a position's next fellow in its
class is q away, the 2q words from it are a square of smallest period q; where the fellow has one in turn, q words on, three
equal factors follow each other. Neighbouring starts of such cubes make a run: a maximal stretch of smallest period q that
is at least 3q long. A class of fewer than three positions can't have one and neither can any that it is split into or that
precede it, so its positions drop out for good.

The first BULK levels are refined for all documents of a batch at once, by sorting (class, class of the next position); after
them few positions are left but where texts repeat themselves, and each document goes on by itself, splitting smaller halves.
A document is one row's work: words * log(words) steps.

Words are maximal runs without space, tab, line feed, vertical tab, form feed and carriage return, compared as they are.

Defined cases: a null or empty text, or one of white space only, has no words and no runs; a null id is a document whose text
is not edited; repeated rows come back as often as they are there; of runs of equal exponent the one of the smallest start,
then period, is told; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has at least so many words, and periods.
LEAST_WORDS, PERIODS = 24, 3
#: Levels that are refined for a whole batch, and the words of a batch (or one document).
BULK, BATCH_WORDS = 4, 300_000


class Refinement:
    """Classes of a text's positions from one level on, each a list in order of position; splits by smaller halves."""

    def __init__(self, n: int, level: int, places: list[int], classes: list[int], next_classes: list[int]):
        """`classes` of `places` at `level`, and of the positions after them (below 0: a class of fewer than three, or the end)."""
        self.n, self.level = n, level
        self.of: dict[int, int] = {}
        self.next: dict[int, int] = {}
        self.before: dict[int, int] = {}
        self.tail: dict[int, int] = {}
        self.size: dict[int, int] = {}
        self.fresh = 0
        #: Positions by the distance to their next fellow: some are out of date.
        self.far: dict[int, list[int]] = {}
        #: What splits their predecessors at the next step: positions without a class, and classes.
        self.gone: list[int] = []
        self.small: list[list[int]] = []
        # one step by all classes
        self.level += 1
        parts: dict[int, dict[int, list[int]]] = {}
        for place, old, after in zip(places, classes, next_classes, strict=True):
            if after < 0:
                self.gone.append(place)
            else:
                parts.setdefault(old, {}).setdefault(after, []).append(place)
        for part in parts.values():
            largest = max(part.values(), key=len)
            for group in part.values():
                if len(group) < PERIODS:
                    self.gone += group
                    continue
                self._found(group)
                if group is not largest:
                    self.small.append(group)

    def _found(self, group: list[int]) -> None:
        """A new class."""
        name = self.fresh = self.fresh + 1
        self.size[name], self.tail[name] = len(group), group[-1]
        of, far, last = self.of, self.far, None
        for p in group:
            of[p] = name
            if last is not None:
                self.next[last], self.before[p] = p, last
                far.setdefault(p - last, []).append(last)
            last = p
        self.before.pop(group[0], None)
        self.next.pop(last, None)

    def _leave(self, p: int) -> None:
        """Take a position out of its class."""
        name = self.of.pop(p)
        self.size[name] -= 1
        a, b = self.before.pop(p, None), self.next.pop(p, None)
        if a is not None and b is not None:
            self.next[a], self.before[b] = b, a
            self.far.setdefault(b - a, []).append(a)
        elif a is not None:
            del self.next[a]
        elif b is not None:
            del self.before[b]
        if b is None and a is not None:
            self.tail[name] = a

    def step(self) -> None:
        """To the next level."""
        of, gone, small = self.of, [], []
        parents: dict[int, list[list[int]]] = {}
        for p in [*(x - 1 for x in self.gone), self.n - self.level]:
            if p in of:
                parents.setdefault(of[p], [])
                self._leave(p)
                gone.append(p)
        for splitter in self.small:
            parts: dict[int, list[int]] = {}
            for x in splitter:
                name = of.get(x - 1)
                if name is not None:
                    parts.setdefault(name, []).append(x - 1)
            for name, group in parts.items():
                if len(group) < self.size[name]:
                    for p in group:
                        self._leave(p)
                    if len(group) < PERIODS:
                        gone += group
                        parents.setdefault(name, [])
                    else:
                        parents.setdefault(name, []).append(group)
        for name, groups in parents.items():
            rest = self.size[name]
            if rest < PERIODS:
                p = self.tail[name] if rest else None
                while p is not None:
                    p, q = self.before.get(p), p
                    self._leave(q)
                    gone.append(q)
            if not groups:
                continue
            largest = max(groups, key=len) if rest < max(map(len, groups)) else None
            for group in groups:
                self._found(group)
                if group is not largest:
                    small.append(group)
            if largest is not None and rest >= PERIODS:
                kept, p = [], self.tail[name]
                while p is not None:
                    kept.append(p)
                    p = self.before.get(p)
                small.append(kept[::-1])
        self.gone, self.small, self.level = gone, small, self.level + 1

    def cubes(self) -> list[int]:
        """Where, in order, two squares of the level's period follow each other."""
        q, after = self.level, self.next
        squares = {p for p in self.far.pop(q, ()) if after.get(p) == p + q}
        return sorted(p for p in squares if p + q in squares)


def _merged(starts: list[int], period: int) -> Iterator[tuple[int, int, int]]:
    """Runs (start, length, period) of neighbouring starts of cubes."""
    first = last = None
    for p in starts:
        if last is not None and p != last + 1:
            yield first, last - first + PERIODS * period, period
            first = None
        first, last = p if first is None else first, p
    if first is not None:
        yield first, last - first + PERIODS * period, period


def _bulk(codes: np.ndarray, sizes: np.ndarray) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, np.ndarray]], np.ndarray]:
    """The first BULK levels of several texts, of which `codes` are the words (equal only within a text) and `sizes` how many each has.

    The runs of each text of these periods, (text, places) where positions are left, and the classes of all positions (below
    0: none).
    """
    begins = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(sizes)), sizes)
    # the position after the last of a text has no class, as all that are alone
    classes = np.full(len(codes) + 1, -1)
    left = np.flatnonzero(np.bincount(codes)[codes] >= PERIODS)
    classes[left] = codes[left]
    runs: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    ends = np.zeros(len(codes) + 1, dtype=bool)
    ends[begins[1:]] = True
    for level in range(1, BULK + 1):
        by = left[np.argsort(classes[left], kind="stable")]
        near = (np.diff(by) == level) & (np.diff(classes[by]) == 0)
        square = np.zeros(len(codes) + level + 1, dtype=bool)
        square[by[:-1][near]] = True
        cubes = np.flatnonzero(square[: len(codes)] & square[level : len(codes) + level])
        if len(cubes):
            apart = np.flatnonzero((np.diff(cubes) != 1) | (np.diff(text[cubes]) != 0))
            for a, b in zip(cubes[[0, *apart + 1]].tolist(), cubes[[*apart, -1]].tolist(), strict=True):
                t = int(text[a])
                runs[t].append((a - int(begins[t]), b - a + PERIODS * level, level))
        if level == BULK:
            break
        after = np.where(ends[left + 1], -1, classes[left + 1])
        left, own, after = left[after >= 0], classes[left][after >= 0], after[after >= 0]
        _, at, n = np.unique(own * (len(codes) + 1) + after, return_inverse=True, return_counts=True)
        classes[:] = -1
        classes[left[n[at] >= PERIODS]] = at[n[at] >= PERIODS]
        left = left[n[at] >= PERIODS]
    own = text[left]
    first = np.flatnonzero(np.diff(own, prepend=-1))
    return runs, [(int(own[a]), p - begins[own[a]]) for a, p in zip(first, np.split(left, first[1:]), strict=True)] if len(left) else [], classes


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """For each text, given as its words, its runs (start, length, period) by start, then period."""
    sizes = np.array([len(w) for w in texts], dtype=np.int64)
    codes, base = [], 0
    for words in texts:
        seen: dict[bytes, int] = {}
        codes += map(seen.setdefault, words, range(base, base + len(words)))
        base += len(words)
    if not base:
        return [[] for _ in texts]
    runs, left, classes = _bulk(np.array(codes, dtype=np.int64), sizes)
    begins = np.cumsum(sizes) - sizes
    for t, places in left:
        n, at = int(sizes[t]), places + begins[t]
        after = np.where(places + 1 < n, classes[at + 1], -1)
        r = Refinement(n, BULK, places.tolist(), classes[at].tolist(), after.tolist())
        while r.of and r.level * PERIODS <= n:
            if r.level in r.far:
                runs[t] += _merged(r.cubes(), r.level)
            r.step()
    return [sorted(x for x in found if x[1] >= LEAST_WORDS) if found else found for found in runs]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words but those that a run contains after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]


def edited(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The contract's edit: of one document in ten, the words from some place on repeat its first ones."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def _batched(batches) -> Iterator[tuple[list, list[pa.StringScalar], list[list[bytes]]]]:
    """Ids, texts and words of documents, of at most BATCH_WORDS words or one document."""
    ids, texts, split, n = [], [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = text.as_buffer().to_pybytes().split() if text.is_valid else []
            if ids and n + len(words) > BATCH_WORDS:
                yield ids, texts, split
                ids, texts, split, n = [], [], [], 0
            ids.append(doc_id)
            texts.append(text)
            split.append(words)
            n += len(words)
    if ids:
        yield ids, texts, split


def find(docs: DataFrame) -> DataFrame:
    """doc_id and its runs, by start, then period, for every row of `docs`."""

    def run(batches):
        for ids, _, split in _batched(batches):
            found = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for runs in runs_of(split)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, kind)], names=["doc_id", "runs"])

    kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>")


def collapse(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs and the text without what repeats (its words joined by blanks), for every row; a null text stays null, one without runs stays as it is."""

    def run(batches):
        for ids, texts, split in _batched(batches):
            found = runs_of(split)
            out = [b" ".join(collapsed(w, r)).decode() if r else t.as_py() for t, w, r in zip(texts, split, found, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(r) for r in found], pa.int64()), pa.array(out, pa.string())], names=["doc_id", "n_runs", "text"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_runs long, text string")


DIGESTS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def digests(docs: DataFrame) -> DataFrame:
    """The contract's columns, of the documents as it edits them."""

    def run(batches):
        for ids, _, split in _batched(batches):
            texts = [edited(w, i) for i, w in zip(ids, split, strict=True)]
            rows = []
            for doc_id, words, runs in zip(ids, texts, runs_of(texts), strict=True):
                best = None
                for r in runs:
                    if best is None or r[1] * best[2] > best[1] * r[2]:
                        best = r
                told = hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
                kept = hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()
                rows.append((doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, told, kept))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [*[pa.int64()] * 6, *[pa.string()] * 2], strict=True)], names=[x.split()[0] for x in DIGESTS.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, DIGESTS)
