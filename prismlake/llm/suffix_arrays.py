"""Benchmark decontamination by suffix arrays of the training texts.

Each task cuts its documents into shards of whole texts, of about SHARD_WORDS words, and sorts the suffixes of a shard's
words: first by as many words as a 64-bit number holds, then, only where suffixes are still equal, by twice as many words
each time, until no test text is longer. Every suffix of every benchmark item is then searched in every shard by bisection,
all of a shard's searches at once: a range of the suffix array is narrowed word by word, so that it tells how far the suffix
matches verbatim, and where. Where it has matched a whole window, the range holds all occurrences of that window.

Documents are not shuffled and only a document's spans leave its task. The items' words go to the tasks in blocks of at most
BLOCK_WORDS words (or one item), each a broadcast of its own; a task has one block in memory at a time, whatever the size
of the benchmark. Items with equal windows have one range, so that occurrences are at most as many as a shard has words for
each length of windows.

Words are runs of digits, letters a-z (A-Z are lower-cased) and anything beyond ASCII. They are compared by 64-bit hashes
of all their bytes.

Defined cases: a null or empty text, and one without such characters, has no words and is hit by nothing; an item without
words is nowhere; an item of fewer words than WINDOW is one window; a null doc_id is a document like others, and repeated
rows come back as often as they are there; an item_id of several rows has the windows of all of them; items without an id
hit words, but are not named; no items, no hits; extra columns are ignored, or kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shingles import hash_words

WINDOW = 10
SHARD_WORDS, BLOCK_WORDS = 2_000_000, 1_000_000
#: Bytes of text that are hashed at a time.
PIECE = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes (never 0) of all texts in order, and how many words each text has."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, ends, data = texts.buffers()
    n = len(texts)
    if not n or data is None:
        return np.zeros(0, dtype=np.uint64), np.zeros(n, dtype=np.int64)
    at = np.frombuffer(ends, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8)
    hashes, counts, first = [], [], 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + PIECE, side="right")) - 1)
        h, c = _piece(data[at[first] : at[last]], at[first : last + 1] - at[first])
        hashes.append(h)
        counts.append(c)
        first = last
    return np.concatenate(hashes), np.concatenate(counts)


def _piece(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = _LOWER[data]
    inside = np.zeros(len(codes) + 2, dtype=bool)
    inside[1:-1] = _IN_WORD[codes]
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    # words don't go on from text to text
    cut = at[1:-1]
    cut = cut[(cut > 0) & (cut < len(codes))]
    begins[cut] = inside[1:-1][cut]
    ends[cut - 1] = inside[1:-1][cut - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return np.maximum(hash_words(codes, starts, stops), np.uint64(1)), np.diff(np.searchsorted(starts, at))


@dataclass
class Block:
    """Words of some items: hashes, how many words of the item are left from each, and the window that begins there (its length, or 0)."""

    names: list[str | None]
    hashes: np.ndarray
    left: np.ndarray
    window: np.ndarray
    item: np.ndarray
    #: The words of the longest item of the whole benchmark.
    depth: int

    @staticmethod
    def of(items: list[tuple[str | None, np.ndarray]], window: int, depth: int) -> Block:
        sizes = np.array([len(h) for _, h in items], dtype=np.int64)
        item = np.repeat(np.arange(len(items)), sizes)
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.arange(len(item)) - first
        whole = sizes[item]
        left = whole - at
        size = np.where(left >= window, window, np.where((whole < window) & (at == 0), whole, 0))
        return Block([name for name, _ in items], np.concatenate([h for _, h in items]), left, size, item, depth)


class Shard:
    """The suffix array of the words of some texts, each followed by a mark that is no word (0)."""

    def __init__(self, words: np.ndarray, depth: int):
        codes, values = pd.factorize(words)
        self.codes = codes.astype(np.int32)
        order = np.argsort(values)
        self.values, self.value_codes = values[order], order.astype(np.int32)
        self.order = self._sorted(depth)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.codes, minlength=len(values)))])

    def _sorted(self, depth: int) -> np.ndarray:
        """Positions of words in the order of what follows them, as far as `depth` words."""
        n = len(self.codes)
        bits = int(self.codes.max() + 1).bit_length() if n else 1
        known = max(1, min(64 // bits, n))
        key = np.zeros(n, dtype=np.uint64)
        for k in range(known):  # the end of all comes before any word
            key <<= np.uint64(bits)
            key[: n - k] |= (self.codes[k:] + 1).astype(np.uint64)
        order = np.argsort(key)
        key = key[order]
        # of each position, where the positions that are equal so far begin in the order
        rank = np.zeros(n + 1, dtype=np.int64)
        open_ = np.arange(n)
        while True:
            fresh = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=bool)
            rank[order[open_]] = open_[np.maximum.accumulate(np.where(fresh, np.arange(len(open_)), 0))]
            open_ = open_[~(fresh & np.concatenate([fresh[1:], [True]]))] if len(open_) else open_
            if known >= depth or not len(open_):
                return order
            tied = order[open_]
            further = np.where(tied + known < n, rank[np.minimum(tied + known, n)] + 1, 0)
            key = (rank[tied].astype(np.uint64) << np.uint64(32)) | further.astype(np.uint64)
            by = np.argsort(key)
            order[open_] = tied[by]
            key = key[by]
            known *= 2

    def code_of(self, hashes: np.ndarray) -> np.ndarray:
        """The shard's codes of words, -1 for those that it doesn't have."""
        at = np.minimum(np.searchsorted(self.values, hashes), len(self.values) - 1)
        return np.where(self.values[at] == hashes, self.value_codes[at], -1)

    def _bound(self, low: np.ndarray, high: np.ndarray, k: int, code: np.ndarray, above: bool) -> np.ndarray:
        """In each range of the order, the first place whose k-th word is not below `code` (or is above it)."""
        low, high = low.copy(), high.copy()
        rows = np.flatnonzero(low < high)
        while len(rows):
            mid = (low[rows] + high[rows]) >> 1
            seen = self.codes[self.order[mid] + k]
            go = seen <= code[rows] if above else seen < code[rows]
            low[rows[go]] = mid[go] + 1
            high[rows[~go]] = mid[~go]
            rows = rows[low[rows] < high[rows]]
        return low

    def search(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each suffix of the block: how many words match at most, a place where they do, and the range of the order that its window has (empty: nowhere)."""
        code = self.code_of(block.hashes)
        m = len(code)
        matched, place = np.zeros(m, dtype=np.int64), np.zeros(m, dtype=np.int64)
        low, high = np.zeros(m, dtype=np.int64), np.zeros(m, dtype=np.int64)
        rows = np.flatnonzero(code >= 0)
        a, b = self.first[code[rows]], self.first[code[rows] + 1]
        k = 1
        while len(rows):
            matched[rows], place[rows] = k, self.order[a]
            whole = block.window[rows] == k
            low[rows[whole]], high[rows[whole]] = a[whole], b[whole]
            on = block.left[rows] > k
            on[on] = code[rows[on] + k] >= 0
            rows, a, b = rows[on], a[on], b[on]
            next_code = code[rows + k]
            a, b = self._bound(a, b, k, next_code, False), self._bound(a, b, k, next_code, True)
            there = a < b
            rows, a, b = rows[there], a[there], b[there]
            k += 1
        return matched, place, low, high


def _spread(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers of several ranges."""
    n = high - low
    return np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)


@dataclass
class _Texts:
    """Documents of a shard in the making: batches of rows to keep, their words, and words a document."""

    kept: list[pa.RecordBatch] = field(default_factory=list)
    words: list[np.ndarray] = field(default_factory=list)
    counts: list[np.ndarray] = field(default_factory=list)
    n: int = 0

    def add(self, kept: pa.RecordBatch, words: np.ndarray, counts: np.ndarray) -> None:
        self.kept.append(kept)
        self.words.append(words)
        self.counts.append(counts)
        self.n += len(words)

    def shard(self, depth: int) -> tuple[Shard, np.ndarray, np.ndarray]:
        """The suffix array, words a document, and where each document begins in it."""
        counts = np.concatenate(self.counts)
        begins = np.cumsum(counts + 1) - (counts + 1)
        marked = np.zeros(int((counts + 1).sum()), dtype=np.uint64)
        marked[np.arange(self.n) + np.repeat(np.arange(len(counts)), counts)] = np.concatenate(self.words)
        return Shard(marked, depth), counts, begins


def _shards(batches, depth: int) -> Iterator[tuple[_Texts, Shard, np.ndarray, np.ndarray]]:
    """Shards of the task's documents. The text is the last column of a batch, the others are kept."""
    held = _Texts()
    for batch in batches:
        names = batch.schema.names[:-1]
        words, counts = word_hashes(batch.column(batch.num_columns - 1))
        ends = np.cumsum(counts)
        first = 0
        while first < batch.num_rows:
            before = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + SHARD_WORDS - held.n, side="right")))
            held.add(batch.select(names).slice(first, last - first), words[before : ends[last - 1]], counts[first:last])
            first = last
            if held.n >= SHARD_WORDS or first < batch.num_rows:
                yield held, *held.shard(depth)
                held = _Texts()
    if held.kept:
        yield held, *held.shard(depth)


HITS = "n_words long, n_hit long, spans array<struct<start:long,length:long>>, items array<string>"
_SPAN = pa.struct([("start", pa.int64()), ("length", pa.int64())])


def _hits(blocks: list):
    """For each document its rows to keep, and HITS."""

    def run(batches):
        depth = blocks[0].value.depth if blocks else 1
        for held, shard, counts, begins in _shards(batches, depth):
            n = len(shard.codes)
            edges = np.zeros(n + 1, dtype=np.int64)
            found: list[set[str]] = [set() for _ in counts]
            for b in blocks:
                block = b.value
                _, _, low, high = shard.search(block)
                rows = np.flatnonzero(low < high)
                # equal windows have one range
                ranges, which = np.unique(np.stack([low[rows], high[rows], block.window[rows]], axis=1), axis=0, return_inverse=True)
                which = which.reshape(-1)
                at = shard.order[_spread(ranges[:, 0], ranges[:, 1])]
                each = np.repeat(np.arange(len(ranges)), ranges[:, 1] - ranges[:, 0])
                np.add.at(edges, at, 1)
                np.add.at(edges, at + ranges[each, 2], -1)
                # the items of a window, once for each document that has it
                items = np.unique(which * len(block.names) + block.item[rows])
                of = np.searchsorted(items, np.arange(len(ranges) + 1) * len(block.names)).tolist()
                items = (items % len(block.names)).tolist()
                doc = np.searchsorted(begins, at, side="right") - 1
                for pair in np.unique(doc * max(len(ranges), 1) + each).tolist():
                    d, w = divmod(pair, len(ranges))
                    found[d].update(block.names[k] for k in items[of[w] : of[w + 1]])
                if len(blocks) > 1:
                    b.unpersist_value()
            hit = np.cumsum(edges[:-1]) > 0
            turn = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
            starts, stops = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
            doc = np.searchsorted(begins, starts, side="right") - 1
            sums = np.concatenate([[0], np.cumsum(hit)])
            n_hit = sums[begins + counts] - sums[begins]
            spans = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(doc, np.arange(len(counts) + 1)).astype(np.int32)),
                pa.StructArray.from_arrays([pa.array(starts - begins[doc]), pa.array(stops - starts)], fields=list(_SPAN)),
            )
            names = pa.array([sorted(x for x in f if x is not None) for f in found], pa.list_(pa.string()))
            done = 0
            for kept in held.kept:
                part = slice(done, done + kept.num_rows)
                more = [pa.array(counts[part]), pa.array(n_hit[part]), spans[part], names[part]]
                yield pa.RecordBatch.from_arrays([*kept.columns, *more], names=[*kept.schema.names, "n_words", "n_hit", "spans", "items"])
                done += kept.num_rows

    return run


def _longest(blocks: list):
    """For each item and shard its longest match."""

    def run(batches):
        depth = blocks[0].value.depth if blocks else 1
        for held, shard, _, begins in _shards(batches, depth):
            ids = pa.chunked_array([k.column(0) for k in held.kept])
            for b in blocks:
                block = b.value
                matched, place, _, _ = shard.search(block)
                rows = np.flatnonzero(matched)
                # the longest of each item, first by its place in the item
                best = rows[np.lexsort([rows, -matched[rows], block.item[rows]])]
                best = best[np.concatenate([[True], np.diff(block.item[best]) != 0])] if len(best) else best
                doc = np.searchsorted(begins, place[best], side="right") - 1
                first = np.searchsorted(block.item, block.item[best])
                columns = [pa.array([block.names[k] for k in block.item[best].tolist()], pa.string()), pa.array(best - first), pa.array(matched[best]), ids.take(pa.array(doc)).combine_chunks(), pa.array(place[best] - begins[doc])]
                yield pa.RecordBatch.from_arrays(columns, names=["item_id", "item_word", "length", "doc_id", "doc_word"])
                if len(blocks) > 1:
                    b.unpersist_value()

    return run


class _Shared:
    """A broadcast value of which a task can let go."""

    def __init__(self, broadcast):
        self.broadcast = broadcast

    @property
    def value(self) -> Block:
        return self.broadcast.value

    def unpersist_value(self) -> None:
        self.broadcast.__dict__.pop("_value", None)


def blocks_of(benchmark: DataFrame, window: int = WINDOW) -> list[_Shared]:
    """The items (item_id, text) as words, in blocks of at most BLOCK_WORDS words or one item; the driver holds one block at a time."""

    def run(batches):
        for batch in batches:
            words, counts = word_hashes(batch.column(1))
            ends = np.cumsum(counts).tolist()
            payload = [words[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(payload, pa.binary())], names=["item_id", "words"])

    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string"), "text").mapInArrow(run, "item_id string, words binary").filter(F.octet_length("words") > 0)
    depth = (items.agg(F.max(F.octet_length("words"))).first()[0] or 0) // 8
    out, held, n = [], [], 0
    share = lambda: out.append(_Shared(spark.sparkContext.broadcast(Block.of(held, window, depth))))
    for row in items.toLocalIterator():
        words = np.frombuffer(bytes(row["words"]), dtype=np.uint64)
        if held and n + len(words) > BLOCK_WORDS:
            share()
            held, n = [], 0
        held.append((row["item_id"], words))
        n += len(words)
    if held:
        share()
    return out


def find(docs: DataFrame, benchmark: DataFrame, keep: list[str | Column] | None = None, window: int = WINDOW) -> DataFrame:
    """For each of `docs` the columns to keep (doc_id), its words, how many are in an occurrence of a window, the stretches of these, and the items (as strings, in order) whose windows occur."""
    rows = docs.select(*(keep or ["doc_id"]), F.col("text").alias("_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + [HITS])
    return rows.mapInArrow(_hits(blocks_of(benchmark, window)), schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, with all their columns, in which no window occurs."""
    found = find(docs, benchmark, [F.struct(*docs.columns).alias("row")], window)
    return found.filter("n_hit = 0").select("row.*")


def longest_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """For each item that has a word in any document, its longest verbatim match: where it begins in the item, how many words it has, and a document and word where it is (of several places in a shard, any)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").alias("_text"))
    found = rows.mapInArrow(_longest(blocks_of(benchmark)), "item_id string, item_word long, length long, doc_id long, doc_word long")
    order = F.struct(-F.col("length"), F.col("item_word"), F.col("doc_id").isNull(), "doc_id", "doc_word")
    best = found.groupBy("item_id").agg(F.min_by(F.struct("item_word", "length", "doc_id", "doc_word"), order).alias("best"))
    return best.select("item_id", "best.*")


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
