"""Byte-level BPE over a vocabulary of ranks: encoding by a global shuffle of distinct words, decoding by the token-byte table.

Texts are split by the tokenizer's pattern; each distinct pre-token is encoded once, in the partition it hashes to, and
its ids go back to the positions where it stands (see blocks.py). Decoding looks ids up in the table of token bytes,
which a vocabulary bounds (one row a rank) and every task gets as a broadcast.

Defined cases: null and empty texts have no ids and decode to no bytes; a pre-token of any length is merged in
O(n log n); repeated rows and null ids give one result row for each row; extra columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: the adjacent pair of least rank merges first, the leftmost of equals."""
    if word in ranks:
        return [ranks[word]]
    if len(word) <= 48:
        parts = [word[i : i + 1] for i in range(len(word))]
        pairs = [ranks.get(parts[i] + parts[i + 1], 1 << 60) for i in range(len(parts) - 1)]
        while pairs and (least := min(pairs)) < 1 << 60:
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
        return [ranks[p] for p in parts]
    # long pre-tokens: a heap of pairs over a linked list
    n = len(word)
    ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or ends[i] >= n or ends[ends[i]] != end:
            continue
        alive[ends[i]] = False
        ends[i] = end
        if end < n:
            before[end] = i
            if (r := ranks.get(word[i : ends[end]])) is not None:
                heapq.heappush(heap, (r, i, ends[end]))
        if (j := before[i]) >= 0 and (r := ranks.get(word[j:end])) is not None:
            heapq.heappush(heap, (r, j, end))
    return [ranks[word[i : ends[i]]] for i in range(n) if alive[i]]


def ascii_pattern(pattern: str) -> str | None:
    """A pattern that splits ASCII texts in the same way with fewer kinds of characters to look up; None if there is none."""
    for kind, inside in (("L", "A-Za-z"), ("N", "0-9")):
        # in a class of characters as it is, elsewhere as a class of its own
        pattern = re.sub(rf"(\[[^\]]*)\\p\{{{kind}\}}", rf"\g<1>{inside}", pattern)
        pattern = pattern.replace(rf"\p{{{kind}}}", f"[{inside}]")
    return None if re.search(r"\\[pPwWdDbB]|\(\?[a-zA-Z]", pattern) else pattern


def splitter(pattern: str):
    """A function that splits a text by a pattern."""
    general, plain = regex.compile(pattern).findall, ascii_pattern(pattern)
    if plain is None:
        return general
    quick = re.compile(plain, re.ASCII).findall
    return lambda text: quick(text) if text.isascii() else general(text)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of every row of `docs` (doc_id, text), a scan of files."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(ranks)

    def split(text: str, cache={}):  # noqa: B006  one compiled pattern a worker
        if "p" not in cache:
            cache["p"] = splitter(pattern)
        return cache["p"](text)

    def ids_of(rows: list[list[bytes]]) -> list[bytes]:
        table, known, out = shared.value, {}, []
        for packed in rows:
            ids = []
            for word in blocks.unpack_words(packed):
                if (got := known.get(word)) is None:
                    got = known[word] = merge(word, table)
                ids.append(got)
            lengths = np.array([len(x) for x in ids], dtype="<u4")
            out.append(blocks.join([blocks.pack(lengths), blocks.pack(np.array([i for x in ids for i in x], dtype="<u4"))]))
        return out

    n_buckets = blocks.buckets(docs)
    words = blocks.answer(blocks.cut(docs, split, n_buckets, False), ids_of)

    def assemble(batches):
        for known, documents in blocks.walk(batches):
            got = [(at, [blocks.unpack(p, "<u4") for p in blocks.parts_of(payload)]) for at, payload in known]
            blocks.in_place([(at, len(lengths)) for at, (lengths, _) in got])
            lengths = np.concatenate([x[0] for _, x in got]).astype(np.int64) if got else np.zeros(0, np.int64)
            flat = np.concatenate([x[1] for _, x in got]).astype(np.int32) if got else np.zeros(0, np.int32)
            starts = np.concatenate([[0], np.cumsum(lengths)])
            ids, pieces, n = [], [], 0
            for doc_id, seq in documents:
                if len(seq) and int(seq.max()) >= len(lengths):
                    raise RuntimeError(f"a block has no word {int(seq.max())}")
                size = lengths[seq]
                # the ids of each position, laid out one after the other
                at = np.repeat(starts[seq] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
                ids.append(doc_id)
                pieces.append(flat[at])
                n += len(at)
                if n >= 1_000_000:
                    yield _tokens(ids, pieces)
                    ids, pieces, n = [], [], 0
            if ids:
                yield _tokens(ids, pieces)

    return blocks.by_block(words, blocks.cut(docs, split, n_buckets, True)).mapInArrow(assemble, "doc_id long, ids array<int>")


def _tokens(ids: list, pieces: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(pieces).astype(np.int32)))], names=["doc_id", "ids"])


def decode(tokens: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """`tokens` (doc_id, ids) with `decoded`, the bytes that the ids stand for; an id outside the vocabulary raises, null ids decode to nothing."""
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    shared = tokens.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        lookup = shared.value.__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = [b"".join(map(lookup, (x.values.to_numpy() if x.is_valid else ()))) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=["doc_id", "ids", "decoded"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """Counts and hashes of ids and decoded bytes."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
