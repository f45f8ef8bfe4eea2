"""Blocks: documents of one scan task share a dictionary of their distinct words.

A block's documents are sequences of positions in that dictionary, so that a global shuffle by word carries each word
once a block and not once an occurrence, and what the shuffle finds out about a word comes back once a block. Words go by
buckets of a hash: a row holds a block's words of one bucket, packed, and the dictionary is in the order of buckets, so
that answers need no positions. A word that is everywhere stands once in each block's row.

Blocks are cut where the task's dictionary or its sequences reach a bound, so a block fits in memory whatever the table
holds. They depend on the order of a task's input: `docs` has to be a scan of files (a table, or what
common.materialize returns), which a retried task reads in the same order. A block's number is a hash of its dictionary, so
if two scans differ their blocks don't meet, and reassembly raises.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

MOST_WORDS, MOST_TOKENS = 400_000, 6_000_000
#: Bytes of text for each bucket of words, of which a task holds one at a time; and the least number of buckets.
BYTES_A_BUCKET, LEAST_BUCKETS = 2 << 20, 8
SCHEMA = "block long, bucket int, at int, doc_id long, payload binary"
ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("at", pa.int32()), ("doc_id", pa.int64()), ("payload", pa.binary())])
#: The bucket of document rows: after all words.
DOCUMENTS = (1 << 31) - 1


def pack(values: np.ndarray) -> bytes:
    """An array of numbers, its bytes in planes, compressed."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 3)


def unpack(payload: bytes, dtype: str) -> np.ndarray:
    kind = np.dtype(dtype)
    planes = np.frombuffer(zstandard.decompress(payload, max_output_size=1 << 34), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).reshape(-1)


def join(parts: list[bytes]) -> bytes:
    """Several byte strings as one, each after its length."""
    return b"".join(x for p in parts for x in (len(p).to_bytes(8, "little"), p))


def parts_of(payload: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(payload):
        n = int.from_bytes(payload[at : at + 8], "little")
        out.append(payload[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def pack_words(words: list[bytes]) -> bytes:
    return join([pack(np.array([len(w) for w in words], dtype="<u4")), zstandard.compress(b"".join(words), 3)])


def unpack_words(packed: list[bytes]) -> list[bytes]:
    ends = np.cumsum(unpack(packed[0], "<u4")).tolist()
    data = zstandard.decompress(packed[1], max_output_size=1 << 34)
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def buckets(docs: DataFrame) -> int:
    """As many as the texts of `docs` ask for."""
    return max(LEAST_BUCKETS, text_bytes(docs) // BYTES_A_BUCKET)


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 256):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 256], strict=True), ARROW.types, strict=True)], schema=ARROW)


def cut(docs: DataFrame, split: Callable[[str], list[str]], n_buckets: int, documents: bool) -> DataFrame:
    """Rows of the blocks of `docs` (doc_id, text); null texts are empty.

    Without `documents`, the words: a block's words of a bucket, and the position of the first in the dictionary. With it,
    the documents' sequences of positions.
    """

    def run(batches):
        task = seq = tokens = 0
        words: dict[str, int] = {}
        held: list[tuple] = []  # id, positions

        def flush():
            spelt = [w.encode("utf-8", "surrogatepass") for w in words]
            block = xxhash.xxh3_64_intdigest(b"\0".join(spelt), seed=(task << 16) + seq) >> 1
            bucket = np.array([zlib.crc32(w) for w in spelt], dtype=np.int64) % n_buckets
            by_word = np.array(sorted(range(len(spelt)), key=spelt.__getitem__), dtype=np.int64)
            order = by_word[np.argsort(bucket[by_word], kind="stable")]
            if documents:
                place = np.empty(len(order), dtype="<u4")
                place[order] = np.arange(len(order))
                yield from _batches([(block, DOCUMENTS, None, d, pack(place[s])) for d, s in held])
                return
            sorted_buckets = bucket[order]
            starts = np.flatnonzero(np.diff(np.concatenate([[-1], sorted_buckets])))
            out = []
            for a, b in zip(starts, [*starts[1:], len(order)], strict=True):
                payload = pack_words([spelt[k] for k in order[a:b]])
                out.append((block, int(sorted_buckets[a]), int(a), None, payload))
            yield from _batches(out)

        for batch in batches:
            if batch.num_rows:
                task = batch.column(2)[0].as_py()
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = split(text or "")
                if documents:
                    held.append((doc_id, np.array([words.setdefault(w, len(words)) for w in found], dtype="<u4")))
                else:
                    for w in dict.fromkeys(found):
                        words.setdefault(w, len(words))
                tokens += len(found)
                if len(words) >= MOST_WORDS or tokens >= MOST_TOKENS:
                    yield from flush()
                    words, held, tokens, seq = {}, [], 0, seq + 1
        if words or held:
            yield from flush()

    # the scan's own partition number: a task's number also counts the other side of a union
    return docs.select(F.col("doc_id").cast("long"), "text", F.spark_partition_id()).mapInArrow(run, SCHEMA)


def answer(words: DataFrame, known: Callable[[list[list[bytes]]], list[bytes]]) -> DataFrame:
    """Word rows brought together by bucket, each row's payload replaced by what `known` says about the rows of one bucket.

    `known` gets the parts of the payload of each row of a bucket. A bucket has the words of about BYTES_A_BUCKET of text.
    """

    def run(batches):
        rows: list[tuple] = []

        def out():
            got = known([parts_of(r[4]) for r in rows])
            yield from _batches([(*r[:4], p) for r, p in zip(rows, got, strict=True)])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and row[1] != rows[0][1]:
                    yield from out()
                    rows = []
                rows.append(row)
        if rows:
            yield from out()

    return words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, SCHEMA)


def by_block(words: DataFrame, docs: DataFrame) -> DataFrame:
    """Bring each block's word rows and then its document rows together, in order."""
    return words.unionByName(docs).repartition("block").sortWithinPartitions("block", "bucket")


def walk(batches) -> Iterator[tuple[list[bytes], Iterator[tuple[int | None, np.ndarray]]]]:
    """From the rows of by_block(), a block at a time: its word payloads in the dictionary's order with their first positions, and its documents' sequences as they stream in."""
    rows = ((b, k, a, d, p) for batch in batches for b, k, a, d, p in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    row = next(rows, None)
    while row is not None:
        block, known = row[0], []
        while row is not None and row[0] == block and row[1] != DOCUMENTS:
            known.append((row[2], row[4]))
            row = next(rows, None)

        def documents(block=block):
            nonlocal row
            while row is not None and row[0] == block:
                yield row[3], unpack(row[4], "<u4")
                row = next(rows, None)

        yield known, documents()


def in_place(sizes: list[tuple[int, int]]) -> None:
    """Raise unless (first position, number of words) follow each other without a gap."""
    at = 0
    for first, n in sizes:
        if first != at:
            raise RuntimeError(f"the words from position {at} of a block are missing")
        at += n
