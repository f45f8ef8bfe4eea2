"""Substring search by an index of trigrams.

Every three characters that follow each other in a row's searched columns are a gram. The index is a table of postings: a
gram, a block of BLOCK ids, and which of them have the gram, in files by ranges of grams, so that a search reads the row groups
of its own grams. A term's candidates are the ids that have all its grams: postings of a block are intersected where
they are, block by block. A candidate is not yet a match: it is looked up and the term is tested on its row as a scan would test
it. So rows that were removed or changed since need no upkeep but adding the changed ones again.

`%` and `_` in a term are wildcards; grams are taken between them. A term without three characters in a row has no
grams and is searched by a scan.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import LOWER, UPPER, contains_like, fold
from .search import TEXT_COLUMNS

GRAM, BLOCK = 3, 1 << 16
#: Rows whose postings are made together.
ROWS_A_STEP = 10_000
#: A search intersects at most so many grams, evenly out of the term's: each candidate is tested on its row anyway.
MOST_GRAMS = 8
#: A search that finds so few blocks tells the scan which ids they have.
FEW_BLOCKS = 64
#: Between columns; no term has it.
BETWEEN = "\x00"


def _postings(batches):
    """Postings of each batch's rows (id, text): gram, block, ids. Grams are numbers of three characters until they are told."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_A_STEP):
            part = batch.slice(at, ROWS_A_STEP)
            ids, texts = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64), part.column(1).to_pylist()
            sizes = np.array([len(t) + GRAM for t in texts])
            # between texts stands what no gram has
            chars = np.frombuffer((BETWEEN * GRAM).join([*texts, ""]).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
            key = (chars[:-2] << np.uint64(42)) | (chars[1:-1] << np.uint64(21)) | chars[2:]
            whole = np.flatnonzero((chars[:-2] > 0) & (chars[1:-1] > 0) & (chars[2:] > 0))
            key, owner = key[whole], ids[np.repeat(np.arange(len(ids)), sizes)[whole]]
            order = np.lexsort((owner, key))
            key, owner = key[order], owner[order]
            again = np.zeros(len(key), dtype=bool)
            again[1:] = (key[1:] == key[:-1]) & (owner[1:] == owner[:-1])
            key, owner = key[~again], owner[~again]
            block = owner // BLOCK
            first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])])) if len(key) else np.zeros(0, np.int64)
            low = np.uint64((1 << 21) - 1)
            spelt = np.stack([key[first] >> np.uint64(42), key[first] >> np.uint64(21) & low, key[first] & low], axis=1).astype("<u4")
            text = spelt.tobytes().decode("utf-32-le")
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), pa.array((owner - block * BLOCK).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array([text[k : k + GRAM] for k in range(0, len(text), GRAM)], pa.string()), pa.array(block[first]), lists], names=["gram", "block", "ids"])


def grams_of_term(term: str) -> list[str]:
    """The grams that whatever matches the term has."""
    folded = term.translate(str.maketrans(UPPER, LOWER))
    found = dict.fromkeys(s[k : k + GRAM] for s in re.split("[%_]", folded) for k in range(len(s) - GRAM + 1))
    every = list(found)
    return every if len(every) <= MOST_GRAMS else [every[k * (len(every) - 1) // (MOST_GRAMS - 1)] for k in range(MOST_GRAMS)]


class TextIndex:
    """Postings of some columns of a table in a folder."""

    def __init__(self, spark: SparkSession, folder: str, columns: tuple[str, ...] = TEXT_COLUMNS, group_bytes: int = 1 << 20):
        self.spark, self.folder, self.columns, self.group_bytes = spark, folder, columns, group_bytes

    def add(self, rows: DataFrame) -> None:
        """Take in rows (id and the columns)."""
        text = F.concat_ws(BETWEEN, *[fold(F.col(c)) for c in self.columns if c in rows.columns])
        each = rows.filter("id is not null").select(F.col("id").cast("long"), text.alias("text")).mapInArrow(_postings, "gram string, block long, ids array<int>")
        # a posting has as many ids as a block at most
        postings = each.groupBy("gram", "block").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
        postings.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block").write.mode("append").option("parquet.block.size", self.group_bytes).parquet(self.folder)

    def postings(self, grams: list[str]) -> DataFrame:
        return self.spark.read.schema("gram string, block long, ids array<int>").parquet(self.folder).filter(F.col("gram").isin(*grams))

    def candidates(self, term: str) -> DataFrame | None:
        """block and id of what has all grams of a term; None if it has no grams."""
        grams = grams_of_term(term)
        if not grams:
            return None
        by_block = self.postings(grams).groupBy("block").agg(F.collect_list(F.struct("gram", "ids")).alias("p"))
        of = lambda g: F.flatten(F.transform(F.filter("p", lambda x: x["gram"] == g), lambda x: x["ids"]))
        ids = F.array_distinct(reduce(F.array_intersect, [of(g) for g in grams]))
        return by_block.select("block", F.explode(ids).alias("at")).select("block", (F.col("block") * BLOCK + F.col("at")).alias("id"))

    def search(self, media: DataFrame, term: str) -> DataFrame:
        """The rows of `media` in whose columns the term stands."""
        test = reduce(lambda a, b: a | b, [contains_like(F.col(c), term) for c in self.columns if c in media.columns])
        found = self.candidates(term)
        if found is None:
            return media.filter(test)
        blocks = [r["block"] for r in found.select("block").distinct().limit(FEW_BLOCKS + 1).collect()]
        if len(blocks) <= FEW_BLOCKS:
            # a table in the order of ids is read where they are
            spans = [F.col("id").between(b * BLOCK, (b + 1) * BLOCK - 1) for b in sorted(blocks)]
            media = media.filter(reduce(lambda a, b: a | b, spans)) if spans else media.limit(0)
        return media.join(found.select("id"), "id", "left_semi").filter(test)
