"""From raw documents to token ids, in five stages, each over everything that the one before kept.

Every stage takes a scan of files with the columns of documents, in any order and with any others (which go), and an empty
table gives an empty one. A stage's result is written before the next one begins, which deletes what the one before has left
in the shared folder.

| Stage | Null or empty text | Null id | Repeated rows | Very long texts |
| --- | --- | --- | --- | --- |
| language ID | rejected, as any text without a letter | judged as any | judged each | read whole |
| MinHash near-dedup | kept: it is near nothing | kept: a row without an id takes no part | one stays | compared whole |
| PII | kept as it is | kept | kept | read whole |
| mixing | kept | after all others of its source | follow each other | moved whole |
| byte-level BPE | no ids | kept, told by its position | encoded each | split and encoded whole |
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prismlake.llm import bpe, common, langid, minhash_forest, mixing, pii

#: Files of which a row each is broadcast, about 100 bytes a row.
FEW_FILES = 100_000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model is sure enough of; it learns from those that carry a label."""
    common.small_batches(spark)
    return langid.keep_known(docs.select(*COLUMNS), F.lit(True))


def first_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id. If several rows have it, the least of them stays, by text, then language, source and n_chars."""
    common.small_batches(spark)
    found = minhash_forest.near_duplicates(docs)
    kept = common.materialize(found.filter("doc_id is not null").groupBy("doc_id").agg(F.count_if("kept").alias("rows")), "kept")
    # most ids stay as they are; only the rows of the others, and of what the sieve can't tell from them, are shuffled
    other = kept.filter("rows != 1").select("doc_id")
    of_other = common.sieve(other, other.count())(F.col("doc_id"))
    there = docs.filter("doc_id is not null").select(*COLUMNS)
    rows = lambda which: there.filter(of_other).join(kept.filter(which).select("doc_id"), "doc_id", "left_semi")
    order = ["text", "lang", "source", "n_chars"]
    least = rows("rows > 1").groupBy("doc_id").agg(F.min(F.struct(*order)).alias("row"))
    out = [there.filter(~of_other), rows("rows = 1").select(*COLUMNS), docs.filter("doc_id is null").select(*COLUMNS)]
    if not kept.filter("rows > 1").isEmpty():
        out.append(least.select("doc_id", "row.*").select(*COLUMNS))
    return reduce(DataFrame.unionByName, out)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data replaced by its kind."""
    common.small_batches(spark)
    return pii.redact(docs.select(*COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, in the order that gives each source its tempered share at any point."""
    return mixing.in_order(mixing.interleave(docs.select(*COLUMNS)))


def placed(docs: DataFrame) -> DataFrame:
    """position, doc_id and text of every row of `docs`, a scan of files: the row's number, from 0, in the order in which the files were written."""
    name = F.col("_metadata.file_name").alias("name")
    # a row a file; numbers of tasks and of their files as numbers, since names are no longer in order beyond 99,999 tasks
    number = lambda pattern: F.regexp_extract("name", pattern, 1).try_cast("int")
    order = Window.orderBy(number(r"part-(\d+)"), number(r"-c(\d+)\."), "name").rowsBetween(Window.unboundedPreceding, -1)
    files = docs.groupBy(name).agg((F.max("_metadata.row_index") + 1).alias("rows"))
    starts = common.materialize(files.select("name", F.coalesce(F.sum("rows").over(order), F.lit(0)).alias("start")), "starts")
    few = starts.count() <= FEW_FILES
    rows = docs.select(name, F.col("_metadata.row_index").alias("row"), "doc_id", "text")
    rows = rows.join(F.broadcast(starts) if few else starts, "name").select((F.col("start") + F.col("row")).alias("position"), "doc_id", "text")
    # what follows needs a scan of files, which a join that shuffles is not
    return rows if few else common.materialize(rows, "placed")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, whether they decode to its text, and its position in the mix, which is the order of the files."""
    common.small_batches(spark)
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rows = placed(docs)
    # ids may be null or repeat, positions don't
    encoded = bpe.encode(rows.select(F.col("position").alias("doc_id"), "text"), ranks, public_tokenizers.PATTERN)
    decoded = bpe.decode(encoded, ranks).select(F.col("doc_id").alias("position"), "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))
    return decoded.join(rows.select("position", "doc_id"), "position").select("doc_id", "ids", "n_tokens", "decoded_sha256", "position")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: What stages have written besides their results.
_left: list[DataFrame] = []


def _tidy(stage: Stage) -> Stage:
    """Delete what the stage before has left: its result has been written."""

    @wraps(stage)
    def run_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.drop(*[f for f in _left if f is not docs])
        before = common.written()
        out = stage(spark, docs, sf_dir)
        _left[:] = [f for f in common.written() if not any(f is b for b in before)]
        return out

    return run_


STAGES: list[tuple[str, Stage]] = [
    ("language ID", _tidy(known_language)),
    ("MinHash near-dedup", _tidy(first_of_near_copies)),
    ("PII", _tidy(without_personal_data)),
    ("mixing", _tidy(mixed)),
    ("byte-level BPE", _tidy(tokens)),
]

#: The language model, the forest and the patterns are no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again; only the last one's table stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        given, docs = docs, common.materialize(stage(spark, docs, sf_dir), f"stage{k + 1}")
        common.drop(given)
    common.drop(*_left)
    _left.clear()
    return docs
