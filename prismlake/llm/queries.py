"""The registered queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, common, heap_lloyd, langid, minhash_forest, mixing, oracles, pii, sharding, spotsigs, suffix_arrays, suffix_tree, unigram_counts, word_runs


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    held = common.split_of(1, 3)
    found = langid.identify(docs, ~held)
    return found.select("doc_id", common.split_of(1, 3).alias("held_out"), "lang_pred", "score", "rejected")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(common.documents(spark, sf_dir), 24)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    tokens = bpe.encode(common.documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)
    return bpe.digests(bpe.decode(tokens, ranks))


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_edits(common.documents(spark, sf_dir))


def op5_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.search(table, F.col("vec_id") % 100 == 0)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.extract(common.documents(spark, sf_dir)))


def op7_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_tree.score(common.documents(spark, sf_dir), (2, 7))
    return found.select("doc_id", common.split_of(2, 7).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.interleave(common.documents(spark, sf_dir), keep=["doc_id", "source"])
    return mixed.select("doc_id", F.coalesce("source", F.lit(mixing.NO_SOURCE)).alias("source"), "mix.source_row", "mix.block", "mix.slot", "mix.place", "mix.position")


def op9_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.near_duplicates(common.documents(spark, sf_dir))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = unigram_counts.load(public_tokenizers.path("piece_bpe_32k.model"))
    return unigram_counts.count_tokens(common.documents(spark, sf_dir), vocabulary)


def op11_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_arrays.digests(suffix_arrays.find(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_runs.digests(common.documents(spark, sf_dir))


def op13_heap_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heap_lloyd.digests(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_sharding, op3_byte_bpe, op4_spotsigs, op5_learned_partitions, op6_pii, op7_suffix_tree, op8_mixing, op9_minhash_forest, op10_token_counts, op11_suffix_arrays, op12_word_runs, op13_heap_lloyd)}

ORACLE_SQL: dict[str, str] = {"op2_sharding": oracles.sharding(24), "op8_mixing": oracles.mixing(), "op9_minhash_forest": oracles.near_duplicates(), "op11_suffix_arrays": oracles.contamination(), "op12_word_runs": oracles.word_runs(), "op13_heap_lloyd": oracles.vector_codes()}
