"""Every operator and stage on nulls, empty and very long texts, ties, repeats, empty tables and clashing columns."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from prismlake.llm import ann, bpe, heap_lloyd, langid, minhash_forest, mixing, pii, sharding, spotsigs, suffix_arrays, suffix_tree, unigram_counts, word_runs

from samples import EXTRA, ODD, odd_rows


def ranks():
    return bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


OPERATORS = {
    "language": lambda d: langid.identify(d, F.lit(True)),
    "shards": lambda d: sharding.shard(d, 5),
    "bpe": lambda d: bpe.digests(bpe.decode(bpe.encode(d, ranks(), public_tokenizers.PATTERN), ranks())),
    "spotsigs": spotsigs.compare_edits,
    "pii": lambda d: pii.digests(pii.extract(d)),
    "redact": pii.redact,
    "suffix tree": lambda d: suffix_tree.score(d, (2, 7)),
    "mixing": mixing.interleave,
    "minhash": minhash_forest.near_duplicates,
    "counts": lambda d: unigram_counts.count_tokens(d, unigram_counts.load(public_tokenizers.path("piece_bpe_32k.model"))),
    "suffix arrays": lambda d: suffix_arrays.find(d, d.select(F.lit(1).alias("item_id"), "text", "lang").limit(0)),
    "word runs": word_runs.digests,
    "collapsed": word_runs.collapse,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each(name, written):
    got = OPERATORS[name](written(odd_rows(), EXTRA)).collect()
    assert sorted((r["doc_id"] or 0) for r in got) == sorted((i or 0) for i, _ in ODD)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, written):
    assert OPERATORS[name](written([], EXTRA)).count() == 0


def test_spotsigs_near_duplicates_of_odd_texts(written):
    got = {r["doc_id"]: r["component_id"] for r in spotsigs.near_duplicates(written(odd_rows(), EXTRA)).collect()}
    assert got[4] == got[5] == 4 and got[1] == 1 and got[2] == 2 and got[11] == 11


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (8, [0.0, 1.0]), (9, [0.0, 1.0]), (100, [1.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("part", F.lit("x"))
    got = sorted(tuple(r)[:3] for r in ann.search(table, F.col("vec_id") % 100 == 0).collect())
    assert got == [(0, 1, 100), (0, 2, 8), (0, 3, 9), (100, 1, 0), (100, 2, 8), (100, 3, 9)]
    assert ann.search(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("k", range(5))
def test_stages(k, spark, written):
    name, stage = corpus_pipeline.STAGES[k]
    rows = [(i, t, "en" if i and i % 2 else None, None if i == 4 else "s", 1, "clash") for i, t in ODD]
    docs = written(rows, "doc_id long, text string, lang string, source string, n_chars long, found string")
    out = stage(spark, docs, "")
    if k < 4:
        assert out.columns == corpus_pipeline.COLUMNS
    assert out.count() == {0: len([t for _, t in ODD if t and re.search(r"[^\W\d_]", t)]), 1: len(ODD) - 2}.get(k, len(ODD))
    assert stage(spark, docs.limit(0) if k not in (4,) else written([], "doc_id long, text string, lang string, source string, n_chars long, found string", name="none"), "").count() == 0
