"""Decontamination against plain searches."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from samples import EXTRA, odd_rows

from prismlake.llm import queries, suffix_arrays

LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(text, items, window=10):
    """n_words, hit words and items of a text."""
    w, hit, names = words(text), set(), set()
    for name, item in items:
        b = words(item)
        m = min(window, len(b))
        for j in range(len(b) - m + 1) if m else ():
            for i in range(len(w) - m + 1):
                if w[i : i + m] == b[j : j + m]:
                    hit.update(range(i, i + m))
                    names.add(name)
    return len(w), sorted(hit), sorted(str(n) for n in names if n is not None)


def spread(spans):
    return [k for s in spans for k in range(s["start"], s["start"] + s["length"])]


class Held:
    """A block where no Spark is."""

    def __init__(self, value):
        self.value = value

    def unpersist_value(self):
        pass


def blocks(items, of=1000):
    told = [(None if i is None else str(i), suffix_arrays.word_hashes(pa.array([t]))[0]) for i, t in items]
    told = [x for x in told if len(x[1])]
    depth = max((len(h) for _, h in told), default=0)
    return [Held(suffix_arrays.Block.of(told[a : a + of], 10, depth)) for a in range(0, len(told), of)]


def sentence(rng, n, of=3):
    return rng.choice([" ", ", ", " - "]).join(rng.choice(["Ab", "b", "é9", "c", "dd"][:of]) for _ in range(n))


@pytest.mark.parametrize("shard_words, items_a_block", [(2_000_000, 1000), (40, 3), (1, 1)])
def test_equal_to_plain_search(monkeypatch, shard_words, items_a_block):
    """Few words, so that windows repeat, suffixes tie and items share windows; shards and blocks of any size."""
    monkeypatch.setattr(suffix_arrays, "SHARD_WORDS", shard_words)
    rng = random.Random(3)
    for _ in range(6):
        docs = [None, "", "...", *(sentence(rng, rng.choice([1, 4, 9, 10, 11, 30, 120]), rng.choice([1, 2, 5])) for _ in range(12))]
        docs += docs[-2:]
        items = [(k % 7 if k % 5 else None, sentence(rng, rng.choice([0, 1, 3, 9, 10, 12, 25]), rng.choice([1, 2, 5]))) for k in range(14)]
        batches = [pa.RecordBatch.from_arrays([pa.array(range(a, min(a + 5, len(docs)))), pa.array(docs[a : a + 5], pa.string())], names=["doc_id", "_text"]) for a in range(0, len(docs), 5)]
        got = [r for b in suffix_arrays._hits(blocks(items, items_a_block))(iter(batches)) for r in b.to_pylist()]
        assert [r["doc_id"] for r in got] == list(range(len(docs)))
        for r, text in zip(got, docs, strict=True):
            assert (r["n_words"], spread(r["spans"]), r["items"]) == plain(text, items) and r["n_hit"] == len(spread(r["spans"]))


def test_order_of_suffixes():
    """As far as asked, whatever the number of different words; suffixes of a repeated text tie for long."""
    rng = np.random.default_rng(1)
    for kinds in (1, 2, 5, 3000):
        some = rng.integers(1, kinds + 1, 300).astype(np.uint64)
        w = np.concatenate([some, [0], some, [0], some[:77], [0]]).astype(np.uint64)
        shard = suffix_arrays.Shard(w, 300)
        c = shard.codes.tolist()
        assert [c[p : p + 300] for p in shard.order] == sorted(c[p : p + 300] for p in range(len(c)))


def test_documents_and_long_matches(spark, written):
    passage = " ".join(f"w{k}" for k in range(70))
    docs = written([(1, f"Before it: {passage.upper()}! After."), (2, "Nothing of it."), (3, " ".join(passage.split()[20:29])), (4, " ".join(passage.split()[20:30])), (None, passage), (4, "short ITEM here"), (5, None)])
    bench = spark.createDataFrame([(7, f"a question {passage}"), (8, "short item"), (9, None), (10, "..."), (12, "unseen")], "item_id long, text string")
    got = suffix_arrays.find(docs, bench).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], *r["items"]) for r in got) == [(0, 70, 70, "7"), (1, 73, 70, "7"), (2, 3, 0), (3, 9, 0), (4, 3, 2, "8"), (4, 10, 10, "7"), (5, 0, 0)]
    kept = suffix_arrays.decontaminate(docs, bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 5] and kept.columns == docs.columns
    longest = {r["item_id"]: tuple(r)[1:] for r in suffix_arrays.longest_matches(docs, bench).collect()}
    assert longest["7"][:2] == (2, 70) and longest["7"][2:] in [(1, 2), (None, 0)] and longest["8"] == (0, 2, 4, 0) and set(longest) == {"7", "8"}


def test_whole_table(spark, duck, sf_dir):
    items = duck.execute("select item_id, text from benchmark").fetchall()
    texts = dict(duck.execute("select doc_id, text from documents").fetchall())
    got = {r["doc_id"]: r for r in queries.op11_suffix_arrays(spark, sf_dir).collect()}
    windows = {}
    for name, item in items:
        b = words(item)
        for j in range(len(b) - 9):
            windows.setdefault(tuple(b[j : j + 10]), set()).add(name)
    for d, text in texts.items():
        w = words(text)
        at = [i for i in range(len(w) - 9) if tuple(w[i : i + 10]) in windows]
        assert got[d]["n_hit"] == len({k for i in at for k in range(i, i + 10)})
        assert got[d]["n_items"] == len(set().union(*(windows[tuple(w[i : i + 10])] for i in at))) and got[d]["contaminated"] == bool(at)
    assert sum(r["contaminated"] for r in got.values()) > 0 and min(len(words(t)) for _, t in items) >= 10


def test_clashing_columns(spark, written):
    docs = written([(*r, 1, 2, 3) for r in odd_rows()], EXTRA + ", n_words long, n_hit long, items long")
    bench = spark.createDataFrame([(1, "again the same text of some words", "x")], "item_id long, text string, n_words string")
    kept = suffix_arrays.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 13]
    assert suffix_arrays.longest_matches(docs.limit(0), bench).count() == 0 == suffix_arrays.find(docs.limit(0), bench).count()
