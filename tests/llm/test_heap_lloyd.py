"""Codes of vectors against plain Lloyd rounds."""

import math

import numpy as np
import pytest

from prismlake.llm import heap_lloyd


def plain(rows, parts=8, entries=16, rounds=6):
    """Codes, errors and codebooks; whole numbers only. rows: (vec_id, vector), in order."""
    x = [[math.floor(4096 * v) for v in vector] for _, vector in rows]
    cuts = [(len(x[0]) * p // parts, len(x[0]) * (p + 1) // parts) for p in range(parts)]
    codes, errors, books = [], [0] * len(x), []
    for a, b in cuts:
        cut = [tuple(v[a:b]) for v in x]
        book = cut[:entries]
        for k in range(rounds + 1):
            away = [[sum((s - t) ** 2 for s, t in zip(v, e, strict=True)) for e in book] for v in cut]
            own = [d.index(min(d)) for d in away]
            if k < rounds:
                for e in range(len(book)):
                    mine = [v for v, o in zip(cut, own, strict=True) if o == e]
                    if mine:
                        book[e] = tuple(sum(c) // len(mine) for c in zip(*mine, strict=True))
        codes.append(own)
        errors = [s + min(d) for s, d in zip(errors, away, strict=True)]
        books += [c for e in book for c in e]
    return ["".join(f"{c:02x}" for c in code) for code in zip(*codes, strict=True)], errors, books


def rows_of(spark, vectors, labels=None):
    data = [(i, [float(x) for x in v], labels[k] if labels else 0) for k, (i, v) in enumerate(vectors)]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").repartition(3)


@pytest.mark.parametrize("kind", ["clusters", "directions", "ties", "copies"])
def test_equal_to_plain_rounds(spark, kind):
    rng = np.random.default_rng(5)
    n, d = 250, 16
    if kind == "clusters":
        x = rng.normal(size=(20, d))[rng.integers(0, 20, n)] + rng.normal(scale=0.05, size=(n, d))
    elif kind == "directions":
        x = rng.normal(size=(n, d))
        x /= np.linalg.norm(x, axis=1)[:, None]
    elif kind == "ties":  # a grid of few values: distances are often equal
        x = rng.integers(-2, 3, (n, d)).astype(float)
    else:
        x = rng.normal(size=(6, d))[np.minimum(rng.integers(0, 12, n), 5)]
    vectors = [(int(i), v) for i, v in zip(range(0, 3 * n, 3), x.astype(np.float32).astype(float), strict=True)]
    labels = [None if k % 5 == 0 else k % 3 for k in range(n)]
    table = rows_of(spark, vectors, labels)
    codes, errors, book = plain(vectors)
    found = heap_lloyd.compress(table)
    got = {r["vec_id"]: r for r in heap_lloyd.with_label_error(found).collect()}
    assert len(got) == n and [int(v) for cut in found.books.parts for row in found.books.entries[:, cut] for v in row] == book
    sums = {}
    for (i, _), c, e, label in zip(vectors, codes, errors, labels, strict=True):
        assert (got[i]["code"], got[i]["error"]) == (c, e)
        sums[label] = sums.get(label, 0) + e
    assert all(got[i]["label_error"] == sums[label] for (i, _), label in zip(vectors, labels, strict=True))
    if kind == "clusters":  # once entries have settled, few parts are looked at
        assert found.popped[0] == 8 * n and found.popped[-1] < 0.35 * 8 * n


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [0.5] * 8, 1, "x"), (3, None, 1, "x"), (4, [], 1, "x"), (6, [nan] + [0.0] * 7, 1, "x"), (7, [inf] + [0.0] * 7, 1, "x"), (8, [None] + [0.0] * 7, 1, "x"), (9, [1.0] * 7, 1, "x"), (10, [1e30] * 8, 1, "x"), (None, [1.0] * 8, None, "x"), (5, [0.25] * 8, None, "x"), (0, [0.0] * 8, 2, "x"), (11, [-0.00001] * 8, 2, "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, error string")
    got = sorted(((r["vec_id"] if r["vec_id"] is not None else 99), r["code"], r["error"], r["label_error"]) for r in heap_lloyd.digests(table).collect())
    # entries, by id and vector: 0, 0.25, 0.5, -1, 1; as many as there are rows
    assert got == [(0, "00" * 8, 0, 0), (5, "01" * 8, 0, 0), (5, "02" * 8, 0, 0), (11, "03" * 8, 0, 0), (99, "04" * 8, 0, 0)]
    assert heap_lloyd.digests(table.limit(0)).collect() == [] and heap_lloyd.digests(table.limit(0)).columns == heap_lloyd.digests(table).columns


def test_lengths_that_are_no_multiple(spark):
    rng = np.random.default_rng(2)
    for d in (3, 11):
        vectors = [(k, v) for k, v in enumerate(rng.normal(size=(40, d)).astype(np.float32).astype(float))]
        codes, errors, _ = plain(vectors)
        got = {r["vec_id"]: (r["code"], r["error"]) for r in heap_lloyd.digests(rows_of(spark, vectors)).collect()}
        assert [got[k] for k in range(40)] == list(zip(codes, errors, strict=True))


def test_heaps_pop_a_prefix_and_stay_in_order():
    rng = np.random.default_rng(3)
    h = heap_lloyd.Heaps.of(rng.integers(0, 1000, (500, 4)), rng.integers(0, 1000, (7, 4)), np.zeros(7))
    drift = np.array([0, 10, 100, 1000, 50, 0, 1e9])
    want = {k for k in range(500) if h.key[k] <= drift[h.entry[k]]}
    out = h.pop(drift)
    assert set(out.tolist()) == want and len(h.order) == 500 - len(want)
    h.push(out, rng.integers(0, 7, len(out)).astype(np.uint8), rng.random(len(out)) * 500)
    assert sorted(h.order.tolist()) == list(range(500))
    told = [(h.entry[k], h.key[k]) for k in h.order]
    assert told == sorted(told)
