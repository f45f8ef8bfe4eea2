"""The most alike person against all products."""

import numpy as np
import pytest

from prismlake.operators import best_person, people


def frames(spark, faces, persons):
    f = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(faces)], "id long, embedding array<float>").repartition(3)
    p = spark.createDataFrame([(7 * i + 3, [float(x) for x in v]) for i, v in enumerate(persons)], "person_id long, centroid array<double>").repartition(2)
    return f, p


def plain(faces, persons):
    like = np.round(faces.astype(np.float32).astype(float) @ persons.T, 6)
    return [(7 * int(k) + 3, float(l[k])) for l in like for k in [l.argmax()]]


def unit(x):
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize("kind", ["clusters", "directions", "lengths", "copies"])
def test_equal_to_all_products(spark, monkeypatch, kind):
    monkeypatch.setattr(best_person, "PERSONS_A_BLOCK", 100)
    rng = np.random.default_rng(9)
    d, n, m = 24, 1500, 900
    centres = unit(rng.normal(size=(60, d)))
    if kind == "clusters":
        persons, faces = (unit(centres[rng.integers(0, 60, k)] + rng.normal(scale=0.02, size=(k, d))) for k in (m, n))
    elif kind == "directions":
        persons, faces = unit(rng.normal(size=(m, d))), unit(rng.normal(size=(n, d)))
    elif kind == "lengths":  # not of length one, and zero
        persons, faces = rng.normal(size=(m, d)) * rng.gamma(1, size=(m, 1)), rng.normal(size=(n, d)) * rng.gamma(1, size=(n, 1))
        persons[5] = faces[5] = 0
    else:  # a third of the persons and of the faces are one vector
        persons, faces = unit(rng.normal(size=(m, d))), unit(rng.normal(size=(n, d)))
        persons[::3], faces[::3] = persons[0], faces[0]
    f, p = frames(spark, faces, persons)
    got = {r["id"]: r for r in best_person.best_person(f, p).collect()}
    want = plain(faces, persons)
    assert len(got) == n and [got[i]["likeness"] for i in range(n)] == pytest.approx([w[1] for w in want], abs=1.1e-6)
    assert sum(got[i]["person_id"] == want[i][0] for i in range(n)) >= n - 2  # rounding at a tie
    compared = sum(r["compared"] for r in got.values()) / (n * m)
    if kind == "clusters":
        assert compared < 0.1
    assert compared <= 1.1


def test_blocks_of_a_cell(spark, monkeypatch):
    """Persons that all lie in one cell."""
    monkeypatch.setattr(best_person, "PERSONS_A_BLOCK", 16)
    persons = np.ones((200, 3))
    persons[:, 0] += np.arange(200) % 2
    f, p = frames(spark, np.array([[1.0, 0, 0], [-1, 0, 0]]), persons)
    got = {r["id"]: (r["person_id"], r["likeness"]) for r in best_person.best_person(f, p).collect()}
    assert got == {0: (10, 2.0), 1: (3, -1.0)}


@pytest.mark.parametrize("block", [1, 1024])
def test_defined_cases(spark, monkeypatch, block):
    monkeypatch.setattr(best_person, "PERSONS_A_BLOCK", block)
    nan = float("nan")
    f = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, []), (4, [1.0]), (5, [nan, 0.0]), (6, [None, 1.0]), (7, [0.0, 0.5])], "id long, embedding array<float>")
    p = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, None), (4, [1.0, nan]), (5, [1.0]), (6, [1.0, 0.0])], "person_id long, centroid array<double>")
    got = {r["id"]: (r["person_id"], r["likeness"]) for r in people.match(f, p).collect()}
    assert got == {1: (2, 1.0), 7: (None, 0.5)} | {k: (None, None) for k in (2, 3, 4, 5, 6)}
    assert people.match(f, p.limit(0)).collect() == [] and people.match(f.limit(0), p).collect() == []


def test_no_product_in_the_plan(spark, monkeypatch):
    monkeypatch.setattr(best_person, "PERSONS_A_BLOCK", 1)
    f, p = frames(spark, np.eye(4), np.eye(4))
    text = people.match(f, p)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_pivots_are_far_apart():
    x = np.array([[0.0], [1], [10], [11], [5]])
    assert best_person.far_apart(x, 3).tolist() == [[0.0], [11], [5]] and len(best_person.far_apart(np.ones((5, 2)), 4)) == 1


def test_few_persons_go_to_the_tasks(spark):
    rng = np.random.default_rng(1)
    persons, faces = rng.normal(size=(30, 5)), rng.normal(size=(200, 5))
    f, p = frames(spark, faces, persons)
    found = best_person.best_person(f, p)
    got = {r["id"]: (r["person_id"], r["compared"]) for r in found.collect()}
    assert [got[i][0] for i in range(200)] == [w[0] for w in plain(faces, persons)] and {c for _, c in got.values()} == {30}
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
