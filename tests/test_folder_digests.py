"""Rescans by digests against a comparison of all files."""

import random

import pytest
from pyspark.sql import functions as F

from prismlake.operators import folder_digests, ingest

STORED = "id long, file_path string, directory string, library_id long, file_size long, file_modified_at long, thumbnail_status string"


def tree(rng, n):
    """Files in folders of up to five levels, some of which have no files of their own."""
    out = []
    for i in range(n):
        folder = "".join(f"/f{rng.randrange(4)}" for _ in range(rng.choice([1, 3, 3, 5])))
        out.append((i, f"{folder}/{i}.jpg", folder, 1 + i % 2, i % 7, i % 11, rng.choice(["ready"] * 5 + ["failed"])))
    return out


def frames(spark, stored, found):
    return spark.createDataFrame(stored, STORED), spark.createDataFrame([r[1:3] + r[4:6] for r in found], "file_path string, directory string, file_size long, file_modified_at long")


def changed_tree(rng, rows, share):
    out = []
    for r in rows:
        x = rng.random()
        if x < share / 3:
            continue
        out.append((*r[:5], r[5] + 1, r[6]) if x < 2 * share / 3 else r)
    return out + [(0, f"/f1/new{k}/{k}.jpg", f"/f1/new{k}", 1, 1, 1, "") for k in range(int(share * 10))]


@pytest.mark.parametrize("share", [0.0, 0.01, 0.3, 1.0])
def test_same_plan_as_of_all_files(spark, share):
    rng = random.Random(int(share * 100))
    rows = tree(rng, 900)
    stored, found = frames(spark, rows, changed_tree(rng, rows, share))
    library = F.lit(1).cast("long")
    want = sorted(map(tuple, ingest.reconcile(stored, found, library).collect()), key=repr)
    assert sorted(map(tuple, folder_digests.reconcile_changed(stored, found, library).collect()), key=repr) == want


def test_little_is_visited(spark):
    """A change in one of many folders: the way down to it, and what stands beside that."""
    rows = [(i, f"/lib/y{i // 1000}/m{i // 100 % 10}/d{i // 10 % 10}/{i}.jpg", f"/lib/y{i // 1000}/m{i // 100 % 10}/d{i // 10 % 10}", 1, 5, 5, "ready") for i in range(10_000)]
    stored, found = frames(spark, rows, [(*r[:5], 6, r[6]) if r[0] == 4567 else r for r in rows])
    old, new = folder_digests.tree_digests(stored), folder_digests.tree_digests(found)
    assert old.count() == 1 + 1 + 10 + 100 + 1000
    seen = {r["folder"]: r["changed"] for r in folder_digests.visited(old, new).collect()}
    assert {f for f, c in seen.items() if c} == {"/lib/y4/m5/d6"} and len(seen) == 1 + 1 + 10 + 10 + 10
    assert {r["folder"] for r in folder_digests.visited(old, old).collect()} == {""}
    acts = folder_digests.reconcile_changed(stored, found, F.lit(1).cast("long"), old, new).groupBy("action").count().collect()
    assert {r["action"]: r["count"] for r in acts} == {"keep": 9_999, "extract": 1}


def test_trees_that_begin_or_end(spark):
    rows = tree(random.Random(1), 60)
    stored, found = frames(spark, rows, rows)
    library = F.lit(1).cast("long")
    assert {r["action"] for r in folder_digests.reconcile_changed(stored.limit(0), found, library).collect()} == {"add"}
    assert {r["action"] for r in folder_digests.reconcile_changed(stored, found.limit(0), library).collect()} == {"remove"}
    assert folder_digests.reconcile_changed(stored.limit(0), found.limit(0), library).collect() == []
    digest = folder_digests.tree_digests(stored).filter("folder = ''").first()
    assert (digest["all_files"], digest["files"], digest["parent"], digest["depth"]) == (60, None, None, 0)
