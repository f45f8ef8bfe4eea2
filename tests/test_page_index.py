"""Pages by order statistics against one order of all."""

import random
import re
from pathlib import Path

import pytest

from prismlake.operators import search
from prismlake.operators.page_index import PageIndex

COLUMNS = "id long, file_name string, file_size long, rating int, captured_at long, file_modified_at long"


def some_rows(n):
    """Few values, so that most rows tie; some nulls."""
    rng = random.Random(3)
    return [(i, rng.choice(["a", "B", "b", "ä", None]), rng.randrange(5), rng.choice([None, 1, 2]), rng.choice([None, 10, 20]), rng.randrange(30)) for i in range(n)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(some_rows(2000), COLUMNS)


@pytest.mark.parametrize("sort_by, descending", [("date", True), ("name", False), ("rating", True), ("size", False)])
def test_equal_to_one_order(spark, rows, tmp_path, sort_by, descending):
    index = PageIndex(spark, str(tmp_path), sort_by, descending)
    index.write(rows, 150)
    want = [r["id"] for r in rows.orderBy(*search.order_of(sort_by, descending)).collect()]
    assert sum(n for *_, n in index.counts()) == 2000 and len(index.counts()) > 5
    edge = index.counts()[2][1]
    for offset, limit in ((0, 10), (edge - 3, 6), (edge, 1), (777, 400), (1995, 50), (2000, 5), (10**6, 5), (0, 5000)):
        assert [r["id"] for r in index.page(offset, limit).collect()] == want[offset : offset + limit]
    some = rows.filter("id % 101 = 3 or id = -5")
    assert {r["id"]: r["place"] for r in index.places(some).collect()} == {i: k for k, i in enumerate(want) if i % 101 == 3}


def test_a_page_reads_its_partition(spark, rows, tmp_path):
    index = PageIndex(spark, str(tmp_path))
    index.write(rows, 100)
    every = {p.name for p in (Path(tmp_path) / "rows").iterdir() if p.name.startswith("_part=")}
    text = index.page(1205, 20)._jdf.queryExecution().executedPlan().toString()
    assert len(every) >= 15 and re.search(r"PartitionFilters: \[[^\]]*_part", text)
    held = [p for p, before, n in index.counts() if before < 1225 and before + n > 1205]
    assert 1 <= len(held) <= 2


def test_no_rows(spark, rows, tmp_path):
    index = PageIndex(spark, str(tmp_path))
    index.write(rows.limit(0))
    assert index.page(0, 10).collect() == [] and index.places(rows).collect() == []


def test_pages_and_places_cost_no_more_for_many_partitions(spark, rows, tmp_path):
    """A page lists the folders that hold it, and where partitions begin is a table that rows meet by its number."""
    index = PageIndex(spark, str(tmp_path))
    index.write(rows, 100)
    held = {p for p, before, n in index.counts() if before < 1225 and before + n > 1205}
    assert {int(re.search(r"_part=(\d+)", f)[1]) for f in index.page(1205, 20).inputFiles()} == held
    plan = index.places(rows.filter("id % 101 = 3"))._jdf.queryExecution().optimizedPlan().toString()
    assert "try_element_at" not in plan and "element_at" not in plan and "_before" in plan
