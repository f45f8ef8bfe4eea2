"""Search by trigrams against scans."""

import random

import pytest
from pyspark.sql import functions as F

from prismlake.functions.text import contains_like
from prismlake.operators import text_index
from prismlake.operators.text_index import TextIndex, grams_of_term

NAMES = "id long, file_name string, directory string, camera_make string"


def some_rows(n):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abAB12_é") for _ in range(rng.randint(0, 9)))
    return [(i * 977, word() or None, f"/{word()}/{word()}", rng.choice([None, "Sony", "Canon"])) for i in range(n)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    out = TextIndex(spark, str(tmp_path_factory.mktemp("grams") / "g"), group_bytes=1 << 16)
    rows = spark.createDataFrame(some_rows(3000), NAMES)
    out.add(rows.filter("id % 2 = 0"))
    out.add(rows.filter("id % 2 = 1"))
    return out


@pytest.mark.parametrize("term", ["aba", "AB1", "son", "SONY", "ab", "a", "%", "a_b", "ab%b12", "b1_a", "ééé", "/a", "ny/", "zzz", "abab12ab1", "a/b", "b12%%ab_"])
def test_equal_to_a_scan(spark, index, term):
    rows = spark.createDataFrame(some_rows(3000), NAMES)
    want = {r["id"] for r in rows.filter(contains_like(F.col("file_name"), term) | contains_like(F.col("directory"), term) | contains_like(F.col("camera_make"), term)).collect()}
    assert {r["id"] for r in index.search(rows, term).collect()} == want


def test_few_rows_are_looked_at(spark, index):
    rows = spark.createDataFrame(some_rows(3000), NAMES)
    for term in ("ab12", "aab1", "b12a"):
        matches = index.search(rows, term).count()
        assert matches <= index.candidates(term).count() <= max(3 * matches, 10) < 300
    assert index.candidates("ab") is None and index.candidates("zzz").count() == 0


def test_removed_and_changed_rows(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "g"))
    index.add(spark.createDataFrame([(1, "holiday.jpg", "/a", None), (2, "work.jpg", "/a", None), (70_000, "holidays.png", "/b", None)], NAMES))
    now = spark.createDataFrame([(1, "renamed.jpg", "/a", None), (70_000, "holidays.png", "/b", None), (3, "holiday3.jpg", "/a", None)], NAMES)
    assert [r["id"] for r in index.search(now, "holiday").collect()] == [70_000]
    index.add(now.filter("id <> 70000"))
    assert sorted(r["id"] for r in index.search(now, "holiday").collect()) == [3, 70_000]
    assert [r["id"] for r in index.search(now, "NAMED").collect()] == [1] and index.search(now.limit(0), "holiday").count() == 0


def test_a_search_reads_its_own_grams(spark, tmp_path):
    """What reaches the scans: the grams, and the ids of few blocks."""
    index = TextIndex(spark, str(tmp_path / "g"))
    spark.range(0, 10_000_000, 500).select("id", F.concat(F.lit("IMG_"), "id", F.lit(".jpg")).alias("file_name"), F.lit("/lib").alias("directory"), F.lit(None).cast("string").alias("camera_make")).write.parquet(str(tmp_path / "m"))
    media = spark.read.parquet(str(tmp_path / "m"))
    index.add(media)
    found = index.search(media, "g_1234500")
    assert [r["id"] for r in found.collect()] == [1_234_500]
    spark.conf.set("spark.sql.maxMetadataStringLength", "20000")
    text = index.search(media, "g_1234500")._jdf.queryExecution().executedPlan().toString()
    assert "In(gram, [" in text and "GreaterThanOrEqual(id," in text


def test_grams_of_terms():
    assert grams_of_term("Ab_cde%FGHI") == ["cde", "fgh", "ghi"] and grams_of_term("ab") == [] == grams_of_term("a_b%c")
    assert len(grams_of_term("abcdefghijklmnopqrstuvwxyz")) == text_index.MOST_GRAMS and grams_of_term("aaaaaa") == ["aaa"]


def test_postings_against_plain_ones(spark, tmp_path):
    """A row that comes twice is in a posting once; characters of four bytes are one; grams end with a column; no gram holds NUL."""
    rows = [(5, "aaaa😀b", "/d", None), (5, "aaaa😀b", "/d", None), (70_000, "ab", None, "Son"), (3, None, "", None), (6, "x\x00yzzz", "AAA", "é"), (None, "abc", "/d", None)]
    index = TextIndex(spark, str(tmp_path / "g"))
    index.add(spark.createDataFrame(rows, NAMES))
    want = {}
    for i, *texts in rows:
        for t in (t.lower() for t in texts if i is not None and t):
            for g in {t[k : k + 3] for k in range(len(t) - 2)}:
                if "\x00" not in g:
                    want.setdefault((g, i // text_index.BLOCK), set()).add(i % text_index.BLOCK)
    got = spark.read.parquet(str(tmp_path / "g")).collect()
    assert {(r["gram"], r["block"]): r["ids"] for r in got} == {k: sorted(v) for k, v in want.items()} and len(got) == len(want)
