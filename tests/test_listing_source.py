"""The listing as a data source: a table, and a stream that goes on where it has stopped."""

import os

import pytest

from prismlake.sources import listing, listing_source


@pytest.fixture
def root(tmp_path):
    for k in range(30):
        folder = tmp_path / "m" / f"a{k % 3}" / f"b{k % 5}"
        folder.mkdir(parents=True, exist_ok=True)
        put(folder / f"{k}.jpg", k + 1, 1_000 + k)
    put(tmp_path / "m" / "_top.jpg", 5, 5_000)
    os.symlink(tmp_path / "m" / "a0", tmp_path / "m" / "link")
    return tmp_path / "m"


def put(path, size, second):
    path.write_bytes(b"x" * size)
    os.utime(path, (second, second))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_table(spark, root, monkeypatch):
    listing_source.register(spark)
    want = rows(listing.walk(spark, str(root)))
    df = spark.read.format("media_listing").load(str(root))
    assert rows(df) == want and len(want) == 31 and (str(root / "_top.jpg"), 5, 5_000_000) in want
    parts = listing_source.folders(str(root))
    assert len(parts) == 1 + 3 + 15 and {p.levels for p in parts} == {0}
    monkeypatch.setattr(listing_source, "FOLDERS", 2)  # tasks go down from the second level
    parts = listing_source.folders(str(root))
    assert len(parts) == 4 and sorted(tuple(r.values()) for p in parts for b in listing_source.listed(p) for r in b.to_pylist()) == want
    monkeypatch.setattr(listing_source, "ROWS_A_BATCH", 4)
    assert sorted(tuple(r.values()) for p in parts for b in listing_source.listed(p) for r in b.to_pylist()) == want


def test_no_folder(spark, tmp_path):
    listing_source.register(spark)
    with pytest.raises(Exception, match="NotADirectoryError"):
        spark.read.format("media_listing").load(str(tmp_path / "none")).count()


def test_a_stream_goes_on_from_its_offset(spark, root, tmp_path):
    listing_source.register(spark)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        stream = spark.readStream.format("media_listing").option("settle_ms", 0).option("begin_ms", 1_010_000).load(str(root))
        query = stream.writeStream.format("parquet").option("checkpointLocation", check).trigger(once=True).start(out)
        assert query.awaitTermination(120)
        return rows(spark.read.schema(listing_source.SCHEMA).parquet(out))

    first = run()
    assert len(first) == 21 and min(r[2] for r in first) == 1_010_000
    new = root / "a0" / "b0" / "new.jpg"
    new.write_bytes(b"new")
    (root / "a0" / "b0" / "0.jpg").write_bytes(b"changed")
    got = run()
    assert sorted(r[0].rsplit("/", 1)[1] for r in got if r not in first) == ["0.jpg", "new.jpg"] and len(got) == 23
    assert run() == got
