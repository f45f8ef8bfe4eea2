"""The catalogue by partitions: against a plain one, and what it reads and writes."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from prismlake.sources.tables import Library
from prismlake.streaming import catalogue, file_events
from prismlake.streaming.catalogue import Catalogue

COLUMNS = "id long, file_path string, directory string, file_name string, file_size long, file_modified_at long, file_hash string, orientation int, thumbnail_status string, rating int"


def row(path, k, **more):
    base = {"id": k, "file_path": path, "directory": path.rpartition("/")[0], "file_name": path.rpartition("/")[2], "file_size": 10 + k % 3, "file_modified_at": k % 2, "file_hash": f"h{k % 4}", "orientation": k % 8, "thumbnail_status": ("ready", "failed")[k % 2], "rating": k % 5}
    return base | more


def plain(state: dict, events: list[dict]) -> dict:
    """One batch, one event after another."""
    last = {}
    for e in events:
        if e["file_path"] not in last or last[e["file_path"]]["seq"] < e["seq"]:
            last[e["file_path"]] = e
    state = dict(state)
    for e in sorted(last.values(), key=lambda e: e["seq"]):
        path = e["file_path"]
        if e["kind"] == "remove":
            state = {p: r for p, r in state.items() if p != path and not p.startswith(path + "/")}
            continue
        if not e["file_name"].endswith(".jpg") or "/.git/" in path or e["file_size"] <= 0:
            continue
        new, old = {k: v for k, v in e.items() if k not in ("kind", "seq")}, state.get(path)
        if old is None:
            state[path] = new
        elif (old["file_size"], old["file_modified_at"]) != (new["file_size"], new["file_modified_at"]):
            same = old["file_hash"] == new["file_hash"]
            state[path] = old | {k: new[k] for k in ("file_size", "file_modified_at", "file_hash", "directory", "file_name")} | {"orientation": old["orientation"] if same else new["orientation"], "thumbnail_status": "pending" if not same or old["thumbnail_status"] == "failed" else old["thumbnail_status"]}
    return state


@pytest.fixture
def frame(spark):
    def make(rows, schema=COLUMNS):
        names = [c.split()[0] for c in schema.split(", ")]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)

    return make


EVENTS = "kind string, seq long, " + COLUMNS


def some_events(rng, first, n):
    out = []
    for k in range(n):
        folder = rng.choice(["/a", "/a/b", "/a/b/c", "/a.b", "/z", "/a/.git", "/ü"])
        path = f"{folder}/{rng.randrange(8)}.{'jpg' if rng.random() < 0.95 else 'txt'}"
        if rng.random() < 0.25:
            out.append(row(rng.choice([path, folder, "/a/b", "/nowhere"]), first + k, kind="remove", seq=first + k))
        else:
            out.append(row(path, first + k, kind="upsert", seq=first + k) | ({"file_size": 0} if rng.random() < 0.05 else {}))
    return out


def rows_of(df):
    return {r["file_path"]: r.asDict() for r in df.collect()}


def test_equal_to_a_plain_catalogue(frame, spark, tmp_path):
    """Batches of changes, folders that go and come back, partitions that are rewritten and split."""
    rng = random.Random(4)
    state = {r["file_path"]: r for r in (row(f"{d}/{k}.jpg", 100 + k) for d in ("/a", "/a/b", "/a.b", "/z") for k in range(8))}
    c = Catalogue(spark, str(tmp_path / "c"), rows_a_part=6)
    c.write(frame(state.values()), 0)
    assert len(c.manifest().parts) > 3 and rows_of(c.read()) == state
    rewritten = []
    for n in range(1, 6):
        events = some_events(rng, 1000 * n, rng.choice([1, 12, 25]))
        state = plain(state, events)
        c.apply(frame(events, EVENTS), n)
        c.apply(frame(events, EVENTS), n)  # delivered again
        assert rows_of(c.read()) == state
        rewritten += c.compact(3)
        assert rows_of(c.read()) == state and c.versions() == list(range(max(0, n - 1), n + 1))
    assert rewritten
    for root in ("/a/b", "/z", "/a/b/3.jpg", "/none"):
        assert rows_of(c.read(root)) == {p: r for p, r in state.items() if p == root or p.startswith(root + "/")}


def test_order_within_a_batch(frame):
    """A file that comes after its folder went is there; one that came before is not."""
    stored = frame([row("/a/1.jpg", 1), row("/a/sub/2.jpg", 2), row("/ab/3.jpg", 3)])
    events = [row("/a/4.jpg", 4, kind="upsert", seq=1), row("/a", 5, kind="remove", seq=2), row("/a/6.jpg", 6, kind="upsert", seq=3), row("/ab/3.jpg", 7, kind="remove", seq=4), row("/ab/3.jpg", 8, kind="upsert", seq=5)]
    got = rows_of(file_events.apply_batch(stored, frame(events, EVENTS)))
    assert set(got) == {"/a/6.jpg", "/ab/3.jpg"} and got["/ab/3.jpg"]["id"] == 3
    assert rows_of(file_events.apply_batch(stored, frame([], EVENTS))) == rows_of(stored)
    assert file_events.apply_batch(stored.limit(0), frame(events, EVENTS)).count() == 2


def size(folder: Path) -> int:
    return sum(p.stat().st_size for p in folder.rglob("*.parquet"))


def test_a_small_batch_touches_little(spark, tmp_path):
    """100 events on 200,000 rows: what is written, what a folder's reader reads, and what is rewritten."""
    n = "id"
    path = F.format_string("/lib/d%04d/IMG_%07d.jpg", (F.col(n) / 100).cast("int"), F.col(n))
    media = spark.range(200_000).select("id", path.alias("file_path"), F.format_string("/lib/d%04d", (F.col(n) / 100).cast("int")).alias("directory"), F.format_string("IMG_%07d.jpg", F.col(n)).alias("file_name"), (F.col(n) % 1000 + 1).alias("file_size"), F.col(n).alias("file_modified_at"), F.md5(F.col(n).cast("string")).alias("file_hash"), F.lit(1).alias("orientation"), F.lit("ready").alias("thumbnail_status"), F.lit(0).alias("rating"))
    c = Catalogue(spark, str(tmp_path / "c"), rows_a_part=2000)
    c.write(media, 0)
    whole = size(tmp_path / "c" / "rows")
    assert 60 <= len(c.manifest().parts) <= 140
    # the events of a folder that is imported, and one that goes
    batch = media.filter("id between 5000 and 5099").withColumn("file_size", F.lit(5)).withColumn("kind", F.lit("upsert")).withColumn("seq", F.col("id"))
    gone = media.filter("id = 7700").withColumn("file_path", F.lit("/lib/d0077")).withColumn("kind", F.lit("remove")).withColumn("seq", F.lit(1).cast("long"))
    c.apply(batch.unionByName(gone), 1)
    assert size(tmp_path / "c" / "changes") + size(tmp_path / "c" / "manifests") < 0.02 * whole and size(tmp_path / "c" / "rows") == whole
    changed = [p for p in c.manifest().parts if p.changes]
    assert len(changed) <= 4
    read = c.read("/lib/d0050")
    files = read.inputFiles()
    assert sum(Path(f.removeprefix("file:")).stat().st_size for f in files) < 0.05 * whole
    assert read.agg(F.sum("file_size")).first()[0] == 500 and read.count() == 100
    assert c.read().count() == 199_900 and c.read("/lib/d0077").count() == 0
    before = {p.part: p.gen for p in c.manifest().parts}
    rewritten = c.compact(1)
    assert sorted(rewritten) == sorted(p.part for p in changed) and c.read().count() == 199_900
    assert all(p.gen == before[p.part] for p in c.manifest().parts if p.part not in rewritten)
    assert size(tmp_path / "c" / "rows" / "g1.0") == 0 and size(tmp_path / "c" / "rows" / "g1.1") < 0.06 * whole


def test_a_batch_that_broke_off_leaves_no_trace(frame, spark, tmp_path):
    c = Catalogue(spark, str(tmp_path / "c"))
    c.write(frame([row("/a/1.jpg", 1)]), 0)
    # change files without a manifest
    frame([row("/a/2.jpg", 2, kind="upsert", seq=1)], EVENTS).withColumn("version", F.lit(1)).withColumn("part", F.lit(0)).write.partitionBy("part").parquet(str(tmp_path / "c" / "changes" / "v1"))
    assert set(rows_of(c.read())) == {"/a/1.jpg"}
    c.apply(frame([row("/a/3.jpg", 3, kind="upsert", seq=1)], EVENTS), 1)
    assert set(rows_of(c.read())) == {"/a/1.jpg", "/a/3.jpg"}


def test_partitions_without_changes_are_scanned_alone(spark, sf_dir, tmp_path):
    c = Catalogue(spark, str(tmp_path / "c"), rows_a_part=200)
    stored = Library(spark, sf_dir).stored
    c.write(stored, 0)
    assert c.read().count() == stored.count() and "Join" not in c.read()._jdf.queryExecution().executedPlan().toString()
    assert catalogue.KEEP == 2 and Catalogue(spark, str(tmp_path / "none")).read() is None and Catalogue(spark, str(tmp_path / "none")).compact() == []


def test_folders_and_not_files_are_looked_up_by_what_is_above_them(spark, frame):
    schema = "file_path string, directory string, file_name string, file_size long, file_hash string, file_modified_at long, orientation int, thumbnail_status string"
    row = lambda p: (p, p.rpartition("/")[0], p.rpartition("/")[2], 1, "h", 1, 1, "ready")
    paths = ["/a/b/1.jpg", "/a/b/2.jpg", "/a/b.jpg", "/a/bb/1.jpg", "c/1.jpg", "2.jpg", "/a/x\ny/3.jpg", "/d.jpg"]
    stored = spark.createDataFrame([row(p) for p in paths], schema)

    def after(*removed):
        events = spark.createDataFrame([(1, "remove", k, *row(p)) for k, p in enumerate(removed)], "version long, kind string, seq long, " + schema)
        return catalogue.folded(stored, events)

    left = lambda *removed: sorted({r["file_path"] for r in after(*removed).collect()} ^ set(paths))
    assert left("/a/b") == ["/a/b/1.jpg", "/a/b/2.jpg"] and left("2.jpg", "c") == ["2.jpg", "c/1.jpg"] and left("/a/x\ny", "/a/x\ny/3.jpg") == ["/a/x\ny/3.jpg"]
    assert left("") == sorted(p for p in paths if p.startswith("/")) and left("/d.jpg/e", "/e") == []
    plan = after("/a")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and all("Aggregate [folder" in below for below in plan.split("Generate explode")[1:])
