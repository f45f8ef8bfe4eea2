"""Rate limits by composed transitions against one event after another."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismlake.streaming import windows


def plain(events, window_ms, most):
    """events: (event_id, key, ms)."""
    state, out = {}, {}
    for i, k, t in sorted(events, key=lambda e: (e[2], e[0])):
        start, n = state.get(k, (None, 0))
        if start is None or t - start > window_ms:
            start, n = t, 0
        out[i] = n < most
        state[k] = (start, n + out[i])
    return out


def busy(rng, n, span):
    """A third of all events are one key's; times repeat; one key is null."""
    return [(i, rng.choice(["hot"] * 3 + ["a", "b", None, "", f"k{i % 40}"]), int(rng.choice([rng.uniform(-span, span), rng.gauss(0, span / 20)]))) for i in range(n)]


@pytest.mark.parametrize("window_ms, most, slice_ms, slice_events", [(60, 3, 100, 1), (60, 3, 7, 30), (5, 2, 1000, 1), (500, 10, 50, 1), (100_000, 5, 300, 10**6), (0, 1, 40, 30)])
def test_equal_to_one_after_another(spark, window_ms, most, slice_ms, slice_events):
    events = busy(random.Random(window_ms + slice_ms), 1200, 2000)
    df = spark.createDataFrame(events, "event_id long, k string, ms long").repartition(4).withColumn("extra", F.lit("x"))
    got = windows.rate_limited(df, "k", window_ms, most, slice_ms, slice_events=slice_events)
    assert got.columns == ["event_id", "k", "ms", "extra", "allowed"]
    assert {r["event_id"]: r["allowed"] for r in got.collect()} == plain(events, window_ms, most)


def test_no_events(spark):
    df = spark.createDataFrame([], "event_id long, k string, ms long")
    assert windows.rate_limited(df, "k", 60, 3).collect() == []


def test_last_windows_of_a_slice():
    ms = np.array([0, 1, 5, 5, 6, 11, 12, 30])
    # from 0: 0, 6, 12 (12 > 11), 30; from 1: 1, 11, 30
    assert windows._last_starts(ms, 5).tolist() == [7] * 8
    for k in range(7):
        at = k
        while (after := int(np.searchsorted(ms[:7], ms[at] + 5, side="right"))) < 7:
            at = after
        assert windows._last_starts(ms[:7], 5)[k] == at


def test_one_busy_key_is_many_tasks(spark):
    """A million events of one key: no task gets more than a slice of them."""
    n = 1_000_000
    events = spark.range(n).select(F.col("id").alias("event_id"), F.lit("one").alias("k"), (F.col("id") * 7).alias("ms"))
    got = windows.rate_limited(events, "k", 1000, 10, slice_ms=100_000).select("allowed", "ms", F.spark_partition_id().alias("task"))
    told = got.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.count_if("allowed").alias("allowed")).collect()
    # windows begin every 143 events (the first later than 1,000 ms)
    assert sum(r["n"] for r in told) == n and sum(r["allowed"] for r in told) == sum(min(10, n - s) for s in range(0, n, 143))
    assert len(told) > 1 and max(r["n"] for r in told) < 0.6 * n


def test_on_a_stream(spark, tmp_path):
    """Batches hand on the open window; the stream is stopped and goes on from its checkpoint."""
    events = sorted(busy(random.Random(8), 600, 3000), key=lambda e: (e[2], e[0]))
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "event_id long, k string, ms long"
    for part in range(3):
        spark.createDataFrame(events[200 * part : 200 * part + 200], schema).coalesce(1).write.parquet(f"{path}/{part}")
        stream = spark.readStream.schema(schema).parquet(f"{path}/*")
        query = windows.live_rate_limited(stream, "k", 100, 2).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out)
        assert query.awaitTermination(120)
    assert {r["event_id"]: r["allowed"] for r in spark.read.parquet(out).collect()} == plain(events, 100, 2)
