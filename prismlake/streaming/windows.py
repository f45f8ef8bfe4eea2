"""Event-time operators: bursts that settle, and how many events a window lets through.

`sessions` and `rate_limited` work on tables; `live_sessions` and `live_rate_limited` are the same on a stream.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def timed(events: DataFrame, column: str = "ts") -> DataFrame:
    """With `ms`, the milliseconds since 1970 of a timestamp in UTC."""
    return events.withColumn("ms", F.unix_millis(F.col(column).cast("timestamp")))


def sessions(events: DataFrame, key: str, gap_ms: int, slice_ms: int = 86_400_000) -> DataFrame:
    """key, first_ms, last_ms, events: runs of a key's events (ms) of which each comes less than a gap after the one before.

    A key's events are put in order a slice of time at a time, so that a busy key is no single task's work; of each slice
    only the first and the last run can go on in another one, and only those meet.
    """

    def runs(df: DataFrame, by: list[str], first: str, last: str, n: Column) -> DataFrame:
        ordered = Window.partitionBy(*by).orderBy(first, last)
        fresh = F.when(F.col(first) - F.lag(last).over(ordered) < gap_ms, 0).otherwise(1)
        numbered = df.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(ordered))
        return numbered.groupBy(*by, "_run").agg(F.min(first).alias("first_ms"), F.max(last).alias("last_ms"), n.alias("events"))

    sliced = events.select(key, "ms", F.floor(F.col("ms") / max(slice_ms, gap_ms)).alias("_slice"))
    inside = runs(sliced, [key, "_slice"], "ms", "ms", F.count(F.lit(1)))
    whole = Window.partitionBy(key, "_slice")
    inside = inside.withColumn("_edge", (F.col("_run") == 1) | (F.col("_run") == F.max("_run").over(whole)))
    across = runs(inside.filter("_edge"), [key], "first_ms", "last_ms", F.sum("events"))
    names = [key, "first_ms", "last_ms", "events"]
    return inside.filter("not _edge").select(*names).unionByName(across.select(*names))


def live_sessions(events: DataFrame, key: str, gap: str, late: str, ts: str = "ts") -> DataFrame:
    """The same on a stream: a session is told once the watermark has passed it; what comes later than `late` is dropped."""
    at = events.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    out = at.groupBy(F.session_window("_at", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("events"))
    return out.select(key, F.col("w.start").alias("first"), F.col("w.end").alias("settled"), "events")


def _last_starts(ms: np.ndarray, window_ms: int) -> np.ndarray:
    """For each event of a slice (times in order), if a window began with it: the last window's first event in the slice."""
    after = np.searchsorted(ms, ms + window_ms, side="right")
    last = np.arange(len(ms))
    inside = after < len(ms)
    # hops of twice the length, until no window is left in the slice
    hop = np.where(inside, after, last)
    while not np.array_equal(further := hop[hop], hop):
        hop = further
    return hop


def _transition(pdf: pd.DataFrame, window_ms: int) -> pd.DataFrame:
    """What a slice makes of the window that is open as it begins: one row.

    If the open window ends (start + window_ms) before the slice's first, second, ... event, that event begins a window; from
    there windows follow from each other within the slice. Events of which the last window is the same are one entry: the
    greatest end of an open window that leads there, where the last window begins, and how many of its events are in the
    slice. Only events up to the first one later than window_ms after the slice's first can be entered at.
    """
    ms = np.sort(pdf["ms"].to_numpy())
    last = _last_starts(ms, window_ms)
    # an open window began before the slice, so it ends before this
    entries = int(np.searchsorted(ms, ms[0] + window_ms, side="right")) + 1
    lead = last[:entries]
    final = np.flatnonzero(np.concatenate([lead[1:] != lead[:-1], [True]]))
    starts = lead[final]
    return pd.DataFrame({"_key": [pdf["_key"].iloc[0]], "_slice": [pdf["_slice"].iloc[0]], "first": [ms[0]], "last": [ms[-1]], "size": [len(ms)], "enter_at": [ms[final]], "start": [ms[starts]], "held": [len(ms) - starts]})


def _composed(pdf: pd.DataFrame) -> pd.DataFrame:
    """The window that is open as each slice of a key begins: its end, and how many events it has had. `window` is a column of the key's."""
    pdf, window_ms = pdf.sort_values("_slice"), int(pdf["window"].iloc[0])
    end, n, ends, counts = None, 0, [], []
    for last, size, enter_at, start, held in zip(pdf["last"], pdf["size"], pdf["enter_at"], pdf["start"], pdf["held"], strict=True):
        ends.append(end)
        counts.append(n)
        if end is not None and last <= end:
            n += size
            continue
        # the first event later than the end is the one that is entered at
        k = 0 if end is None else int(np.searchsorted(enter_at, end, side="right"))
        end, n = int(start[k]) + window_ms, int(held[k])
    return pd.DataFrame({"_key": pdf["_key"], "_slice": pdf["_slice"], "_end": pd.array(ends, dtype="Int64"), "_had": counts})


def _decided(pdf: pd.DataFrame, order: str, window_ms: int, most: int) -> pd.DataFrame:
    """The events of a slice in order, with what its open window lets through, and the windows that begin in it."""
    pdf = pdf.sort_values(["ms", order], kind="stable")
    ms, end, had = pdf["ms"].to_numpy(), pdf["_end"].iloc[0], int(pdf["_had"].iloc[0])
    at = 0 if pd.isna(end) else int(np.searchsorted(ms, int(end), side="right"))
    rank = had + np.arange(len(ms))
    while at < len(ms):
        after = int(np.searchsorted(ms, ms[at] + window_ms, side="right"))
        rank[at:after] = np.arange(after - at)
        at = after
    return pdf.drop(columns=["_key", "_slice", "_end", "_had"]).assign(allowed=rank < most)


#: Events of a key that are looked at together.
EVENTS_A_SLICE = 100_000


def _sliced(events: DataFrame, key: str, slice_ms: int, slice_events: int) -> DataFrame:
    """With `_key` and `_slice`: neighbouring spans of slice_ms of a key's time, as many as make slice_events events."""
    keyed = events.withColumns({"_key": F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")), "_span": F.floor(F.col("ms") / max(slice_ms, 1))})
    counts = keyed.groupBy("_key", "_span").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_key").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))
    numbered = counts.select("_key", "_span", F.floor(F.coalesce(before, F.lit(0)) / slice_events).alias("_slice"))
    return keyed.join(numbered, ["_key", "_span"]).drop("_span")


def rate_limited(events: DataFrame, key: str, window_ms: int, most: int, slice_ms: int = 3_600_000, order: str = "event_id", slice_events: int = EVENTS_A_SLICE) -> DataFrame:
    """With `allowed`: the first `most` events (by ms, then `order`) of each of a key's windows. A window begins with the first event more than `window_ms` after the last window's start. A null key is a key.

    Windows follow from each other, but not event by event: of a slice of a key's time it can be said which window is open at
    its end for any that is open as it begins. So slices are looked at all at once, each as a transition of a few entries; a
    key's transitions are composed in order, a row for each slice; and all slices are decided at once. A task's work is a
    slice of a key or a key's row for each slice, never a key's events. A slice is as many spans of slice_ms as make
    slice_events events.
    """
    schema = T.StructType([*events.schema.fields, T.StructField("allowed", T.BooleanType())])
    keyed = _sliced(events, key, slice_ms, slice_events)
    by = ["_key", "_slice"]
    told = keyed.select(*by, "ms").groupBy(*by).applyInPandas(lambda pdf: _transition(pdf, window_ms), "_key string, _slice long, first long, last long, size long, enter_at array<long>, start array<long>, held array<long>")
    opened = told.withColumn("window", F.lit(window_ms).cast("long")).groupBy("_key").applyInPandas(_composed, "_key string, _slice long, _end long, _had long")
    return keyed.join(opened, by).groupBy(*by).applyInPandas(lambda pdf: _decided(pdf, order, window_ms, most), schema)


def live_rate_limited(events: DataFrame, key: str, window_ms: int, most: int, order: str = "event_id") -> DataFrame:
    """The same on a stream of events (ms) that come in order from batch to batch: a key's open window (its start, and how many events it has had) is the state that batches hand on, two numbers for each key there was."""
    schema = T.StructType([*events.schema.fields, T.StructField("allowed", T.BooleanType())])

    def run(_, parts, state):
        rows = pd.concat(list(parts))
        start, had = state.get if state.exists else (None, 0)
        rows = rows.assign(_key="", _slice=0, _end=None if start is None else start + window_ms, _had=had)
        ms = np.sort(rows["ms"].to_numpy())
        yield _decided(rows, order, window_ms, most).drop(columns="_by", errors="ignore")
        at = 0 if start is None else int(np.searchsorted(ms, start + window_ms, side="right"))
        if at == len(ms):
            state.update((start, had + len(ms)))
        else:
            last = int(_last_starts(ms, window_ms)[at])
            state.update((int(ms[last]), len(ms) - last))

    by = events.withColumn("_by", F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")))
    return by.groupBy("_by").applyInPandasWithState(run, schema, "start long, had long", "append", "NoTimeout")
