"""A catalogue that takes changes by partition.

The catalogue's rows lie in partitions of neighbouring paths (a folder and what is below it are a range of paths), each
some files in the order of paths. A batch of file events is appended as a change file to the partitions of its paths and to
no other; nothing that is stored is read for that. A removed folder is a tombstone in every partition that its range meets.
Readers fold the changes of a partition into its rows, event by event; partitions without changes are read as they are. A
partition with COMPACT_AFTER change files is rewritten with them folded in, alone, and split if it has grown.

What counts is the manifest: a small table with a row for each partition (where it begins, the generation that holds its
rows, its change files). It is written last, under the batch's number, so that a batch that breaks off leaves no trace
and one that is delivered again finds its number and does nothing. Files of manifests before the last KEEP are deleted.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.ingest import TAKEN, ignored_path, supported

KEEP = 2
ROWS_A_PART, COMPACT_AFTER = 100_000, 8
#: Paths drawn for each partition to find where partitions begin.
DRAWS = 24
#: What an event has besides the catalogue's columns.
EVENT = ("kind", "seq")


def last_events(batch: DataFrame) -> DataFrame:
    """Of each path the last event (the largest seq)."""
    last = batch.groupBy("file_path").agg(F.max_by(F.struct(*batch.columns), "seq").alias("_event"))
    return last.select("_event.*")


def folders_of(path: Column) -> Column:
    """A path and all folders above it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def _after(state: Column, event: Column, schema: StructType) -> Column:
    """A path's row after one more event: null if it is gone. A file that is as it is stored changes nothing; else the row takes over what describes the file, and keeps the rest."""
    new = event["row"]
    same = state["file_hash"] == new["file_hash"]
    met = []
    for f in schema:
        value = new[f.name] if f.name in TAKEN else state[f.name]
        if f.name == "orientation":
            value = F.when(same, state[f.name]).otherwise(new[f.name])
        elif f.name == "thumbnail_status":
            value = F.when(~same | (state[f.name] == "failed"), "pending").otherwise(state[f.name])
        met.append(value.cast(f.dataType).alias(f.name))
    as_stored = (state["file_modified_at"] == new["file_modified_at"]) & (state["file_size"] == new["file_size"])
    return F.when(event["gone"], F.lit(None).cast(schema)).when(state.isNull(), new).when(as_stored, state).otherwise(F.struct(*met).cast(schema))


def folded(stored: DataFrame, events: DataFrame) -> DataFrame:
    """`stored` after `events` (version, kind, seq and its columns): batch by batch in the order of versions, within one by seq.

    Of a path only the last event of a batch counts. A removed path goes with everything below it that an earlier event or
    the catalogue has; a file that is ignored, not supported or empty changes nothing. A path has at most an event for
    each batch and for each removal of it or a folder above, which are put in order as one array.
    """
    schema = StructType([replace_nullable(f) for f in stored.schema])
    cols = stored.columns
    last = events.groupBy("version", "file_path").agg(F.max_by(F.struct("kind", "seq", *cols), "seq").alias("e")).select("version", "e.*")
    usable = supported(F.col("file_name")) & ~ignored_path(F.col("file_path")) & (F.col("file_size") > 0)
    puts = last.filter((F.col("kind") == "upsert") & usable)
    entry = lambda gone, row: F.struct("version", "seq", F.lit(gone).alias("gone"), row.cast(schema).alias("row")).alias("event")
    each = puts.select("file_path", entry(False, F.struct(*cols)))
    removed = last.filter("kind = 'remove'").select(F.col("file_path").alias("root"), "version", "seq")
    known = stored.select("file_path").unionByName(puts.select("file_path").distinct())
    # folders, not files, are looked up by all that is above them: the topmost are above every file
    folder = F.regexp_extract("file_path", "(?s)^(.*)/", 1)
    known = known.select("file_path", F.when(F.contains("file_path", F.lit("/")), folder).alias("folder"))
    above = known.filter("folder is not null").select("folder").distinct().select("folder", F.explode(folders_of(F.col("folder"))).alias("root"))
    below = known.join(above.join(removed, "root").select("folder", "version", "seq"), "folder").select("file_path", "version", "seq")
    own = known.join(removed, F.col("file_path") == F.col("root")).select("file_path", "version", "seq")
    each = each.unionByName(own.unionByName(below).distinct().select("file_path", entry(True, F.lit(None))))
    by_path = each.groupBy("file_path").agg(F.array_sort(F.collect_list("event")).alias("_events"))
    after = lambda first: F.aggregate("_events", first, lambda s, e: _after(s, e, schema))
    row = F.when(F.col("_stored"), F.struct(*cols).cast(schema))
    met = stored.withColumn("_stored", F.lit(True)).join(by_path, "file_path", "full_outer")
    return met.select(F.when(F.col("_events").isNull(), row).otherwise(after(row)).alias("_row")).filter("_row is not null").select("_row.*")


def replace_nullable(f):
    """A field that may be null."""
    return type(f)(f.name, f.dataType, True)


@dataclass(frozen=True)
class Part:
    """A partition: its number, the least path that may be in it, the generation of its rows (None: it has none), and its change files."""

    part: int
    low: str
    gen: str | None = None
    changes: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Manifest:
    name: str
    schema: StructType
    parts: list[Part]

    def number(self, path: Column) -> Column:
        """Which of the partitions, in order, a path is in: those that begin at or before it, by bisection."""
        lows = [p.low for p in self.parts]
        n = len(lows)
        values = F.from_json(F.lit(json.dumps(lows)), "array<string>")
        steps = F.array(*[F.lit(1 << b) for b in reversed(range(n.bit_length()))])
        hit = lambda at, s: (at + s < n) & (F.coalesce(F.get(values, at + s), F.lit("")) <= path)
        return F.aggregate(steps, F.lit(0), lambda at, s: F.when(hit(at, s), at + s).otherwise(at))

    def of(self, at: Column) -> Column:
        return F.get(F.from_json(F.lit(json.dumps([p.part for p in self.parts])), "array<int>"), at)

    def meets(self, root: str) -> list[Part]:
        """The partitions that may hold a folder's rows."""
        lows = [p.low for p in self.parts]
        at = lambda path: max(0, bisect_right(lows, path) - 1)
        return [p for k, p in enumerate(self.parts) if k == at(root) or at(root + "/") <= k <= at(root + "0")]


class Catalogue:
    """Partitions, changes and manifests in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, rows_a_part: int = ROWS_A_PART):
        self.spark, self.folder, self.rows_a_part = spark, folder, rows_a_part

    # files

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _names(self, folder: str) -> list[str]:
        fs, root = self._fs(), self._path(folder)
        return [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []

    def _manifests(self) -> list[tuple[int, int]]:
        """(batch, 1 for the one after rewriting partitions) of the manifests that were written to their end."""
        fs = self._fs()
        done = [n for n in self._names("manifests") if fs.exists(self._path(f"manifests/{n}/_SUCCESS"))]
        return sorted(tuple(map(int, n[1:].split("."))) for n in done)

    def versions(self) -> list[int]:
        """The batches whose catalogue is there."""
        return sorted({n for n, _ in self._manifests()})

    def manifest(self, name: str | None = None) -> Manifest | None:
        """A manifest, by default the last."""
        if name is None:
            found = self._manifests()
            if not found:
                return None
            name = "v{}.{}".format(*found[-1])
        rows = self.spark.read.parquet(f"{self.folder}/manifests/{name}").orderBy("low").collect()
        return Manifest(name, StructType.fromJson(json.loads(next(r["schema"] for r in rows if r["schema"]))), [Part(r["part"], r["low"], r["gen"], list(r["changes"])) for r in rows])

    def _commit(self, m: Manifest) -> None:
        # the columns stand in the first row
        rows = [(p.part, p.low, p.gen, p.changes, m.schema.json() if k == 0 else None) for k, p in enumerate(m.parts)]
        table = self.spark.createDataFrame(rows, "part int, low string, gen string, changes array<string>, schema string")
        table.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifests/{m.name}")
        self._tidy()

    def _tidy(self) -> None:
        """Delete what no manifest of the last KEEP batches names."""
        fs, found = self._fs(), self._manifests()
        kept = self.versions()[-KEEP:]
        held = [self.manifest("v{}.{}".format(*m)) for m in found if m[0] in kept]
        gens = {f"{p.gen}/part={p.part}" for m in held for p in m.parts if p.gen}
        changes = {c for m in held for p in m.parts for c in p.changes}
        for m in found:
            if m[0] not in kept:
                fs.delete(self._path("manifests/v{}.{}".format(*m)), True)
        for g in self._names("rows"):
            parts = [x for x in self._names(f"rows/{g}") if x.startswith("part=")]
            gone = [x for x in parts if f"{g}/{x}" not in gens]
            for x in [""] if len(gone) == len(parts) else gone:
                fs.delete(self._path(f"rows/{g}/{x}".rstrip("/")), True)
        for c in self._names("changes"):
            if c not in changes:
                fs.delete(self._path(f"changes/{c}"), True)

    # rows

    def _stored(self, m: Manifest, parts: list[Part]) -> DataFrame:
        paths = [f"{self.folder}/rows/{p.gen}/part={p.part}" for p in parts if p.gen]
        return self.spark.read.schema(m.schema).parquet(*paths) if paths else self.spark.createDataFrame([], m.schema)

    def _events(self, m: Manifest, parts: list[Part]) -> DataFrame | None:
        """The events of some partitions; a tombstone that several have comes once."""
        names = sorted({c for p in parts for c in p.changes})
        schema = StructType.fromJson(m.schema.jsonValue()).add("version", "long").add("kind", "string").add("seq", "long")
        paths = [f"{self.folder}/changes/{c}/part={p.part}" for p in parts for c in p.changes]
        return self.spark.read.schema(schema).parquet(*paths).distinct() if names else None

    def read(self, root: str | None = None) -> DataFrame | None:
        """The catalogue, or a folder of it with what is below, of which other partitions are not read. None before the first batch."""
        m = self.manifest()
        if m is None:
            return None
        parts = m.parts if root is None else m.meets(root)
        calm, changed = [p for p in parts if not p.changes], [p for p in parts if p.changes]
        found = []
        if calm or not changed:
            found.append(self._stored(m, calm))
        if changed:
            found.append(folded(self._stored(m, changed), self._events(m, changed)))
        out = reduce(DataFrame.unionByName, found)
        return out if root is None else out.filter((F.col("file_path") == root) | F.col("file_path").startswith(root.rstrip("/") + "/"))

    def _lows(self, rows: DataFrame, n: int, parts: int) -> list[str]:
        """Where partitions of about equal numbers of rows begin, from paths drawn by their hash."""
        if parts < 2:
            return []
        unit = F.shiftrightunsigned(F.xxhash64("file_path"), 11).cast("double") / float(1 << 53)
        drawn = sorted(r["file_path"] for r in rows.filter(unit < min(1.0, parts * DRAWS / n)).select("file_path").collect())
        return sorted({drawn[len(drawn) * k // parts] for k in range(1, parts)}) if drawn else []

    def _write(self, rows: DataFrame, m: Manifest, gen: str) -> None:
        placed = rows.select(*m.schema.names).withColumn("part", m.of(m.number(F.col("file_path"))))
        placed.repartition("part").sortWithinPartitions("part", "file_path").write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/rows/{gen}")

    def write(self, df: DataFrame, version: int) -> None:
        """Begin anew with the rows of `df`."""
        n = df.count()
        lows = ["", *self._lows(df, n, n // self.rows_a_part)]
        m = Manifest(f"v{version}.0", df.schema, [Part(k, low) for k, low in enumerate(lows)])
        gen = f"g{version}.0"
        self._write(df, m, gen)
        there = set(self._names(f"rows/{gen}"))
        self._commit(replace(m, parts=[replace(p, gen=gen if f"part={p.part}" in there else None) for p in m.parts]))

    def apply(self, batch: DataFrame, version: int) -> None:
        """Append a batch of events (kind, seq and the catalogue's columns) as change files; a version that is there changes nothing."""
        have = self.versions()
        if have and have[-1] >= version:
            return
        m = self.manifest() or Manifest("", batch.drop(*EVENT).schema, [Part(0, "")])
        events = last_events(batch.select(*EVENT, *m.schema.names)).withColumn("version", F.lit(version).cast("long"))
        path = F.col("file_path")
        first, to = m.number(F.concat(path, F.lit("/"))), m.number(F.concat(path, F.lit("0")))
        at = F.when(F.col("kind") == "remove", F.array_union(F.array(m.number(path)), F.sequence(first, to))).otherwise(F.array(m.number(path)))
        placed = events.withColumn("_at", F.explode(at)).withColumn("part", m.of(F.col("_at"))).drop("_at")
        name = f"v{version}"
        placed.repartition("part").sortWithinPartitions("part", "file_path").write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/changes/{name}")
        touched = {int(x[5:]) for x in self._names(f"changes/{name}") if x.startswith("part=")}
        self._commit(Manifest(f"v{version}.0", m.schema, [replace(p, changes=[*p.changes, name]) if p.part in touched else p for p in m.parts]))

    def compact(self, after: int = COMPACT_AFTER) -> list[int]:
        """Rewrite the partitions with at least so many change files, and no others; those that have grown to twice their size are split. Their numbers."""
        m = self.manifest()
        full = [p for p in m.parts if len(p.changes) >= after] if m else []
        if not full:
            return []
        batch = int(m.name[1:].split(".")[0])
        # partitions are folded together: a task's work is a partition's rows
        rows = folded(self._stored(m, full), self._events(m, full))
        number = Manifest(m.name, m.schema, m.parts)
        counts = {r["part"]: r["n"] for r in rows.groupBy(number.of(number.number(F.col("file_path"))).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
        fresh, parts = max(p.part for p in m.parts) + 1, []
        for p in m.parts:
            parts.append(p if p not in full else Part(p.part, p.low, "new"))
            n = counts.get(p.part, 0)
            if p in full and n >= 2 * self.rows_a_part:
                own = rows.filter(number.of(number.number(F.col("file_path"))) == p.part)
                for low in self._lows(own, n, n // self.rows_a_part):
                    if low > p.low:
                        parts.append(Part(fresh, low, "new"))
                        fresh += 1
        gen = f"g{batch}.1"
        new = Manifest(f"v{batch}.1", m.schema, parts)
        self._write(rows, new, gen)
        there = set(self._names(f"rows/{gen}"))
        self._commit(replace(new, parts=[replace(p, gen=gen if f"part={p.part}" in there else None) if p.gen == "new" else p for p in parts]))
        return [p.part for p in full]
