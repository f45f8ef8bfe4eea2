"""Any page of an order without sorting what is before it.

The rows are stored in partitions by ranges of the order, with a small table of how many rows each partition has: the
order's statistics. An offset is then a partition and a rest: a page reads the one or two partitions that hold it and sorts
those. A row's place is what the partitions before its own hold and its place there. Ids end every order, so no two rows
are equal in it.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from .search import order_of

ROWS_A_PART = 100_000


class PageIndex:
    """Rows in an order, as `search.order_of` names it, in a folder."""

    def __init__(self, spark: SparkSession, folder: str, sort_by: str = "date", descending: bool = True):
        self.spark, self.folder, self.order = spark, folder, order_of(sort_by, descending)

    def write(self, rows: DataFrame, rows_a_part: int = ROWS_A_PART) -> None:
        """Store `rows`, about so many in a partition."""
        n = max(1, -(-rows.count() // rows_a_part))
        dealt = rows.repartitionByRange(n, *self.order).withColumn("_part", F.spark_partition_id())
        # small partitions that follow each other are one task's work
        dealt.coalesce(max(1, n * rows_a_part // ROWS_A_PART)).write.mode("overwrite").partitionBy("_part").parquet(f"{self.folder}/rows")
        schema = StructType([*rows.schema.fields, StructField("_part", IntegerType())])
        counts = self.spark.read.schema(schema).parquet(f"{self.folder}/rows").groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
        # a row without a partition tells the columns, whether there are rows or not
        columns = self.spark.createDataFrame([(None, 0, schema.json())], "_part int, n long, schema string")
        columns.unionByName(counts.withColumn("schema", F.lit(None).cast("string"))).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/counts")

    def _counts(self) -> DataFrame:
        return self.spark.read.schema("_part int, n long, schema string").parquet(f"{self.folder}/counts")

    def _schema(self) -> StructType:
        return StructType.fromJson(json.loads(self._counts().filter("_part is null").first()["schema"]))

    def rows(self) -> DataFrame:
        """All rows, with the partition of each (`_part`)."""
        return self.spark.read.schema(self._schema()).parquet(f"{self.folder}/rows")

    def counts(self) -> list[tuple[int, int, int]]:
        """Of each partition in order its number, the rows before it and its rows; as many as there are partitions."""
        before, out = 0, []
        for r in sorted(self._counts().filter("_part is not null").select("_part", "n").collect()):
            out.append((r["_part"], before, r["n"]))
            before += r["n"]
        return out

    def _read(self, parts: list[int]) -> DataFrame:
        if not parts:
            return self.rows().limit(0)
        # their folders alone are listed
        rows = self.spark.read.schema(self._schema()).option("basePath", f"{self.folder}/rows").parquet(*[f"{self.folder}/rows/_part={p}" for p in parts])
        return rows.filter(F.col("_part").isin(*parts))

    def page(self, offset: int, limit: int) -> DataFrame:
        """`limit` rows from place `offset` on, in order; fewer at the end."""
        held = [(p, before) for p, before, n in self.counts() if before < offset + limit and before + n > offset]
        rest = offset - held[0][1] if held else 0
        return self._read([p for p, _ in held]).drop("_part").orderBy(*self.order).offset(rest).limit(limit)

    def places(self, found: DataFrame) -> DataFrame:
        """id and `place` of those of the stored rows whose id `found` has: only their partitions are put in order, each by itself."""
        counts = self.counts()
        if not counts:
            return self.spark.createDataFrame([], "id long, place long")
        rows = self.rows()
        wanted = rows.join(found.select("id"), "id", "left_semi").select("_part").distinct()
        inside = F.row_number().over(Window.partitionBy("_part").orderBy(*self.order)) - 1
        # a row for each partition, which the rows meet by its number: looked up in one map, each would cost as much as there are partitions
        before = self.spark.createDataFrame([(p, b) for p, b, _ in counts], "_part int, _before long")
        placed = rows.join(wanted, "_part", "left_semi").withColumn("_inside", inside).join(F.broadcast(before), "_part").withColumn("place", F.col("_inside") + F.col("_before"))
        return placed.join(found.select("id"), "id", "left_semi").select("id", F.col("place").cast("long"))
