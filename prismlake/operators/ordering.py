"""Row numbers within keys of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def number(df: DataFrame, by: list[Column], slice_: Column, order: list[Column], name: str, descending: bool = False) -> DataFrame:
    """`df` with `name`: each row's number among those of its key, from 0.

    `slice_` is a coarse number that `order` never contradicts (it rises with it, or falls if `descending`). Rows are put in
    order within a slice of a key, so that no task orders a whole key; what the slices before hold is added from
    their counts. Null keys are a key.
    """
    keys = [f"_by{k}" for k in range(len(by))]
    rows = df.withColumns({k: c for k, c in zip(keys, by, strict=True)} | {"_slice": slice_})
    counts = rows.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("_slice") if descending else F.asc_nulls_first("_slice"))
    before = F.coalesce(F.sum("_n").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*[F.col(k).alias(f"_of{k}") for k in keys], F.col("_slice").alias("_of_slice"), before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(*order)) - 1
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of{k}")) for k in keys] + [F.col("_slice").eqNullSafe(F.col("_of_slice"))])
    return rows.withColumn("_k", inside).join(counts, same).select(*df.columns, (F.col("_before") + F.col("_k")).alias(name))
