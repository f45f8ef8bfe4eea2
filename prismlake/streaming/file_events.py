"""Live file events: a stream of changes applied to the catalogue, one micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalogue import Catalogue, folded

__all__ = ["Catalogue", "apply_batch", "follow"]


def apply_batch(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """The rows of `stored` after a batch of events: kind (upsert or remove), seq and the catalogue's columns."""
    return folded(stored, batch.withColumn("version", F.lit(0).cast("long")))


def follow(events: DataFrame, catalogue: Catalogue, checkpoint: str, trigger: dict | None = None):
    """Start a query that applies the stream `events` to the catalogue: version n + 1 holds batch n, and one that is there is not applied again."""

    def each(batch: DataFrame, batch_id: int) -> None:
        catalogue.apply(batch, batch_id + 1)
        catalogue.compact()

    writer = events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
