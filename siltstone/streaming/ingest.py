"""Extension: feed an index on disk from a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from siltstone.operators.store import IndexStore


def ingest(stream: DataFrame, store: IndexStore, checkpoint: str, **trigger) -> StreamingQuery:
    """Add each micro-batch of (title, plot) as a segment. The manifest holds the number of the last batch by the name of the
    checkpoint, in the same commit as the segment, so a batch that comes again after a failure is not added again."""

    def add(batch: DataFrame, number: int) -> None:
        store.add(batch.select("title", "plot"), (checkpoint, number))

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
