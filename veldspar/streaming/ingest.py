"""Structured Streaming into a collection: each micro-batch is one upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..collection import Collection


def ingest(stream: DataFrame, collection: Collection, checkpoint: str, **trigger) -> StreamingQuery:
    """Upsert a stream of (id, vector or text, metadata). An upsert of the same rows again
    changes nothing, so a batch that is repeated after a failure does no harm."""

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            collection.upsert(batch)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
