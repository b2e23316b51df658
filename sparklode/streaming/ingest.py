"""Streaming ingest: payload files become flush files, each micro-batch exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.compaction import compact
from ..operators.store import Store
from ..sources.schema import PUSH_SCHEMA


def payload_stream(store: Store, inbox: str, max_files: int = 1000) -> DataFrame:
    return store.spark.readStream.schema(PUSH_SCHEMA).option("maxFilesPerTrigger", max_files).json(inbox)


def ingest(store: Store, payloads: DataFrame, checkpoint: str, trigger: dict | None = None, compact_after: int | None = None) -> StreamingQuery:
    """Flush each micro-batch under its own number: a batch that is run again replaces its flush file and catalog row.

    Rows of any age are taken at any time; there is no watermark. With ``compact_after`` flush files are compacted once there are so many
    of batches before this one, which are committed and won't run again.
    """

    def write(batch: DataFrame, number: int) -> None:
        store.flush(batch, batch=number)
        if compact_after:
            compact(store, min_files=compact_after, below=number)

    trigger = trigger or {"processingTime": "1 second"}
    return payloads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
