"""Stream forms: session de-duplication and merges fed by a directory of batches."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from resolvescope.sources.versions import newest_manifest, read_text, run_import


def dedupe_session_stream(sessions: DataFrame, ts: str = "ts", key: str = "session", delay: str = "2 days") -> DataFrame:
    """Drop repeated sessions of a stream. State is kept for ``delay`` past the newest event, so it
    stays bounded; a repeat that comes later than that is passed on."""
    return sessions.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def merge_stream(batches: DataFrame, root: str, checkpoint: str, job: Callable) -> StreamingQuery:
    """Run an import for every micro-batch against the newest table versions, exactly once.

    ``job(tables, batch)`` returns an ImportResult. The manifest that makes its tables current also names
    the stream (by the id that its checkpoint keeps over restarts) and the micro-batch. A batch that comes
    again, because the job died after the commit and before the checkpoint, is found there and skipped. A
    job that loses a race for a table runs again on the tables that won.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        stream = json.loads(read_text(spark, f"{checkpoint.rstrip('/')}/metadata"))["id"]
        if newest_manifest(spark, root).streams.get(stream, -1) < epoch:
            run_import(spark, root, lambda tables: job(tables, batch), (stream, epoch))

    return (
        batches.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
