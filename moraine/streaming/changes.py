"""Structured Streaming into the merges: every micro-batch is one commit.

The stream's batch id is kept in the snapshot's metadata, so a batch that is
run again after a failure is recognised and skipped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

BATCH, QUERY = "stream-batch-id", "stream-query"


def merge_stream(engine, stream: DataFrame, table: str, query: str, command: Callable, latest: tuple[list[str], str] | None = None) -> DataStreamWriter:
    """A writer that applies each micro-batch by ``command(engine, table, batch)``, which returns a merge ready to execute.

    latest: (keys, order): of several events of one key in a batch the last by
    that order counts.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        t = engine.table(table, refresh=True)
        done = [int(s.summary[BATCH]) for s in t.history(t.snapshot_of()) if s.summary.get(QUERY) == query and BATCH in s.summary]
        if done and batch_id <= max(done):
            return
        if latest:
            keys, order = latest
            from pyspark.sql import functions as F

            names = [c for c in batch.columns]
            last = batch.groupBy(*keys).agg(F.max_by(F.struct(*names), F.col(order)).alias("_last"))
            batch = last.select("_last.*")
        command(engine, table, batch).snapshot_metadata({BATCH: str(batch_id), QUERY: query}).execute()

    return stream.writeStream.foreachBatch(apply).outputMode("append")
