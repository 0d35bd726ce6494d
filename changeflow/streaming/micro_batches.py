"""Streams of whole commits, each micro-batch applied as it comes.

``FeedTransfer`` follows a feed folder through the ``changefeed`` source: a micro-batch is what the stream
read, whole commits bounded by ``max_versions`` and ``max_rows``, and goes to a target with the number it has
in the checkpoint. A target is anything with ``apply(changes, number)`` that takes a repeated number without
harm, such as ``sinks.parquet.AppendFolder`` and ``StateFolder``. ``EventBatches`` does the same for event
files in batches of at most ``max_events``.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from changeflow.operators import feed as feed_ops
from changeflow.sources.event_source import MAX_EVENTS, stream_event_batches
from changeflow.sources.feed_source import stream_feed
from changeflow.streaming.run_log import RunLog
from changeflow.streaming.transfer import guard_checkpoint


class Target(Protocol):
    path: str

    def apply(self, changes: DataFrame, number: int) -> None: ...


def _run(stream: DataFrame, checkpoint: str, interval: str, each, log: RunLog | None = None) -> StreamingQuery:
    if log is None:
        writer = stream.writeStream.foreachBatch(each)
    else:
        log.add()
        writer = stream.writeStream.queryName(log.job).foreachBatch(lambda batch, n: each(log.observed(batch, n), n))
    query = writer.option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
    if log is not None:
        log.query_id = str(query.id)
    return query


def drain(query: StreamingQuery, log: RunLog | None = None) -> None:
    """Wait until the query has applied all that is there, then stop it; an error in a batch is raised."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()
        if log is not None:
            log.remove()


@dataclass(frozen=True)
class FeedTransfer:
    spark: SparkSession
    source: str
    target: Target
    schema: T.StructType | None = None
    start_version: int | str | None = None
    end_version: int | None = None
    max_versions: int = 10
    max_rows: int = 0
    log: RunLog | None = None

    def start(self, checkpoint: str, interval: str = "0 seconds") -> StreamingQuery:
        """A query that goes on until it is stopped. A checkpoint of another source or target is refused.

        With a ``log`` each micro-batch leaves a row there, also one that fails.
        """
        guard_checkpoint(self.spark, checkpoint, self.source, self.target.path)
        stream = stream_feed(
            self.spark,
            self.source,
            self.schema,
            startingVersion=self.start_version,
            endingVersion=self.end_version,
            maxVersionsPerTrigger=self.max_versions,
            maxRowsPerTrigger=self.max_rows,
            checkpoint=checkpoint,
        )
        stream = feed_ops.postimages(stream)
        return _run(stream, checkpoint, interval, self.target.apply, self.log)


@dataclass(frozen=True)
class EventBatches:
    spark: SparkSession
    source: str
    target: Target
    max_events: int = MAX_EVENTS
    order: str = "time"
    together: int = 1

    def start(self, checkpoint: str, interval: str = "0 seconds") -> StreamingQuery:
        """A query that goes on until it is stopped; no batch has more than ``max_events`` events.

        A micro-batch is one batch, or up to ``together`` of a backlog. They go to the target's
        ``apply_batches`` with their numbers in ``batch``, the same ones if the micro-batch comes again.
        """
        guard_checkpoint(self.spark, checkpoint, self.source, self.target.path)
        stream = stream_event_batches(self.spark, self.source, self.max_events, self.order, checkpoint, self.together)
        if self.together == 1:
            return _run(stream, checkpoint, interval, self.target.apply)
        return _run(stream, checkpoint, interval, lambda batch, _: self.target.apply_batches(batch))
