"""Run metrics of a running stream, as rows that ``operators.runs`` reads.

``RunLog`` counts a micro-batch while it is written (``observe``, so without another pass) and, as a listener
of the streaming engine, turns each progress report into one row and a failure into one row with its error.
Rows are small JSON files, one a batch, named by job and batch, so a batch that is replayed has one row.
"""

from __future__ import annotations

import json
import threading
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from changeflow.schema import CHANGE_TYPE, DELETE, INSERT, POSTIMAGE, column, is_not_type
from changeflow.sinks.files import Folder

SCHEMA = (
    "job string, seq bigint, rows bigint, inserts bigint, updates bigint, deletes bigint, appended bigint, "
    "duration_ms bigint, error string"
)
ERROR_CHARS = 4_000
COUNTS = ("rows", "inserts", "updates", "deletes", "appended")


def _counts(changes: DataFrame) -> list:
    """Counts by change type; ``appended`` are the rows that an append keeps."""
    if CHANGE_TYPE not in changes.columns:
        kinds = [F.lit(0).cast("bigint").alias(c) for c in COUNTS[1:4]]
        return [F.count(F.lit(1)).alias("rows"), *[F.sum(k).alias(n) for k, n in zip(kinds, COUNTS[1:4], strict=True)], F.count(F.lit(1)).alias("appended")]
    of = lambda kind, name: F.count_if(column(CHANGE_TYPE) == kind).alias(name)
    return [
        F.count(F.lit(1)).alias("rows"),
        of(INSERT, "inserts"),
        of(POSTIMAGE, "updates"),
        of(DELETE, "deletes"),
        F.count_if(is_not_type(DELETE)).alias("appended"),
    ]


class RunLog(StreamingQueryListener):
    """The run rows of one job below ``path``. ``add`` it to the session before the stream starts."""

    def __init__(self, spark: SparkSession, path: str, job: str):
        self.spark, self.path, self.job = spark, path, job
        self._folder = Folder(spark, path)
        self._seen: dict[int, Observation] = {}
        self._last = -1
        self._ended = threading.Event()

    # In the batch ---------------------------------------------------------------------------

    def observed(self, changes: DataFrame, number: int) -> DataFrame:
        """The batch with its counts taken by whatever reads it first."""
        seen = Observation(f"run-{uuid.uuid4().hex}")
        self._seen[number], self._last = seen, number
        return changes.observe(seen, *_counts(changes))

    # As a listener --------------------------------------------------------------------------

    def add(self) -> None:
        self.spark.streams.addListener(self)

    def remove(self, seconds: float = 30) -> None:
        """Wait for the query's last report and stop listening."""
        self._ended.wait(seconds)
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        if event.name == self.job:
            self._ended.clear()

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = self._seen.pop(p.batchId, None) if p.name == self.job else None
        if seen is not None:
            self._write(p.batchId, {c: seen.get[c] for c in COUNTS}, p.durationMs.get("triggerExecution", p.batchDuration), None)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if self._mine(event) and event.exception is not None:
            self._write(self._last if self._last in self._seen else self._last + 1, {}, 0, event.exception[:ERROR_CHARS])
        self._ended.set()

    def _mine(self, event) -> bool:
        return self.query_id is None or str(event.id) == self.query_id

    #: Set by whoever starts the query; the end of a query is reported by its id alone.
    query_id: str | None = None

    def _write(self, number: int, counts: dict, duration: int, error: str | None) -> None:
        row = {"job": self.job, "seq": number, **counts, "duration_ms": duration, "error": error}
        name = f"{self.job}-{number:010d}{'-error-' + uuid.uuid4().hex if error else ''}.json"
        if not self._folder.exists(name):
            self._folder.create(name, json.dumps(row) + "\n")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all jobs that log below ``path``."""
    return spark.read.schema(SCHEMA).json(path)
