"""Move a table's changes into a target, commit group by commit group.

The stream itself reads only the source's commit log, one small file per version, so a micro-batch
is always made of whole commits. The rows of a group are then read by an ordinary, pruned parquet
scan and applied as one commit of the target. That commit carries the job's progress, which makes
every mode exactly-once: a batch that is replayed finds its versions already applied.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from changeflow.operators import feed as feed_ops
from changeflow.operators.merge import MergeSpec, with_key_bucket
from changeflow.plans.grouping import key_chunk, plan_adaptive, plan_row_cap
from changeflow.schema import column, hashable_columns
from changeflow.sinks.files import Folder
from changeflow.sinks.table import Outcome, VersionedTable, file_name
from changeflow.sources import events as ev
from changeflow.sources.commits import commit_rows, log_lines
from changeflow.sources.feeds import DeltaSource
from changeflow.streaming import tunables as tune

# Commits planned at once. Where a slice ends has no part in the result: the group that is still open
# there is planned again with the next slice.
PLAN_SLICE = 1_000
CHUNK = "__chunk"


@dataclass(frozen=True)
class Group:
    """Versions applied together; a large version may be cut into chunks."""

    first: int
    last: int
    chunks: int = 1


@dataclass(frozen=True)
class TransferSpec:
    source: str
    target: str
    mode: str
    merge: MergeSpec | None = None
    job: str = "default"
    start_version: int | None = None
    end_version: int | None = None
    max_versions: int = 10
    max_rows: int = 0
    adaptive: bool = False
    buckets: int = 64
    source_format: str = "changeflow"


class SourceMismatch(ValueError):
    """Stored progress belongs to another source."""


def guard_source(stored: str | None, wanted: str, override: bool = False) -> None:
    """Refuse progress of another source, which would skip data without a word.

    Progress without a source is adopted. ``override`` (an explicit start) is accepted.
    """
    if stored is not None and stored != wanted and not override:
        raise SourceMismatch(
            f"this job has come as far as it has in '{stored}'; going on in '{wanted}' would leave out "
            "what lies before. A version to start from says that this is meant."
        )


class Transfer:
    def __init__(self, spark: SparkSession, spec: TransferSpec):
        self.spark = spark
        self.spec = spec
        sources = {"changeflow": VersionedTable, "delta": DeltaSource}
        if spec.source_format not in sources:
            raise ValueError(f"unknown source format '{spec.source_format}': use {list(sources)}")
        self.source = sources[spec.source_format](spark, spec.source)
        self.target = VersionedTable(spark, spec.target, spec.buckets)
        self.tunables = Folder(spark, f"{self.target.path}/tunables")
        self._start = spec.start_version

    # Where to go on -----------------------------------------------------------------------

    def progress(self) -> tuple[int, int, int]:
        """``(last version done, chunks done of the next version, its chunks)``."""
        stored = self.target.snapshot().progress.get(self.spec.job, {})
        guard_source(stored.get("source"), self.source.path, self._start is not None)
        if self._start is not None:
            return feed_ops.resolve_start(self._start, None), 0, 1
        last = feed_ops.resolve_start(None, stored.get("version"))
        return last, stored.get("chunk", 0), stored.get("chunks", 1)

    def cap(self) -> int:
        return feed_ops.end_version(self.source.current_version(), self.spec.end_version)

    # Grouping -----------------------------------------------------------------------------

    def groups(self, after: int, cap: int) -> Iterator[Group]:
        """The next groups after version ``after``. One row per group comes to the driver."""
        if cap <= after:
            return
        n = max(self.spec.max_versions, 1)
        if not self.spec.adaptive and self.spec.max_rows <= 0:
            for first in range(after + 1, cap + 1, n):
                yield Group(first, min(first + n - 1, cap))
            return
        # At least two groups fit a slice, so leaving out the open one leaves one to apply.
        end = min(cap, after + max(PLAN_SLICE, 2 * n))
        more, cap = end < cap, end
        sizes = self._sizes(after, cap)
        if self.spec.adaptive:
            t = tune.load(self.tunables)
            plan = plan_adaptive(sizes, t.split_threshold_rows, t.merge_threshold_rows, n)
        else:
            plan = plan_row_cap(sizes, self.spec.max_rows, n)
        rows = (
            plan.groupBy("group")
            .agg(F.min("version"), F.max("version"), F.sum("rows"))
            .orderBy("group")
            .collect()
        )
        for _, first, last, total in rows:
            if more and last == cap:
                return
            chunks = 1
            large = self.spec.adaptive and first == last and total > t.split_threshold_rows
            if large and self._can_split():
                chunks = max(-(-total // t.chunk_target_rows), 2)
                if self.spec.mode == "merge":
                    chunks = max(min(chunks, self._buckets()), 1)
            yield Group(first, last, chunks)

    def _can_split(self) -> bool:
        """Overwriting by chunks would leave the last chunk only, and a transform may look at, or
        make keys from, all rows of a commit."""
        merge = self.spec.merge
        return self.spec.mode == "append" or (
            self.spec.mode == "merge" and not (merge.transform_sql or merge.transform_arrow)
        )

    def _sizes(self, after: int, cap: int) -> DataFrame:
        """``version, rows`` from the commit files; change rows where the commit counts them.

        A commit that cannot be read fails the job rather than being skipped.
        """
        paths = [f"{self.source.log_path}/{file_name(v)}" for v in range(after + 1, cap + 1)]
        lines = self.spark.read.text(paths).select("value", F.col("_metadata.file_name").alias("file_name"))
        log = log_lines(lines)
        changes = F.get_json_object("action", "$.cdc.stats.numRecords").cast("bigint")
        counted = log.groupBy("version").agg(F.sum(changes).alias("changes"))
        return commit_rows(log).join(counted, "version").select(
            "version", F.coalesce("changes", "rows").alias("rows")
        )

    # Applying -----------------------------------------------------------------------------

    def run(self, once: bool = False) -> list[Outcome]:
        """Apply what is pending; ``once`` stops after one group."""
        done: list[Outcome] = []
        last, chunk, chunks = self.progress()
        if chunk and last < self.cap():
            # Left inside a version: go on with the chunks it was cut into then.
            done += self._apply(Group(last + 1, last + 1, chunks), chunk)
            last += 1
            if once:
                return done
        while last < self.cap():
            for group in self.groups(last, self.cap()):
                done += self._apply(group)
                last, self._start = group.last, None
                if once:
                    return done
        return done

    def _apply(self, group: Group, first_chunk: int = 0) -> Iterator[Outcome]:
        feed = self.source.read_feed(group.first, group.last)
        changes = feed_ops.read_changes(feed, group.first, group.last)
        staged = f"split-{self.spec.job}"
        if group.chunks > 1:
            # The commit is read once and written once, a folder for each chunk.
            path = f"{self.target.path}/staging/{staged}"
            divided = self._divide(changes, group.chunks)
            divided.write.mode("overwrite").partitionBy(CHUNK).parquet(path)
            schema = changes.schema
        label = f"v{group.first}" if group.first == group.last else f"v{group.first}-v{group.last}"
        for chunk in range(first_chunk, group.chunks):
            part, name = changes, label
            if group.chunks > 1:
                folder = f"{CHUNK}={chunk}"
                there = Folder(self.spark, path).exists(folder)
                part = self.spark.read.schema(schema).parquet(f"{path}/{folder}") if there else changes.limit(0)
                name = f"{label}[chunk {chunk + 1}/{group.chunks}]"
            complete = chunk + 1 == group.chunks
            progress = {
                "source": self.source.path,
                "version": group.last if complete else group.first - 1,
                "chunk": 0 if complete else chunk + 1,
                "chunks": group.chunks,
            }
            yield self.target.apply(
                part, self.spec.mode, self.spec.merge, self.spec.job, progress, {"range": name}, staged=group.chunks > 1
            )
        if group.chunks > 1:
            Folder(self.spark, f"{self.target.path}/staging").remove(staged)

    def _buckets(self) -> int:
        return self.target.snapshot().buckets or self.target.buckets

    def _divide(self, changes: DataFrame, chunks: int) -> DataFrame:
        """A commit with the number of each row's chunk.

        In a merge a chunk is a range of the target's buckets, so all changes of a key stay together and
        no two chunks rewrite the same rows.
        """
        if not self.spec.merge:
            keys = hashable_columns(changes)
            return changes.withColumn(CHUNK, key_chunk([column(k) for k in keys], chunks))
        buckets = self._buckets()
        numbered = with_key_bucket(changes, self.spec.merge.keys, buckets, CHUNK, self.target.snapshot().schema)
        return numbered.withColumn(CHUNK, F.floor(F.col(CHUNK) * chunks / buckets).cast("int"))

    # Streaming ----------------------------------------------------------------------------

    def start(self, checkpoint: str, interval: str | None = None) -> StreamingQuery:
        """A streaming query over the commit log; without ``interval`` it drains what is there.

        No version beyond the end version is applied. ``follow`` also ends the query there.
        """
        owner = guard_checkpoint(
            self.spark, checkpoint, self.source.path, self.spec.target, self._start is not None
        )
        lines = (
            self.spark.readStream.option("maxFilesPerTrigger", max(self.spec.max_versions, 1))
            .option("pathGlobFilter", "*.json")
            .text(self.source.log_path)
        )
        versions = log_lines(lines.select("value", F.col("_metadata.file_name").alias("file_name")))
        if owner["used"]:
            # The checkpoint may have seen versions that an end version held back, or that an
            # explicit start asks for again; no new file would announce them.
            self.run()

        def on_batch(_: DataFrame, __: int) -> None:
            # New files only say that there is work. All versions that exist are planned together,
            # so that groups do not depend on which files a trigger happened to bring.
            self.run()

        writer = versions.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
        trigger = {"processingTime": interval} if interval else {"availableNow": True}
        return writer.trigger(**trigger).start()

    def follow(self, checkpoint: str, interval: str | None = None) -> None:
        """Run the stream until it ends, fails, or has applied the end version."""
        query = self.start(checkpoint, interval)
        end = self.spec.end_version
        while not query.awaitTermination(1):
            if end is not None and self.progress()[0] >= end:
                query.stop()


def guard_checkpoint(
    spark: SparkSession, checkpoint: str, source: str, target: str, override: bool = False
) -> dict:
    """The record beside a streaming checkpoint that says whose it is; made at first use."""
    base, _, name = checkpoint.rstrip("/").rpartition("/")
    folder = Folder(spark, base)
    record = f"{name}.owner.json"
    if not folder.exists(record):
        owner = {"source": source, "target": target, "stream": uuid.uuid4().hex}
        folder.create(record, json.dumps(owner))
        return {**owner, "used": False}
    owner = {**json.loads(folder.read(record)), "used": True}
    guard_source(owner.get("source"), source, override)
    if owner.get("target") != target:
        raise SourceMismatch(f"checkpoint {checkpoint} feeds '{owner.get('target')}', not '{target}'")
    return owner


@dataclass(frozen=True)
class EventSpec:
    """Where events go. ``signature`` names the log: namespace, name and consumer group."""

    signature: str
    target: str
    mode: str
    merge: MergeSpec | None = None
    job: str = "default"
    partitions: str | tuple[str, ...] | None = None
    initial_position: str = "latest"
    buckets: int = 64


def log_signature(namespace: str, name: str, consumer_group: str = "") -> str:
    return f"{namespace}|{name}|{consumer_group.strip() or '$Default'}"


class EventTransfer:
    """Move normalised events into a target, with the offset of every log partition."""

    def __init__(self, spark: SparkSession, spec: EventSpec):
        self.spark = spark
        self.spec = spec
        self.target = VersionedTable(spark, spec.target, spec.buckets)

    def offsets(self) -> dict[str, int]:
        """A report: the offset of every log partition."""
        return {r.partition_id: r.sequence_number for r in self.offset_table().collect()}

    def offset_table(self) -> DataFrame:
        """The stored offsets, one row per log partition."""
        return self._offsets_in(self._progress())

    def _progress(self) -> dict:
        stored = self.target.snapshot().progress.get(self.spec.job, {})
        guard_source(stored.get("source"), self.spec.signature)
        return stored

    def _offsets_in(self, stored: dict) -> DataFrame:
        schema = "partition_id string, sequence_number bigint"
        if "offset_table" in stored:
            return self.spark.read.schema(schema).parquet(stored["offset_table"])
        return self.spark.createDataFrame(sorted(stored.get("offsets", {}).items()), schema)

    def apply(
        self,
        events: DataFrame,
        start: DataFrame | dict[str, int],
        latest: dict[str, int] | None = None,
        batch: dict | None = None,
    ) -> Outcome:
        """Apply one batch of events beyond the ``start`` offsets and move the offsets on.

        The batch is read from the log once. Offsets are kept as a table, in turn in one of two folders
        of which the last commit names the one that counts.
        """
        stored = self._progress()
        if batch and stored.get("batch") == batch:
            return Outcome(target_version=self.target.current_version())
        rows = ev.select_partitions(events, self.spec.partitions)
        rows = ev.resume_events(rows, start, self.spec.initial_position, latest)
        rows = self.target.stage(rows, f"events-{self.spec.job}")
        turns = [f"{self.target.path}/offsets/{self.spec.job}-{i}" for i in (0, 1)]
        other = turns[1] if stored.get("offset_table") == turns[0] else turns[0]
        moved = ev.merge_offsets(self._offsets_in(stored), rows)
        moved.write.mode("overwrite").parquet(other)
        progress = {"source": self.spec.signature, "offset_table": other, "batch": batch}
        spec = self.spec
        return self.target.apply(rows, spec.mode, spec.merge, spec.job, progress, staged=True)

    def start(
        self,
        events: DataFrame,
        checkpoint: str,
        interval: str | None = None,
        latest: dict[str, int] | None = None,
        once: bool = False,
    ) -> StreamingQuery:
        """Stream events; without ``interval`` what is there is drained and the query ends.

        ``once`` takes what is there as a single batch, one commit of the target.

        Stored offsets matter when the streaming checkpoint is new; later the checkpoint itself
        knows what was read. ``latest`` are the offsets a new reader starts behind.
        """
        owner = guard_checkpoint(self.spark, checkpoint, self.spec.signature, self.spec.target)
        stored = self._progress()
        if not stored and latest is None and ev.initial_position(self.spec.initial_position) == "latest":
            raise ValueError("initial position 'latest' needs the offsets at the start")
        base, _, name = checkpoint.rstrip("/").rpartition("/")
        folder, record = Folder(self.spark, base), f"{name}.start.json"
        if not folder.exists(record):
            first = {"offset_table": f"{base}/{name}.start-offsets", "latest": latest or {}}
            self._offsets_in(stored).write.mode("overwrite").parquet(first["offset_table"])
            folder.create(record, json.dumps(first))
        begin = json.loads(folder.read(record))

        def on_batch(batch: DataFrame, number: int) -> None:
            key = {"stream": owner["stream"], "number": number}
            self.apply(batch, self._offsets_in(begin), begin["latest"], key)

        writer = events.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
        trigger = {"processingTime": interval} if interval else {"availableNow": True}
        trigger = {"once": True} if once else trigger
        return writer.trigger(**trigger).start()

