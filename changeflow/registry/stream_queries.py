"""End states of applied and streamed batches. Each query writes to a fresh working folder."""

import json

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from changeflow import jobs
from changeflow.operators import feed as ops
from changeflow.operators import runs
from changeflow.operators.merge import MergeSpec
from changeflow.registry import fixtures as fx
from changeflow.registry.base import query
from changeflow.registry.event_queries import JSON_MERGE
from changeflow.registry.feed_queries import SNAPSHOT_DIFF, snapshots
from changeflow.registry.plan_queries import HUGE, greedy
from changeflow.session import work_dir
from changeflow.sinks.table import VersionedTable
from changeflow.sinks.parquet import AppendFolder, StateFolder
from changeflow.sources import events as ev
from changeflow.sources.event_source import event_batches, read_event_batch
from changeflow.sources.feed_source import read_feed, write_feed
from changeflow.sources.feeds import stream_changes as stream_folder
from changeflow.streaming.micro_batches import EventBatches, FeedTransfer, drain
from changeflow.streaming.run_log import RunLog, read_runs
from changeflow.streaming.transfer import EventSpec, EventTransfer, SourceMismatch, Transfer, TransferSpec

_NEWEST = "_commit_version DESC NULLS FIRST, event_id DESC NULLS FIRST"
_DATA = "user_id, event_id, event_type, value, props"
_MERGED = fx.merge_sql(fx.TARGET, fx.last_sql(fx.POST, "user_id", _NEWEST), ["user_id"], fx.COLUMNS)
_BY_USER = MergeSpec(("user_id",), tie_breakers=("event_id",))
BUCKETS = 8


def _source(spark, sf, root):
    table = VersionedTable(spark, f"{root}/source")
    table.import_feed(fx.feed(spark, sf))
    return table.path


def _accounts(spark, sf, root):
    """A target that already holds the account table."""
    table = VersionedTable(spark, f"{root}/target", BUCKETS)
    table.apply(fx.target(spark, sf), "overwrite")
    return table


def _stream(spark, root, mode, **options):
    spec = TransferSpec(f"{root}/source", f"{root}/target", mode, buckets=BUCKETS, **options)
    Transfer(spark, spec).start(f"{root}/checkpoint").awaitTermination()
    return VersionedTable(spark, spec.target)


@query("append_apply", f"SELECT {_DATA} FROM ({fx.POST}) p WHERE _change_type <> 'delete'")
def append_apply(spark, sf):
    table = VersionedTable(spark, f"{work_dir(spark, 'append')}/target")
    feed = ops.postimages(fx.feed(spark, sf))
    table.apply(ops.up_to(feed, 14), "append")
    table.apply(ops.newer_than(feed, 14), "append")
    return table.read()


@query(
    "overwrite_apply",
    f"SELECT {_DATA} FROM ({fx.POST}) p WHERE _change_type <> 'delete' AND _commit_version > 14",
)
def overwrite_apply(spark, sf):
    table = VersionedTable(spark, f"{work_dir(spark, 'overwrite')}/target")
    feed = ops.postimages(fx.feed(spark, sf))
    table.apply(ops.up_to(feed, 14), "overwrite")
    table.apply(ops.newer_than(feed, 14), "overwrite")
    return table.read()


@query("merge_apply", _MERGED)
def merge_apply(spark, sf):
    table = _accounts(spark, sf, work_dir(spark, "merge"))
    feed = ops.postimages(fx.feed(spark, sf))
    table.apply(ops.up_to(feed, 9), "merge", _BY_USER)
    table.apply(ops.newer_than(feed, 9), "merge", _BY_USER)
    return table.read()


@query("stream_append", f"SELECT {_DATA} FROM ({fx.POST}) p WHERE _change_type <> 'delete'")
def stream_append(spark, sf):
    root = work_dir(spark, "stream-append")
    _source(spark, sf, root)
    return _stream(spark, root, "append").read()


@query(
    "stream_overwrite",
    f"SELECT {_DATA} FROM ({fx.POST}) p WHERE _change_type <> 'delete' AND _commit_version >= 20",
)
def stream_overwrite(spark, sf):
    root = work_dir(spark, "stream-overwrite")
    _source(spark, sf, root)
    return _stream(spark, root, "overwrite").read()


@query("stream_merge", _MERGED)
def stream_merge(spark, sf):
    root = work_dir(spark, "stream-merge")
    _source(spark, sf, root)
    _accounts(spark, sf, root)
    return _stream(spark, root, "merge", merge=_BY_USER).read()


@query("stream_resume", _MERGED)
def stream_resume(spark, sf):
    """Stop at version 12, then go on from the checkpoint."""
    root = work_dir(spark, "stream-resume")
    _source(spark, sf, root)
    _accounts(spark, sf, root)
    _stream(spark, root, "merge", merge=_BY_USER, end_version=12)
    sixth = fx.table(spark, sf, "events").count() // 6
    return _stream(spark, root, "merge", merge=_BY_USER, max_rows=sixth).read()


@query("stream_adaptive", _MERGED)
def stream_adaptive(spark, sf):
    """Large commits split by key, small ones grouped, by thresholds the job reads itself."""
    root = work_dir(spark, "stream-adaptive")
    VersionedTable(spark, f"{root}/source").import_feed(fx.feed(spark, sf))
    table = _accounts(spark, sf, root)
    rows = ops.commit_sizes(fx.feed(spark, sf)).agg(F.max("rows"), F.sum("rows")).first()
    spec = TransferSpec(f"{root}/source", table.path, "merge", _BY_USER, adaptive=True, buckets=BUCKETS)
    transfer = Transfer(spark, spec)
    wanted = {
        "split_threshold_rows": rows[0] - 1,
        "chunk_target_rows": rows[0] // 2,
        "merge_threshold_rows": rows[1] // 3,
    }
    transfer.tunables.create("tunables-0000000000.json", json.dumps(wanted))
    transfer.run()
    return table.read()


@query("stream_chained", _MERGED)
def stream_chained(spark, sf):
    """The feed a merge emits, streamed into a replica, gives the same rows."""
    root = work_dir(spark, "stream-chained")
    _source(spark, sf, root)
    first = VersionedTable(spark, f"{root}/target", BUCKETS)
    spec = TransferSpec(f"{root}/source", first.path, "merge", _BY_USER, max_versions=15, buckets=BUCKETS)
    accounts = fx.target(spark, sf)
    first.apply(accounts, "append")
    Transfer(spark, spec).run()
    replica = TransferSpec(first.path, f"{root}/replica", "merge", MergeSpec(("user_id",)), buckets=BUCKETS)
    Transfer(spark, replica).run()
    return VersionedTable(spark, replica.target).read()


@query(
    "stream_event_log",
    "SELECT * EXCLUDE (rn) FROM (SELECT CAST(json_extract_string(body, '$.k') AS BIGINT) AS k, "
    "partition_id, sequence_number, row_number() OVER (PARTITION BY json_extract_string(body, '$.k') "
    f"ORDER BY sequence_number DESC) AS rn FROM ({fx.EVENT_LOG}) e) q WHERE rn = 1",
)
def stream_event_log(spark, sf):
    root = work_dir(spark, "stream-events")
    log = fx.event_log(spark, sf)
    log.write.parquet(f"{root}/events")
    spec = EventSpec(
        "files|events|$Default",
        f"{root}/target",
        "merge",
        MergeSpec(("k",), transform_sql=JSON_MERGE),
        initial_position="earliest",
        buckets=BUCKETS,
    )
    events = ev.stream_event_files(spark, f"{root}/events", log.schema)
    EventTransfer(spark, spec).start(events, f"{root}/checkpoint").awaitTermination()
    return VersionedTable(spark, spec.target).read()


@query("snapshot_track", SNAPSHOT_DIFF)
def snapshot_track(spark, sf):
    """The feed a table gives that follows the snapshots of a source without one."""
    table = VersionedTable(spark, f"{work_dir(spark, 'track')}/target", BUCKETS)
    for snapshot in snapshots(spark, sf):
        jobs.track_snapshot(table, snapshot, ["k"])
    return table.read_feed(1, 1).select("k", "st", "p", "_change_type")


def _run(spark, root, mode, once=False, **options):
    spec = TransferSpec(f"{root}/source", f"{root}/target", mode, buckets=BUCKETS, **options)
    Transfer(spark, spec).run(once=once)
    return VersionedTable(spark, spec.target)


_LIVE = f"SELECT {_DATA} FROM ({fx.POST}) p WHERE _change_type <> 'delete'"


@query("stream_overwrite_groups", f"{_LIVE} AND _commit_version >= 28")
def stream_overwrite_groups(spark, sf):
    """Groups of seven of 30 versions: the last two are what an overwritten target ends with."""
    root = work_dir(spark, "stream-groups")
    _source(spark, sf, root)
    return _stream(spark, root, "overwrite", max_versions=7).read()


@query(
    "stream_row_cap",
    greedy(
        fx.COMMITS,
        HUGE,
        '(SELECT 3 * max("rows") FROM commits)',
        7,
        f"{_LIVE} AND _commit_version IN "
        '(SELECT version FROM plan WHERE "group" = (SELECT max("group") FROM plan))',
    ),
)
def stream_row_cap(spark, sf):
    """Groups by rows, as the plan makes them: an overwritten target ends with the plan's last group."""
    root = work_dir(spark, "stream-rows")
    _source(spark, sf, root)
    largest = ops.commit_sizes(fx.feed(spark, sf)).agg(F.max("rows")).first()[0]
    return _stream(spark, root, "overwrite", max_versions=7, max_rows=3 * largest).read()


@query("stream_once", f"{_LIVE} AND _commit_version < 10")
def stream_once(spark, sf):
    """One group of ten versions, then the job ends."""
    root = work_dir(spark, "stream-once")
    _source(spark, sf, root)
    return _run(spark, root, "append", once=True).read()


@query("stream_replay", f"{_LIVE}")
def stream_replay(spark, sf):
    """A job that runs again, also beside a stream with a checkpoint of its own, adds nothing twice."""
    root = work_dir(spark, "stream-replay")
    _source(spark, sf, root)
    _run(spark, root, "append", once=True)
    _run(spark, root, "append")
    return _stream(spark, root, "append").read()


@query("stream_changes", f"SELECT {_DATA}, _change_type, _commit_version FROM ({fx.FEED}) f WHERE _commit_version BETWEEN 5 AND 9")
def stream_changes(spark, sf):
    """A feed stored in folders of commits, streamed file by file."""
    root = work_dir(spark, "stream-changes")
    feed = fx.feed(spark, sf).drop("_commit_timestamp")
    feed.write.partitionBy("_commit_version").parquet(f"{root}/feed")
    new = stream_folder(spark, f"{root}/feed", feed.schema, 7).where("_commit_version BETWEEN 5 AND 9")
    writer = new.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    writer.start(f"{root}/out", format="parquet").awaitTermination()
    return spark.read.parquet(f"{root}/out").select(*feed.columns)


@query("merge_empty_batch", fx.TARGET)
def merge_empty_batch(spark, sf):
    """Empty batches, and one of nothing but pre-images, leave the target as it is."""
    table = _accounts(spark, sf, work_dir(spark, "merge-empty"))
    feed = fx.feed(spark, sf)
    for mode, spec in (("merge", _BY_USER), ("append", None)):
        table.apply(feed.limit(0), mode, spec)
    table.apply(ops.postimages(feed.where("_change_type = 'update_preimage'")), "merge", _BY_USER)
    return table.read()


@query("event_replay", f"SELECT partition_id, sequence_number, body FROM ({fx.EVENT_LOG}) e")
def event_replay(spark, sf):
    """A batch of events delivered twice, then the whole log again from the stored offsets."""
    root = work_dir(spark, "event-replay")
    spec = EventSpec("files|replay|$Default", f"{root}/target", "append", initial_position="earliest")
    log = fx.event_log(spark, sf).drop("properties")
    transfer = EventTransfer(spark, spec)
    first = log.where("sequence_number % 3 = 0 AND sequence_number < 500 OR sequence_number < 400")
    for _ in range(2):
        transfer.apply(first, {}, batch={"stream": "s", "number": 0})
    transfer.apply(log.where("NOT (sequence_number % 3 = 0 AND sequence_number < 500 OR sequence_number < 400)"), {})
    transfer.apply(log, transfer.offset_table())
    return transfer.target.read().select("partition_id", "sequence_number", "body")


# A feed folder as a data source, and event files in bounded batches ------------------------------

_FEED_COLUMNS = f"{_DATA}, _change_type, _commit_version, _commit_timestamp"


@query(
    "feed_source_batch",
    f"SELECT {_FEED_COLUMNS} FROM ({fx.POST}) p WHERE _commit_version BETWEEN 3 AND 17 AND event_type <> 'view'",
)
def feed_source_batch(spark, sf):
    """Some commits of a feed folder; the others are not opened."""
    path = f"{work_dir(spark, 'feed')}/feed"
    write_feed(fx.feed(spark, sf), path)
    return ops.read_changes(read_feed(spark, path, endingVersion=20), 3, 17).where("event_type <> 'view'")


class _Recorded(AppendFolder):
    """Keeps the version beside the rows of each batch."""

    def apply(self, changes, number):
        kept = ops.without_tombstones(changes).withColumn("version", F.col("_commit_version"))
        super().apply(kept, number)


_FIRST_RUN, _PER_BATCH = 12, 5


@query(
    "feed_source_stream",
    f"""WITH p AS ({fx.POST}), v AS (SELECT version, row_number() OVER (ORDER BY version) - 1 AS i
  FROM (SELECT DISTINCT _commit_version AS version FROM ({fx.FEED}) f)),
n AS (SELECT count(*) AS n FROM v WHERE version <= {_FIRST_RUN}),
b AS (SELECT version, CASE WHEN i < n THEN i // {_PER_BATCH}
  ELSE (n + {_PER_BATCH - 1}) // {_PER_BATCH} + (i - n) // {_PER_BATCH} END AS batch FROM v, n)
SELECT {_DATA}, version, CAST(batch AS INTEGER) AS batch FROM p JOIN b ON version = _commit_version WHERE _change_type <> 'delete'""",
)
def feed_source_stream(spark, sf):
    """Micro-batches of whole commits, over a stop between two commits and a restart."""
    root = work_dir(spark, "feed-stream")
    write_feed(fx.feed(spark, sf), f"{root}/feed")
    target = _Recorded(spark, f"{root}/target")
    for end in (_FIRST_RUN, None):
        transfer = FeedTransfer(spark, f"{root}/feed", target, end_version=end, max_versions=_PER_BATCH)
        drain(transfer.start(f"{root}/checkpoint"))
    return target.read()


@query("feed_source_merge", _MERGED)
def feed_source_merge(spark, sf):
    """A feed folder merged, micro-batch by micro-batch, into plain parquet divided by key."""
    root = work_dir(spark, "feed-merge")
    write_feed(fx.feed(spark, sf), f"{root}/feed")
    target = StateFolder(spark, f"{root}/target", _BY_USER, BUCKETS)
    target.apply(fx.target(spark, sf), -1)
    drain(FeedTransfer(spark, f"{root}/feed", target, max_rows=2_000).start(f"{root}/checkpoint"))
    return target.read()


#: Events of a file, about, where six files would be larger, and batches that a stream behind takes at once.
_FILE_EVENTS, _TOGETHER = 200_000, 400


def _event_files(spark, sf, path):
    """The event log in a few files of unequal size, more if it is large, in the order of its sequence numbers."""
    log = fx.event_log(spark, sf).withColumn("__part", F.floor(F.sqrt("sequence_number") / 20))
    files = max(6, log.count() // _FILE_EVENTS)
    sorted_log = log.repartitionByRange(files, "__part").sortWithinPartitions("sequence_number").drop("__part")
    sorted_log.write.option("parquet.block.size", 32_768).parquet(path)


_MAX_EVENTS = 700
_BATCHES = f"""SELECT (row_number() OVER (ORDER BY event_id) - 1) // {_MAX_EVENTS} AS batch, event_id FROM events"""


@query(
    "event_batch_cut",
    f"""SELECT batch, count(*) AS events, min(event_id) AS first_sequence, max(event_id) AS last_sequence
FROM ({_BATCHES}) b GROUP BY batch""",
)
def event_batch_cut(spark, sf):
    """Batches of at most so many events, cut inside files, and what each holds."""
    path = f"{work_dir(spark, 'events')}/log"
    _event_files(spark, sf, path)
    events = read_event_batch(event_batches(spark, path, _MAX_EVENTS, order="name"), path)
    return events.groupBy("batch").agg(
        F.count("*").alias("events"),
        F.min("sequence_number").alias("first_sequence"),
        F.max("sequence_number").alias("last_sequence"),
    )


@query(
    "event_batch_stream",
    f"""SELECT CAST(batch AS INTEGER) AS batch, count(*) AS events, min(event_id) AS first_sequence,
  max(event_id) AS last_sequence FROM ({_BATCHES.replace(str(_MAX_EVENTS), "3000")}) b GROUP BY batch""",
)
def event_batch_stream(spark, sf):
    """The same as micro-batches of a stream."""
    root = work_dir(spark, "event-stream")
    _event_files(spark, sf, f"{root}/log")
    target = AppendFolder(spark, f"{root}/target")
    drain(EventBatches(spark, f"{root}/log", target, 3_000, "name", _TOGETHER).start(f"{root}/checkpoint"))
    return target.read().groupBy("batch").agg(
        F.count("*").alias("events"),
        F.min("sequence_number").alias("first_sequence"),
        F.max("sequence_number").alias("last_sequence"),
    )


# Run rows that a stream leaves ---------------------------------------------------------------------

_BY_BATCH = f"""WITH p AS ({fx.POST}), v AS (SELECT version, row_number() OVER (ORDER BY version) - 1 AS i
  FROM (SELECT DISTINCT _commit_version AS version FROM ({fx.FEED}) f)),
b AS (SELECT p.*, i // {_PER_BATCH} AS batch FROM p JOIN v ON version = _commit_version),
r AS (SELECT 'events' AS job, batch, count(*) AS n, count(*) FILTER (_change_type = 'insert') AS inserts,
  count(*) FILTER (_change_type = 'update_postimage') AS updates, count(*) FILTER (_change_type = 'delete') AS deletes,
  count(*) FILTER (_change_type <> 'delete') AS appended FROM b GROUP BY batch)"""


@query(
    "run_totals_stream",
    f"""{_BY_BATCH} SELECT job, count(*) AS batches, sum(inserts)::BIGINT AS inserts, sum(updates)::BIGINT AS updates,
  sum(deletes)::BIGINT AS deletes, sum(appended)::BIGINT AS appended FROM r GROUP BY job""",
)
def run_totals_stream(spark, sf):
    """Totals over the log that a stream wrote while it ran."""
    root = work_dir(spark, "run-log")
    write_feed(fx.feed(spark, sf), f"{root}/feed")
    log = RunLog(spark, f"{root}/runs", "events")
    transfer = FeedTransfer(spark, f"{root}/feed", AppendFolder(spark, f"{root}/target"), max_versions=_PER_BATCH, log=log)
    drain(transfer.start(f"{root}/checkpoint"), log)
    return runs.run_totals(read_runs(spark, f"{root}/runs"))


class _Refusing(AppendFolder):
    """Fails at the first change of a version beyond a limit, as a transform that meets a bad row would."""

    limit = 12

    def apply(self, changes, number):
        bad = F.raise_error(F.lit("a row that can not be read"))
        super().apply(changes.withColumn("value", F.when(F.col("_commit_version") > self.limit, bad).otherwise(F.col("value"))), number)


@query(
    "stream_failure",
    f"""{_BY_BATCH}, f AS (SELECT min(batch) AS failed FROM b WHERE _commit_version > {_Refusing.limit})
SELECT batch AS seq, n AS rows, appended, false AS failed FROM r, f WHERE batch < f.failed
UNION ALL SELECT failed, NULL, NULL, true FROM f""",
)
def stream_failure(spark, sf):
    """A row for each batch that was applied and one, with its error, for the batch that ended the stream."""
    root = work_dir(spark, "run-failure")
    write_feed(fx.feed(spark, sf), f"{root}/feed")
    log = RunLog(spark, f"{root}/runs", "events")
    transfer = FeedTransfer(spark, f"{root}/feed", _Refusing(spark, f"{root}/target"), max_versions=_PER_BATCH, log=log)
    try:
        drain(transfer.start(f"{root}/checkpoint"), log)
    except StreamingQueryException as e:
        if "can not be read" not in str(e):
            raise
    failed = F.coalesce(F.col("error").contains("can not be read"), F.lit(False))
    return read_runs(spark, f"{root}/runs").select("seq", "rows", "appended", failed.alias("failed"))


@query(
    "stream_guard",
    f"SELECT true AS refused_source, true AS refused_target, count(*) AS rows FROM ({fx.POST}) p WHERE _change_type <> 'delete'",
)
def stream_guard(spark, sf):
    """A checkpoint serves one source and one target; what it has applied stays."""
    root = work_dir(spark, "guard")
    target = AppendFolder(spark, f"{root}/target")
    for name in ("feed", "other"):
        write_feed(fx.feed(spark, sf), f"{root}/{name}")
    drain(FeedTransfer(spark, f"{root}/feed", target, max_versions=0).start(f"{root}/checkpoint"))
    refused = []
    for name, place in (("other", target), ("feed", AppendFolder(spark, f"{root}/elsewhere"))):
        try:
            drain(FeedTransfer(spark, f"{root}/{name}", place).start(f"{root}/checkpoint"))
            refused.append(False)
        except SourceMismatch:
            refused.append(True)
    return target.read().agg(
        F.lit(refused[0]).alias("refused_source"), F.lit(refused[1]).alias("refused_target"), F.count("*").alias("rows")
    )
