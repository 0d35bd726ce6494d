"""The change feed and event files as data sources, and plain parquet targets."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from changeflow.operators.merge import MergeSpec, merge, merge_prepared
from changeflow.schema import EVENT_SCHEMA
from changeflow.sinks import parquet
from changeflow.sinks.files import Folder
from changeflow.sinks.parquet import AppendFolder, StateFolder
from changeflow.sources import event_source
from changeflow.sources.event_source import event_batches, read_event_batch
from changeflow.sources.feed_source import FeedFolder, cut, read_feed, write_feed
from changeflow.streaming.micro_batches import EventBatches, FeedTransfer, drain
from changeflow.streaming.transfer import SourceMismatch

FEED = "k bigint, v string, at timestamp, d decimal(9,2), xs array<int>, _change_type string, _commit_version bigint, _commit_timestamp timestamp"


def feed(spark, versions, per=20):
    r = random.Random(3)
    rows = [
        (r.randrange(30), f"v{v}-{i}" if i % 7 else None, None, None, [i, v], r.choice(["insert", "update_preimage", "update_postimage", "delete", None]), v, None)
        for v in versions
        for i in range(per)
    ]
    df = spark.createDataFrame(rows, FEED)
    at = F.timestamp_micros(F.col("_commit_version") * 86_400_000_001)
    return df.withColumn("at", at).withColumn("_commit_timestamp", at).withColumn("d", (F.col("k") / 7).cast("decimal(9,2)"))


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    b = b.select(*a.columns)
    assert a.dtypes == b.dtypes
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_a_feed_reads_as_it_was_written(spark, folder):
    f = feed(spark, [0, 1, 2, 5, 9])
    write_feed(f.where("_commit_version < 5"), folder)
    write_feed(f.where("_commit_version >= 5"), folder)
    same(read_feed(spark, folder), f)
    same(read_feed(spark, folder, startingVersion=2, endingVersion=5), f.where("_commit_version BETWEEN 2 AND 5"))
    same(read_feed(spark, folder, splitBytes=500), f)
    some = read_feed(spark, folder, "k bigint, _commit_version bigint").where("_commit_version > 1 AND _commit_version <= 5 AND k < 9")
    same(some, f.where("_commit_version > 1 AND _commit_version <= 5 AND k < 9").select("k", "_commit_version"))
    with pytest.raises(ValueError, match="there already"):
        write_feed(f.where("_commit_version = 5"), folder)
    assert FeedFolder(folder).latest() == 9


def test_filters_on_versions_open_no_other_commit(spark, folder):
    write_feed(feed(spark, range(6)), folder)
    for path in glob.glob(f"{folder}/_commit_version=[0145]/*.parquet"):
        with open(path, "wb") as f:
            f.write(b"not parquet")
    schema = "k bigint, _commit_version bigint"
    assert read_feed(spark, folder, schema).where("_commit_version >= 2 AND _commit_version < 4").count() == 40
    assert read_feed(spark, folder, schema).where("_commit_version = 3").count() == 20


def test_commits_without_a_marker_and_later_ones_wait(spark, folder):
    write_feed(feed(spark, range(4)), folder)
    Folder(spark, f"{folder}/_commit_version=2").remove("_SUCCESS")
    assert {r[0] for r in read_feed(spark, folder).select("_commit_version").distinct().collect()} == {0, 1}
    assert FeedFolder(folder).latest() == 1
    write_feed(feed(spark, [2], per=3), folder)  # what the lost job left is replaced
    assert read_feed(spark, folder).where("_commit_version = 2").count() == 3 and FeedFolder(folder).latest() == 3


def test_columns_that_come_later_are_null_before(spark, folder):
    write_feed(feed(spark, [0]).drop("v", "xs"), folder)
    write_feed(feed(spark, [1]), folder)
    got = read_feed(spark, folder)
    assert got.where("_commit_version = 0 AND v IS NULL AND xs IS NULL").count() == 20
    assert got.where("_commit_version = 1 AND xs IS NOT NULL").count() == 20


def test_splits_cut_large_files_and_join_small_ones(spark, folder):
    write_feed(feed(spark, range(8)), folder)
    commits = list(FeedFolder(folder).commits(None, None))
    assert [c.version for c in commits] == list(range(8)) and {c.rows for c in commits} == {20}
    assert len(cut(commits, 1 << 30)) == 1
    small = cut(commits, 1_000)
    for c in commits:
        for path, size in c.files:
            ranges = sorted(p[1:3] for s in small for p in s.parts if p[0] == path)
            assert ranges[0][0] == 0 and ranges[-1][1] == size and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:], strict=False))


class Recorded(AppendFolder):
    fail_at = None

    def apply(self, changes, number):
        if number == self.fail_at:
            raise RuntimeError("lost")
        super().apply(changes.withColumn("version", F.col("_commit_version")).withColumn("_change_type", F.lit(None).cast("string")), number)


def batches(target):
    rows = target.read().groupBy("batch").agg(F.sort_array(F.collect_set("version")).alias("v")).collect()
    return {r.batch: r.v for r in rows}


def test_micro_batches_are_whole_commits_over_restarts(spark, folder):
    write_feed(feed(spark, range(10)), f"{folder}/f")
    target = Recorded(spark, f"{folder}/t")
    run = lambda **o: drain(FeedTransfer(spark, f"{folder}/f", target, max_versions=3, **o).start(f"{folder}/c"))
    run(end_version=3)
    assert batches(target) == {0: [0, 1, 2], 1: [3]}
    run()
    assert batches(target) == {0: [0, 1, 2], 1: [3], 2: [4, 5, 6], 3: [7, 8, 9]}
    write_feed(feed(spark, [12, 13, 14, 15]), f"{folder}/f")
    target.fail_at = 5
    with pytest.raises(Exception, match="lost"):
        run()
    target.fail_at = None
    run()
    assert batches(target) == {0: [0, 1, 2], 1: [3], 2: [4, 5, 6], 3: [7, 8, 9], 4: [12, 13, 14], 5: [15]}
    all_rows = feed(spark, range(10)).unionByName(feed(spark, [12, 13, 14, 15]))
    assert target.read().count() == all_rows.where("_change_type IS NULL OR _change_type <> 'update_preimage'").count()


def test_row_caps_take_one_commit_at_least(spark, folder):
    write_feed(feed(spark, range(4)), f"{folder}/f")
    write_feed(feed(spark, [4], per=100), f"{folder}/f")
    write_feed(feed(spark, [5, 6]), f"{folder}/f")
    target = Recorded(spark, f"{folder}/t")
    drain(FeedTransfer(spark, f"{folder}/f", target, max_rows=45).start(f"{folder}/c"))
    assert batches(target) == {0: [0, 1], 1: [2, 3], 2: [4], 3: [5, 6]}


def test_a_stream_may_begin_at_a_version_or_behind_all(spark, folder):
    write_feed(feed(spark, range(4)), f"{folder}/f")
    target = Recorded(spark, f"{folder}/t")
    drain(FeedTransfer(spark, f"{folder}/f", target, start_version=2).start(f"{folder}/c"))
    assert batches(target) == {0: [2, 3]}
    late = Recorded(spark, f"{folder}/late")
    query = FeedTransfer(spark, f"{folder}/f", late, start_version="latest").start(f"{folder}/d")
    query.processAllAvailable()
    write_feed(feed(spark, [4]), f"{folder}/f")
    drain(query)
    assert sum(batches(late).values(), []) == [4]
    with pytest.raises(SourceMismatch):
        FeedTransfer(spark, f"{folder}/other", target).start(f"{folder}/c")


KEY = MergeSpec(("k",), dedupe_order_by="at", tie_breakers=("v",))


def test_state_folder_equals_the_merge(spark, folder):
    f = feed(spark, range(8)).where("_change_type <> 'update_preimage' OR _change_type IS NULL")
    target, state = StateFolder(spark, f"{folder}/t", KEY, 5), None
    with pytest.raises(FileNotFoundError):
        target.read()
    for a in (0, 3, 6):
        part = f.where(f"_commit_version BETWEEN {a} AND {a + 2}")
        target.apply(part, a)
        target.apply(part, a)  # a batch that comes again
        state = merge(state, part, KEY)
        state = spark.createDataFrame(state.collect(), state.schema)
        same(target.read(), state)
    assert not os.path.exists(f"{folder}/t.next") and os.listdir(f"{folder}/t.staged") == []


def test_state_folder_rewrites_touched_buckets_and_drops_emptied_ones(spark, folder):
    spec = MergeSpec(("k",))
    target = StateFolder(spark, folder, spec, 8)
    target.apply(spark.range(40).selectExpr("id AS k", "id * 2 AS v"))
    before = {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{folder}/bucket=*/*.parquet")}
    (b,) = [r[0] for r in spark.read.parquet(folder).where("k = 7").select("bucket").collect()]
    target.apply(spark.createDataFrame([(7, -1, "update_postimage")], "k bigint, v bigint, _change_type string"))
    after = {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{folder}/bucket=*/*.parquet")}
    assert {p for p in before if before[p] != after.get(p)} == {p for p in before if f"bucket={b}/" in p}
    gone = spark.read.parquet(folder).where(f"bucket = {b}").selectExpr("k", "v", "'delete' AS _change_type")
    target.apply(spark.createDataFrame(gone.collect(), gone.schema))
    assert not os.path.exists(f"{folder}/bucket={b}") and target.read().where("k = 7").count() == 0
    target.apply(spark.createDataFrame([(7, 5, "w")], "k bigint, v bigint, extra string"))
    assert target.read().where("extra IS NOT NULL").collect()[0].asDict() == {"k": 7, "v": 5, "extra": "w"}
    target.apply(target.read().limit(0))


def events(spark, path, sizes, first=0):
    n = first
    for k, size in enumerate(sizes):
        e = spark.range(n, n + size).selectExpr(
            "'0' AS partition_id", "cast(id AS string) AS offset", "id AS sequence_number", "timestamp_micros(id) AS enqueued_time", "'b' AS body", "cast(NULL AS string) AS properties"
        )
        e.coalesce(1).sortWithinPartitions("sequence_number").write.mode("append").parquet(path)
        n += size


@pytest.mark.parametrize(("sizes", "most"), [([10, 0, 25, 1, 7], 4), ([3, 3, 3], 100), ([50], 1), ([5, 5], 5)])
def test_event_batches_hold_consecutive_events(spark, folder, sizes, most):
    events(spark, folder, sizes)
    plan = event_batches(spark, folder, most)
    rows = read_event_batch(plan, folder).select("batch", "sequence_number").collect()
    assert sorted((r.sequence_number, r.batch) for r in rows) == [(i, i // most) for i in range(sum(sizes))]
    last = (sum(sizes) - 1) // most
    assert sorted(r.sequence_number for r in read_event_batch(plan, folder, last).collect()) == list(range(last * most, sum(sizes)))


def test_odd_event_folders(spark, folder):
    assert event_batches(spark, f"{folder}/none").count() == 0
    with pytest.raises(ValueError):
        event_batches(spark, folder, 0)
    with pytest.raises(ValueError):
        event_batches(spark, folder, order="size")


class Sequences(AppendFolder):
    fail_at = None

    def apply(self, changes, number):
        if number == self.fail_at:
            raise RuntimeError("lost")
        super().apply(changes, number)


def test_event_streams_keep_their_limit_over_restarts(spark, folder):
    events(spark, f"{folder}/log", [10, 4])
    target = Sequences(spark, f"{folder}/t")
    run = lambda: drain(EventBatches(spark, f"{folder}/log", target, 6).start(f"{folder}/c"))
    target.fail_at = 1
    with pytest.raises(Exception, match="lost"):
        run()
    target.fail_at = None
    run()
    events(spark, f"{folder}/log", [9], first=14)
    run()
    got = sorted((r.batch, r.sequence_number) for r in target.read().collect())
    assert got == [*((i // 6, i) for i in range(14)), *((3 + (i - 14) // 6, i) for i in range(14, 23))]


def test_a_planned_read_opens_files_once_and_has_several_tasks(spark, folder, monkeypatch):
    spark.range(6_000).selectExpr(
        "'0' AS partition_id", "cast(id AS string) AS offset", "id AS sequence_number", "timestamp_micros(id) AS enqueued_time", "'b' AS body", "cast(NULL AS string) AS properties"
    ).repartitionByRange(3, "sequence_number").sortWithinPartitions("sequence_number").write.option("parquet.block.size", 1_024).parquet(folder)
    plan = event_batches(spark, folder, 70, order="name")
    parts = plan.orderBy("file", "row_group", "first_row").collect()
    opened = []
    monkeypatch.setattr(event_source.pq, "ParquetFile", lambda f, real=event_source.pq.ParquetFile, **o: opened.append(f) or real(f, **o))
    names = [f.name for f in EVENT_SCHEMA]
    wanted = event_source.to_arrow_schema(EVENT_SCHEMA)
    rows = [n for _, b in event_source._slices(folder, [tuple(p)[1:] for p in parts], wanted) for n in b.column(names.index("sequence_number")).to_pylist()]
    assert rows == list(range(6_000)) and len(opened) == 3 < len({(p.file, p.row_group) for p in parts})
    monkeypatch.undo()
    monkeypatch.setattr(event_source, "SPLIT_BYTES", 4_096, raising=False)
    read = read_event_batch(plan, folder).select("batch", "sequence_number", F.spark_partition_id().alias("task")).collect()
    assert sorted((r.sequence_number, r.batch) for r in read) == [(i, i // 70) for i in range(6_000)]
    assert len({r.task for r in read}) > 3


def test_a_stream_behind_takes_several_batches_at_once(spark, folder):
    events(spark, f"{folder}/log", [10, 9, 16])
    target = AppendFolder(spark, f"{folder}/t")
    run = lambda together=3, c="c": drain(EventBatches(spark, f"{folder}/log", target, 4, together=together).start(f"{folder}/{c}"))
    run()
    events(spark, f"{folder}/log", [9, 2], first=35)
    run()
    got = sorted((r.batch, r.sequence_number) for r in target.read().collect())
    assert got == [*((i // 4, i) for i in range(35)), *((9 + (i - 35) // 4, i) for i in range(35, 46))]
    assert len(glob.glob(f"{folder}/c/commits/[0-9]*")) == 3 + 1
    assert all(len(glob.glob(f"{folder}/t/batch={b}")) == 1 for b in range(12))
    with pytest.raises(Exception, match="numbered"):  # the micro-batches of this stream have other numbers
        run(together=1)


def test_a_batch_is_broadcast_by_its_measured_size(spark, folder, monkeypatch):
    plans = []

    def spied(*args):
        merged = merge_prepared(*args)
        plans.append(merged._jdf.queryExecution().executedPlan().toString())
        return merged

    monkeypatch.setattr(parquet, "merge_prepared", spied)
    target = StateFolder(spark, folder, MergeSpec(("k",)), 4)
    target.apply(spark.range(2_000).selectExpr("id AS k", "repeat('a', 40) AS v"))
    for limit in (8 << 20, 10_000):
        monkeypatch.setattr(parquet, "BROADCAST_BYTES", limit, raising=False)
        target.apply(spark.range(500, 2_500).selectExpr("id AS k", "repeat('b', 40) AS v"))
    assert "BroadcastHashJoin" in plans[1] and "BroadcastHashJoin" not in plans[2]
    assert target.read().groupBy("v").count().where("v LIKE 'b%'").first()["count"] == 2_000 and target.read().count() == 2_500
