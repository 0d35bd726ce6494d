"""Transfers: resume, guards, chunks, replay, event logs."""

import json

import pytest
from pyspark.sql import functions as F

from changeflow.operators.merge import MergeSpec, merge
from changeflow.sinks.files import Folder
from changeflow.sinks.table import VersionedTable
from changeflow.sources import events as ev
from changeflow.sources import feeds
from changeflow.streaming import tunables as tune
from changeflow.streaming.transfer import (
    EventSpec,
    EventTransfer,
    Group,
    SourceMismatch,
    Transfer,
    TransferSpec,
    log_signature,
)
from test_merge import KEY, random_feed, rows


@pytest.fixture
def feed(spark, folder):
    f = random_feed(spark, 11).withColumn("_commit_timestamp", F.timestamp_seconds("_commit_version"))
    VersionedTable(spark, f"{folder}/s").import_feed(f)
    return f


def transfer(spark, folder, mode="append", **options):
    return Transfer(spark, TransferSpec(f"{folder}/s", f"{folder}/t", mode, buckets=4, **options))


def live(feed, last=None, first=0):
    f = feed.where("_change_type <> 'delete'").where(f"_commit_version >= {first}")
    f = f if last is None else f.where(f"_commit_version <= {last}")
    return rows(f.select("k", "v"))


def test_once_applies_one_group(spark, folder, feed):
    t = transfer(spark, folder, max_versions=5)
    assert len(t.run(once=True)) == 1
    assert rows(t.target.read()) == live(feed, 4)
    assert len(t.run()) == 2 and t.run() == []
    assert rows(t.target.read()) == live(feed)


def test_end_and_start_version(spark, folder, feed):
    transfer(spark, folder, end_version=3).run()
    t = transfer(spark, folder, start_version=10)
    t.run()
    assert t.progress()[0] == 11
    assert rows(t.target.read()) == sorted(live(feed, 3) + live(feed, first=10), key=repr)


def test_progress_of_another_source_is_refused(spark, folder, feed):
    transfer(spark, folder, end_version=3).run()
    VersionedTable(spark, f"{folder}/s2").import_feed(feed)
    other = TransferSpec(f"{folder}/s2", f"{folder}/t", "append")
    with pytest.raises(SourceMismatch):
        Transfer(spark, other).run()
    moved = TransferSpec(f"{folder}/s2", f"{folder}/t", "append", start_version=11)
    assert len(Transfer(spark, moved).run()) == 1


def test_progress_without_a_source_is_adopted(spark, folder, feed):
    t = transfer(spark, folder)
    first = feed.where("_commit_version <= 8")
    t.target.apply(first, "append", job="default", progress={"version": 8})
    t.run()
    assert rows(t.target.read()) == live(feed)


def test_row_cap_groups(spark, folder, feed):
    t = transfer(spark, folder, max_rows=20)
    assert list(t.groups(-1, 11)) == [Group(v, v + 1) for v in range(0, 12, 2)]
    t = transfer(spark, folder, max_rows=3)
    assert list(t.groups(8, 11)) == [Group(9, 9), Group(10, 10), Group(11, 11)]


@pytest.mark.parametrize("mode,spec", [("append", None), ("merge", KEY)])
def test_a_split_commit_resumes_at_its_chunk(spark, folder, feed, mode, spec, monkeypatch):
    t = transfer(spark, folder, mode, merge=spec, adaptive=True)
    values = {"split_threshold_rows": 7, "chunk_target_rows": 3, "merge_threshold_rows": 1}
    t.tunables.create("tunables-0000000000.json", json.dumps(values))
    apply, calls = VersionedTable.apply, []

    def fails_in_the_second_version(self, *args, **options):
        calls.append(args[-1]["range"])
        if len(calls) == 5:
            raise RuntimeError("lost")
        return apply(self, *args, **options)

    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "apply", fails_in_the_second_version)
        with pytest.raises(RuntimeError):
            t.run()
    assert calls[3:] == ["v1[chunk 1/3]", "v1[chunk 2/3]"]
    again = transfer(spark, folder, mode, merge=spec, adaptive=True)
    assert again.progress() == (0, 1, 3)
    # The stored number of chunks holds, whatever the thresholds say by now.
    again.tunables.create("tunables-0000000001.json", json.dumps({**values, "chunk_target_rows": 8}))
    again.run()
    want = live(feed) if mode == "append" else rows(merge(None, feed, KEY))
    assert rows(again.target.read()) == want


def test_streams_survive_a_replayed_batch(spark, folder, feed):
    t = transfer(spark, folder, max_versions=4)
    t.start(f"{folder}/c").awaitTermination()
    assert rows(t.target.read()) == live(feed)
    Folder(spark, f"{folder}/c/commits").remove("2")
    Folder(spark, f"{folder}/c/commits").remove(".2.crc")
    t.start(f"{folder}/c").awaitTermination()
    assert rows(t.target.read()) == live(feed)


def test_a_stream_picks_up_new_commits(spark, folder, feed):
    source = VersionedTable(spark, f"{folder}/u")
    source.apply(spark.createDataFrame([(1, 1), (2, 2)], "k bigint, v bigint"), "append")
    spec = TransferSpec(source.path, f"{folder}/t", "merge", KEY, buckets=4)
    Transfer(spark, spec).start(f"{folder}/c").awaitTermination()
    changes = spark.createDataFrame([(1, 9, "delete"), (3, 3, "insert")], "k bigint, v bigint, _change_type string")
    source.apply(changes, "merge", KEY)
    Transfer(spark, spec).start(f"{folder}/c").awaitTermination()
    assert rows(VersionedTable(spark, spec.target).read()) == [(2, 2), (3, 3)]


def test_a_checkpoint_serves_one_pair_of_tables(spark, folder, feed):
    transfer(spark, folder).start(f"{folder}/c").awaitTermination()
    other = Transfer(spark, TransferSpec(f"{folder}/s", f"{folder}/x", "append"))
    with pytest.raises(SourceMismatch):
        other.start(f"{folder}/c")


def test_an_error_in_a_batch_stops_the_stream(spark, folder, feed):
    t = transfer(spark, folder, "merge", merge=MergeSpec(("nokey",)))
    with pytest.raises(Exception, match="nokey"):
        t.start(f"{folder}/c").awaitTermination()


def test_a_running_stream_drains_and_can_be_stopped(spark, folder, feed):
    query = transfer(spark, folder).start(f"{folder}/c", interval="0 seconds")
    query.processAllAvailable()
    query.stop()
    assert rows(VersionedTable(spark, f"{folder}/t").read()) == live(feed)


def test_following_ends_at_the_end_version(spark, folder, feed):
    t = transfer(spark, folder, end_version=5, max_versions=4)
    t.follow(f"{folder}/c", interval="0 seconds")
    assert rows(t.target.read()) == live(feed, 5)


def test_tunables(spark, folder):
    place = Folder(spark, f"{folder}/tunables")
    assert tune.load(place).chunk_target_rows == 50_000
    tune.update(place, chunk_target_rows=5)
    new = tune.update(place, split_threshold_rows=10**9)
    assert (new.chunk_target_rows, new.split_threshold_rows) == (1_000, 10_000_000)
    assert tune.load(place) == new


LOG = "partition_id string, offset string, sequence_number bigint, enqueued_time timestamp, body string, properties string"


def log(spark, *events):
    rows_ = [(p, str(n), n, None, json.dumps({"id": i}), None) for p, n, i in events]
    return spark.createDataFrame(rows_, LOG)


def event_transfer(spark, folder, mode="append", **options):
    options = {"initial_position": "earliest", **options}
    return EventTransfer(spark, EventSpec(log_signature("ns", "hub"), f"{folder}/t", mode, buckets=4, **options))


def test_event_offsets(spark, folder):
    t = event_transfer(spark, folder)
    t.apply(log(spark, ("0", 1, 1), ("0", 2, 2), ("1", 7, 3)), t.offsets())
    assert t.offsets() == {"0": 2, "1": 7}
    t.apply(log(spark, ("0", 2, 9), ("0", 3, 4)), t.offsets())
    assert t.offsets() == {"0": 3, "1": 7}
    assert sorted(r.sequence_number for r in t.target.read().collect()) == [1, 2, 3, 7]
    other = EventSpec(log_signature("ns", "other"), f"{folder}/t", "append")
    with pytest.raises(SourceMismatch):
        EventTransfer(spark, other).offsets()


def test_event_batches_are_applied_once(spark, folder):
    t = event_transfer(spark, folder)
    for _ in range(2):
        t.apply(log(spark, ("0", 1, 1)), {}, batch={"stream": "a", "number": 0})
    assert t.target.read().count() == 1


def test_latest_needs_a_start(spark, folder):
    t = event_transfer(spark, folder, initial_position="latest")
    with pytest.raises(ValueError, match="offsets at the start"):
        t.start(log(spark), f"{folder}/c")
    t.apply(log(spark, ("0", 1, 1), ("0", 2, 2), ("1", 1, 3)), {}, {"0": 1})
    assert sorted((r.partition_id, r.sequence_number) for r in t.target.read().collect()) == [("0", 2), ("1", 1)]


def test_event_stream_resumes_and_merges_on_a_json_key(spark, folder):
    sql = "SELECT json_get_int(body, 'id') AS id, sequence_number FROM __src"
    t = event_transfer(spark, folder, "merge", merge=MergeSpec(("id",), transform_sql=sql), partitions="0,1")
    schema = log(spark).schema
    for batch in ([("0", 1, 5), ("1", 1, 6), ("2", 1, 7)], [("0", 2, 5)]):
        log(spark, *batch).write.mode("append").parquet(f"{folder}/e")
        stream = ev.stream_event_files(spark, f"{folder}/e", schema, 1)
        t.start(stream, f"{folder}/c").awaitTermination()
    assert rows(t.target.read()) == [(5, 2), (6, 1)]
    assert t.offsets() == {"0": 2, "1": 1}


@pytest.mark.parametrize("inline", [32, 0])
def test_offsets_inline_or_joined(spark, monkeypatch, inline):
    monkeypatch.setattr(ev, "INLINE_PARTITIONS", inline)
    e = log(spark, *[(str(p), n, n) for p in range(4) for n in range(5)])
    known = spark.createDataFrame([("0", 2), ("1", 4)], "partition_id string, sequence_number bigint")
    for limit in (100, 1):
        monkeypatch.setattr(ev, "BROADCAST_PARTITIONS", limit)
        got = ev.resume_events(e, known, "oldest")
        assert got.columns == e.columns
        assert {r[0]: r[1] for r in got.groupBy("partition_id").agg(F.count("*")).collect()} == {"0": 2, "2": 5, "3": 5}
    assert ev.resume_events(e, {"0": 3, "3": 4}, "earliest").count() == 11


def test_position_words():
    assert [ev.initial_position(w) for w in ("", " Newest", "oldest", "BEGINNING")] == ["latest", "latest", "earliest", "earliest"]
    with pytest.raises(ValueError):
        ev.initial_position("middle")


def test_a_delta_source_is_followed_by_its_log(spark, folder, feed, monkeypatch):
    """The connector is not here: its read is replaced, the log and the rest are as they would be."""
    log = Folder(spark, f"{folder}/d/_delta_log")
    for v in range(12):
        log.create(f"{v:020d}.json", '{"add":{"path":"x","stats":"{\\"numRecords\\":8}"}}\n')
    log.create("00000000000000000009.checkpoint.parquet", "")
    monkeypatch.setattr(feeds, "read_delta_changes", lambda s, p, a, b: feed.where(f"_commit_version BETWEEN {a} AND {b}"))
    spec = TransferSpec(f"{folder}/d", f"{folder}/t", "merge", KEY, buckets=4, max_rows=40, source_format="delta")
    t = Transfer(spark, spec)
    assert list(t.groups(-1, 11))[:2] == [Group(0, 4), Group(5, 9)]
    t.start(f"{folder}/c").awaitTermination()
    assert t.progress()[0] == 11
    assert rows(t.target.read()) == rows(merge(None, feed.drop("_commit_timestamp"), KEY))
    with pytest.raises(ValueError, match="unknown source format"):
        Transfer(spark, TransferSpec("a", "b", "append", source_format="hudi"))
