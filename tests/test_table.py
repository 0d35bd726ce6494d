"""The target table: modes, buckets, crashes, feeds."""

import json

import pytest
from pyspark.sql import functions as F

from changeflow.operators.maintenance import compacted, list_files, stale_files, zorder_cluster
from changeflow.operators.merge import MergeSpec, merge
from changeflow.operators.runs import run_totals
from changeflow.sinks import table as tables
from changeflow.sinks.table import VersionedTable, file_name
from changeflow.sources.commits import commit_rows, history, live_files, read_log
from test_merge import KEY, S, random_feed, rows, source


@pytest.fixture
def table(spark, folder):
    return VersionedTable(spark, f"{folder}/t", 4)


def test_append_and_overwrite(spark, table):
    s = source(spark, (1, 1, "insert", 0), (2, 2, "delete", 0), (3, 3, None, 0))
    assert table.apply(s, "append").appended == 2
    table.apply(s, "append")
    assert rows(table.read()) == [(1, 1), (1, 1), (3, 3), (3, 3)]
    assert len(table.snapshot().extents) == 1  # one run of appends, one entry
    out = table.apply(source(spark, (9, 9, "insert", 1)), "overwrite")
    assert (out.source_rows, out.appended, out.target_version) == (1, 1, 2)
    assert rows(table.read()) == [(9, 9)]
    assert rows(table.read(0)) == [(1, 1), (3, 3)]


def test_edge_batches(spark, table):
    table.apply(source(spark, (1, 1, "insert", 0)), "append")
    gone = source(spark, (1, 1, "delete", 1))
    assert table.apply(gone, "append").target_version == 0
    assert table.apply(gone.limit(0), "merge", KEY).target_version == 0
    assert table.apply(gone, "overwrite").target_version == 1
    assert rows(table.read()) == []
    assert rows(table.read_feed(1, 1).select("k", "_change_type")) == [(1, "delete")]


def test_append_does_not_evolve(spark, table):
    table.apply(source(spark, (1, 1, "insert", 0)), "append")
    with pytest.raises(ValueError, match="columns differ"):
        table.apply(spark.createDataFrame([(1, 1, 1)], "k bigint, v bigint, z int"), "append")
    with pytest.raises(ValueError, match="unknown sink mode"):
        table.apply(source(spark, (1, 1, "insert", 0)), "replace")
    with pytest.raises(ValueError, match="MergeSpec"):
        table.apply(source(spark, (1, 1, "insert", 0)), "merge")


@pytest.mark.parametrize("limit", [tables.BROADCAST_BYTES, 0])
def test_merges_equal_the_operator(spark, table, monkeypatch, limit):
    """Both with and without broadcasting, and mixed with appends to the bucketed table."""
    monkeypatch.setattr(tables, "BROADCAST_BYTES", limit)
    state = None
    for seed in (1, 2, 3):
        feed = random_feed(spark, seed, versions=3)
        out = table.apply(feed, "merge", KEY)
        before, state = state, merge(state, feed, KEY).cache()
        assert rows(table.read()) == rows(state)
        kept = 0 if before is None else before.count()
        assert kept + out.inserts - out.deletes == state.count()
    assert table.snapshot().keys == ("k",)
    table.apply(source(spark, (500, 1, "insert", 0)), "append")
    feed = random_feed(spark, 4, versions=2)
    table.apply(feed, "merge", KEY)
    appended = spark.createDataFrame([(500, 1)], "k bigint, v bigint")
    assert rows(table.read()) == rows(merge(state.unionByName(appended), feed, KEY))
    assert all(e.bucket is not None for e in table.snapshot().extents)


def test_only_touched_buckets_are_rewritten_and_an_emptied_one_goes(spark, table):
    table.apply(source(spark, *[(k, k, "insert", 0) for k in range(40)]), "merge", KEY)
    first = {e.bucket: e for e in table.snapshot().extents}
    table.apply(source(spark, (7, 70, "insert", 1)), "merge", KEY)
    second = {e.bucket: e for e in table.snapshot().extents}
    assert sum(second[b] != first[b] for b in first) == 1
    assert rows(table.read()) == sorted([(k, 70 if k == 7 else k) for k in range(40)], key=repr)
    bucket = next(b for b in first if second[b] != first[b])
    members = [r.k for r in table._rows(table.snapshot().schema, [second[bucket]]).collect()]
    table.apply(source(spark, *[(k, 0, "delete", 2) for k in members]), "merge", KEY)
    assert bucket not in {e.bucket for e in table.snapshot().extents}
    assert table.read().count() == 40 - len(members)


def test_many_small_files_are_gathered(spark, table, monkeypatch):
    monkeypatch.setattr(tables, "FEW_FILES", 1)
    for i in range(4):
        table.apply(source(spark, *[(k + 10 * i, i, "insert", 0) for k in range(20)]), "merge", KEY)
    assert table.read().count() == 50
    assert max(e.files for e in table.snapshot().extents) <= 2


def test_a_merge_with_other_keys_buckets_again(spark, table):
    table.apply(source(spark, (1, 10, "insert", 0), (2, 20, "insert", 0)), "merge", KEY)
    table.apply(source(spark, (5, 10, "insert", 1)), "merge", MergeSpec(("v",)))
    assert rows(table.read()) == [(2, 20), (5, 10)]


def test_evolution_reads_old_files_as_null(spark, table):
    table.apply(source(spark, *[(k, k, "insert", 0) for k in range(8)]), "merge", KEY)
    wide = spark.createDataFrame([(1, 5, "x")], "k bigint, v bigint, note string")
    table.apply(wide, "merge", KEY)
    got = {r.k: r.note for r in table.read().collect()}
    assert got[1] == "x" and got[0] is None and len(got) == 8


def test_transform_runs_before_the_dedupe(spark, table):
    s = source(spark, (1, 1, "insert", 0), (2, 9, "insert", 1))
    spec = MergeSpec(("k",), transform_sql="SELECT 7L AS k, v, _commit_version FROM __src")
    table.apply(s, "merge", spec)
    assert rows(table.read()) == [(7, 9)]


def test_the_emitted_feed_leads_from_version_to_version(spark, table):
    table.apply(source(spark, (1, 1, "insert", 0), (2, 2, "insert", 0), (3, 3, "insert", 0)), "append")
    table.apply(source(spark, (1, 5, "insert", 1), (2, 0, "delete", 1), (4, 4, "insert", 1)), "merge", KEY)
    table.apply(source(spark, (8, 8, "insert", 1)), "overwrite")
    feed = table.read_feed(0, 2)
    assert rows(feed.where("_commit_version = 1").select("k", "v", "_change_type")) == [
        (1, 1, "update_preimage"), (1, 5, "update_postimage"), (2, 2, "delete"), (4, 4, "insert")
    ]
    for v in (1, 2):
        changes = feed.where(f"_commit_version = {v} AND _change_type <> 'update_preimage'")
        assert rows(merge(table.read(v - 1), changes, KEY)) == rows(table.read(v))
    with pytest.raises(ValueError, match="before start"):
        table.read_feed(2, 1)


def test_a_crash_before_the_commit_leaves_the_old_state(spark, table, monkeypatch):
    table.apply(source(spark, *[(k, k, "insert", 0) for k in range(10)]), "merge", KEY)
    change = source(spark, *[(k, 100, "insert", 1) for k in range(5)])
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            table.apply(change, "merge", KEY)
    assert rows(table.read()) == sorted([(k, k) for k in range(10)], key=repr)
    table.apply(change, "merge", KEY)
    assert sum(r.v == 100 for r in table.read().collect()) == 5
    assert table.read().count() == 10


def test_two_writers_cannot_commit_the_same_version(spark, table):
    table.apply(source(spark, (1, 1, "insert", 0)), "append")
    with pytest.raises(FileExistsError, match="another writer"):
        table.log.create(file_name(0), "{}\n")


def test_the_log_can_be_read_as_a_commit_log(spark, table):
    table.apply(source(spark, (1, 1, "insert", 0), (2, 2, "insert", 0)), "append", info={"timestamp": 0})
    table.apply(source(spark, (1, 5, "insert", 1)), "merge", KEY)
    log = read_log(spark, table.log_path)
    assert rows(commit_rows(log)) == [(0, 2), (1, 2)]
    assert history(log).collect()[1][1:] == ("1970-01-01 00:00:00 UTC", "APPEND")
    live = live_files(log)
    assert {r.path.split("/")[1] for r in live.collect()} == {"_commit_version=1"}
    totals = run_totals(table.run_log()).first()
    assert (totals.batches, totals.inserts, totals.updates, totals.appended) == (2, 0, 1, 2)
    d = table.describe().first()
    assert (d.version, d.estimated_rows, d.partition_columns, d.feed_enabled) == (1, 2, ["k"], True)


def test_stale_folders_are_reported(spark, table):
    table.apply(source(spark, (1, 1, "insert", 0)), "append")
    table.apply(source(spark, (2, 2, "insert", 0)), "overwrite")
    files = list_files(spark, f"{table.path}/data")
    folder = files.selectExpr(
        "regexp_extract(path, '(data/.*)/[^/]*$', 1) AS path", "age_hours + 1000 AS age_hours"
    )
    stale = stale_files(folder, live_files(read_log(spark, table.log_path)))
    assert {r.path for r in stale.collect()} == {"data/_commit_version=0/_part=state"}
    with pytest.raises(ValueError, match="safe"):
        stale_files(folder, folder, 24)
    assert stale_files(folder, folder, 24, enforce_retention=False).count() == 0


def test_rewrites_keep_the_rows(spark, table):
    for i in range(5):
        table.apply(spark.range(100 * i, 100 * i + 100, 1, 4).selectExpr("id AS k", "id % 7 AS v"), "append")
    before, files = rows(table.read()), table.describe().first().num_files
    table.rewrite(lambda df: compacted(df, 1_000, 1_000))
    assert rows(table.read()) == before
    assert table.describe().first().num_files == 1 < files
    table.rewrite(lambda df: zorder_cluster(df, ["k", "v"], 4), "ZORDER")
    assert rows(table.read()) == before
    assert table.read_feed(5, 6).count() == 0
    operations = [r.operation for r in history(read_log(spark, table.log_path)).collect()]
    assert operations[:3] == ["ZORDER", "OPTIMIZE", "APPEND"]


def test_progress_is_part_of_the_commit(spark, table):
    table.apply(source(spark, (1, 1, "insert", 0)), "append", job="a", progress={"version": 3})
    table.apply(source(spark, (1, 1, "delete", 0)), "append", job="b", progress={"version": 9})
    assert table.snapshot().progress == {"a": {"version": 3}, "b": {"version": 9}}
    actions = [json.loads(x) for x in table.log.read(file_name(1)).splitlines()]
    assert actions[0]["commitInfo"]["operation"] == "SKIP"


def test_feeds_must_be_dense(spark, table):
    feed = spark.createDataFrame([(1, 1, "insert", 0), (1, 1, "insert", 5)], S)
    with pytest.raises(ValueError, match="not a change feed"):
        table.import_feed(feed)
    with pytest.raises(ValueError, match="gaps"):
        table.import_feed(feed.withColumn("_commit_timestamp", F.current_timestamp()))


def test_keys_of_another_type_find_their_bucket(spark, table):
    old = spark.createDataFrame([(k, k) for k in range(30)], "k int, v bigint")
    table.apply(old, "merge", KEY)
    table.apply(source(spark, *[(k, 100, "insert", 1) for k in range(40)]), "merge", KEY)
    assert rows(table.read()) == sorted([(k, 100) for k in range(40)], key=repr)
    table.apply(spark.createDataFrame([("3", 7), ("50", 7)], "k string, v bigint"), "merge", KEY)
    got = {r.k: r.v for r in table.read().collect()}
    assert (got[3], got[50], len(got)) == (7, 7, 41)
    with pytest.raises(ValueError, match="collation"):
        loose = spark.sql("SELECT 'a' COLLATE UTF8_LCASE AS k, 1L AS v")
        VersionedTable(spark, f"{table.path}2").apply(loose, "merge", KEY)


def test_null_keys_are_inserted_again_by_each_batch(spark, table):
    for i in range(2):
        table.apply(source(spark, (None, i, "insert", i), (1, i, "insert", i)), "merge", KEY)
    assert rows(table.read()) == sorted([(None, 0), (None, 1), (1, 1)], key=repr)
