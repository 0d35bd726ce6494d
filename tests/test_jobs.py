"""Jobs and commands end to end."""

import pytest
from pyspark.sql import functions as F

from changeflow import jobs
from changeflow.__main__ import main
from changeflow.operators.merge import MergeSpec
from changeflow.sinks.table import VersionedTable
from changeflow.streaming.transfer import Transfer, TransferSpec
from test_merge import KEY, rows, source


def test_create_table_writes_exactly_the_rows(spark, folder):
    table = jobs.create_table(spark, f"{folder}/w", 5, 3, 4)
    assert table.read().count() == 5
    assert table.current_version() == 2
    jobs.create_table(spark, f"{folder}/w", 7, 1, 4, overwrite=True)
    assert table.read().count() == 7
    jobs.create_table(spark, f"{folder}/z", 100, 2, 3, ["event_timestamp"])
    assert VersionedTable(spark, f"{folder}/z").read().count() == 100


def test_produced_events_can_be_merged(spark, folder):
    main(["produce", f"{folder}/p", "--batches", "2", "--rows", "500"])
    produced = VersionedTable(spark, f"{folder}/p")
    jobs.produce_events(produced, 1, 300, 0.5)
    events = produced.read()
    assert events.count() == 1_300
    assert {r[0] for r in events.select("batch_id").distinct().collect()} == {0, 1, 2}
    spec = TransferSpec(produced.path, f"{folder}/t", "merge", MergeSpec(("event_id",)), max_versions=1, buckets=4)
    done = Transfer(spark, spec).run()
    fresh = events.where("status <> 'updated'").count()
    assert sum(o.inserts for o in done) == fresh == VersionedTable(spark, spec.target).read().count()
    assert done[2].updates > 0


def test_optimize_reports_files(spark, folder):
    table = jobs.create_table(spark, f"{folder}/w", 400, 4, 4)
    before = rows(table.read())
    report = jobs.optimize(table)
    assert (report.starting_version, report.new_version, report.mode) == (3, 4, "compact")
    assert report.files_added == 1 < report.files_removed
    report = jobs.optimize(table, ["event_timestamp", "int64_01"], 5_000)
    assert report.files_added > 1 and rows(table.read()) == before


def test_zorder_cuts_runs_of_copies(spark, folder):
    table = VersionedTable(spark, f"{folder}/c")
    table.apply(spark.range(0, 40_000, 1, 8).select(F.lit(1).alias("a"), F.lit("same").alias("b")), "append")
    jobs.optimize(table, ["a", "b"], max(1, sum(e.bytes for e in table.snapshot().extents) // 4))
    per_file = table.read().groupBy(F.input_file_name()).count().collect()
    assert len(per_file) >= 4 and max(r[1] for r in per_file) < 20_000
    assert table.read().count() == 40_000


def test_merged_tables_keep_their_buckets(spark, folder):
    table = VersionedTable(spark, f"{folder}/t", 4)
    for i in range(3):
        table.apply(source(spark, *[(k, i, "insert", i) for k in range(10 * i, 50)]), "merge", KEY)
    before = rows(table.read())
    report = jobs.optimize(table)
    assert report.partitions_optimized == 4 and report.files_added == 4
    jobs.optimize(table, ["k", "v"])
    jobs.change_buckets(table, 7)
    assert rows(table.read()) == before
    assert len(table.snapshot().extents) == 7
    table.apply(source(spark, (1, 99, "insert", 9), (2, 0, "delete", 9)), "merge", KEY)
    assert rows(table.read()) == sorted([(k, 99 if k == 1 else v) for k, v in before if k != 2], key=repr)
    assert sum(e.last == table.current_version() for e in table.snapshot().extents) <= 2
    with pytest.raises(ValueError, match="merged"):
        jobs.change_buckets(jobs.create_table(spark, f"{folder}/w", 5, 1, 3), 2)


def test_stale_files(spark, folder):
    table = VersionedTable(spark, f"{folder}/t")
    table.apply(source(spark, (1, 1, "insert", 0)), "append")
    table.apply(source(spark, (2, 2, "insert", 0)), "overwrite")
    stale = jobs.stale_table_files(table, -1, enforce_retention=False)
    assert {"_commit_version=0" in r.path for r in stale.collect()} == {True}
    assert jobs.stale_table_files(table).count() == 0


def test_tracked_snapshots_give_a_feed(spark, folder):
    table = VersionedTable(spark, f"{folder}/t", 4)
    first = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    second = spark.createDataFrame([(1, "a"), (2, "x"), (4, "d")], "k int, v string")
    jobs.track_snapshot(table, first, ["k"])
    out = jobs.track_snapshot(table, second, ["k"])
    assert (out.inserts, out.updates, out.deletes) == (1, 1, 1)
    assert rows(table.read()) == rows(second)
    feed = table.read_feed(1, 1).select("k", "v", "_change_type")
    assert rows(feed) == [
        (2, "b", "update_preimage"), (2, "x", "update_postimage"), (3, "c", "delete"), (4, "d", "insert")
    ]


def test_preview_knows_whether_there_may_be_more(spark):
    df = spark.range(5)
    assert jobs.show_preview(df, 5).truncated and not jobs.show_preview(df, 6).truncated
    assert jobs.show_preview(df, 9, "id = 3").rows == [["3"]]


def test_commands(spark, folder, capsys):
    spark.range(3).selectExpr("id AS k", "'v' AS v").write.parquet(f"{folder}/snap")
    main(["track-snapshot", f"{folder}/s", "--snapshot", f"{folder}/snap", "--keys", "k"])
    main(["stream", "--source", f"{folder}/s", "--target", f"{folder}/t", "--sink-mode", "merge",
          "--merge-keys", "k", "--transform-sql", "SELECT k, upper(v) AS v FROM __src", "--once"])
    main(["stream", "--source", f"{folder}/s", "--target", f"{folder}/u", "--checkpoint", f"{folder}/c"])
    assert VersionedTable(spark, f"{folder}/u").read().count() == 3
    capsys.readouterr()
    main(["preview", f"{folder}/t", "--where", "k = 2"])
    assert capsys.readouterr().out == "k\tv\n2\tV\n"
    main(["create-table", f"{folder}/w", "--rows", "10", "--columns", "3"])
    main(["optimize", f"{folder}/w"])
    main(["inspect", f"{folder}/w"])
    main(["stale-files", f"{folder}/w"])
    out = capsys.readouterr().out
    assert "OptimizeReport(mode='compact'" in out and "event_timestamp" in out and "0 stale" in out
    with pytest.raises(SystemExit):
        main(["stream", "--source", "a", "--target", "b"])
