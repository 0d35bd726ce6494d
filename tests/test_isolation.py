"""Results that must not hang on slices, triggers, other jobs or a second evaluation."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from changeflow.__main__ import main
from changeflow.operators.merge import MergeSpec, merge
from changeflow.operators.transform import sql_transform
from changeflow.sinks.table import VersionedTable
from changeflow.sources import events as ev
from changeflow.streaming import transfer as tr


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("options", [{"max_rows": 25}, {"adaptive": True}, {}])
def test_groups_do_not_depend_on_slices_or_triggers(spark, folder, monkeypatch, options):
    f = spark.range(300).selectExpr("id AS k", "id AS v", "'insert' AS _change_type", "id % 43 AS _commit_version", "now() AS _commit_timestamp")
    VersionedTable(spark, f"{folder}/s").import_feed(f)
    spec = {"max_versions": 4, "buckets": 2, **options}
    ends, groups = [], []
    for i, size in enumerate((1_000, 5, 9)):
        monkeypatch.setattr(tr, "PLAN_SLICE", size)
        t = tr.Transfer(spark, tr.TransferSpec(f"{folder}/s", f"{folder}/t{i}", "overwrite", **spec))
        made, last = [], -1
        while last < t.cap():
            for g in t.groups(last, t.cap()):
                made.append(g)
                last = g.last
        groups.append(made)
        t.start(f"{folder}/c{i}").awaitTermination() if i else t.run()
        ends.append(rows(t.target.read()))
    assert groups[0] == groups[1] == groups[2] and ends[0] == ends[1] == ends[2] and ends[0]


def test_transforms_of_two_jobs_do_not_meet(spark):
    def job(n):
        df = spark.range(5).select(F.lit(n).alias("n"))
        return {r.n for r in sql_transform(df, "SELECT n FROM __src -- all\n;").collect()}

    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(job, range(24))) == [{n} for n in range(24)]
    assert not spark.catalog.tableExists("__src")


def test_transforms_may_begin_with_their_own_tables(spark):
    df = spark.range(4).withColumnRenamed("id", "k")
    out = sql_transform(df, "WITH a AS (SELECT max(k) AS m FROM __src) SELECT __src.k, a.m FROM __src CROSS JOIN a ORDER BY k")
    assert rows(out) == [(0, 3), (1, 3), (2, 3), (3, 3)]


@pytest.mark.parametrize(("mode", "arrow"), [("append", False), ("overwrite", False), ("merge", False), ("merge", True)])
def test_a_source_is_evaluated_once(spark, folder, mode, arrow):
    seen, ran = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def tell(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    def transform(batch):
        ran.add(batch.num_rows)
        return batch

    schema = "k bigint, v bigint, _change_type string"
    source = spark.range(100).selectExpr("id AS k", "id AS v", "if(id % 10 = 0, 'delete', 'insert') AS _change_type")
    source = source.mapInArrow(tell, schema)
    spec = MergeSpec(("k",), transform_arrow=transform if arrow else None, transform_schema=schema if arrow else None)
    table = VersionedTable(spark, f"{folder}/t", 2)
    out = table.apply(source, mode, spec if mode == "merge" else None)
    assert (seen.value, ran.value, out.source_rows) == (100, 100 if arrow else 0, 100)
    assert table.read().count() == 90 and (out.appended or out.inserts) == 90


def test_text_keys_meet_numbers(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k bigint, v string")
    source = spark.createDataFrame([("1", "x", 1), ("01", "y", 2), ("abc", "z", 3), (None, "w", 4), ("3", "u", 5)], "k string, v string, _tie int")
    got = merge(target, source, MergeSpec(("k",), tie_breakers=("_tie",))).select("k", "v")
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted((tuple(r) for r in got.collect()), key=key) == [(1, "y"), (2, "b"), (3, "u"), (None, "n"), (None, "w"), (None, "z")]


def test_repeated_headers_keep_the_last(spark):
    record = "partition int, offset bigint, timestamp timestamp, value binary, headers array<struct<key: string, value: binary>>"
    headers = [("a", bytearray(b"1")), ("b", bytearray(b"2")), ("a", bytearray(b"3"))]
    df = spark.createDataFrame([(0, 1, None, bytearray(b"x"), headers), (0, 2, None, None, None), (0, 3, None, None, [])], record)
    assert [r.properties for r in ev.from_kafka(df).collect()] == [{"b": "2", "a": "3"}, None, {}]


def test_resuming_is_built_without_a_job(spark):
    tracker, group = spark.sparkContext.statusTracker(), "resume"
    known = spark.range(10).selectExpr("cast(id AS string) AS partition_id", "id AS sequence_number")
    events = spark.range(40).selectExpr("cast(id % 20 AS string) AS partition_id", "id AS sequence_number")
    spark.sparkContext.setJobGroup(group, "")
    got = ev.resume_events(events, known, "latest", known.where("sequence_number < 5"))
    assert not tracker.getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got.count() == 40 - 10


def test_an_event_log_from_the_command_line(spark, folder):
    events = spark.range(60).selectExpr(
        "cast(id % 3 AS string) AS partition_id", "cast(id AS string) AS offset", "id AS sequence_number",
        "now() AS enqueued_time", "concat('{\"k\": {\"id\": ', id % 7, '}}') AS body", "cast(NULL AS string) AS properties",
    )
    arguments = ["stream-events", f"{folder}/e", "--log", "files|e", "--target", f"{folder}/t", "--sink-mode", "merge", "--merge-keys", "id"]
    arguments += ["--transform-sql", "SELECT json_get_int(body, 'k', 'id') AS id, sequence_number FROM __src", "--checkpoint", f"{folder}/c"]
    arguments += ["--max-files-per-batch", "1", "--once", "--buckets", "3"]
    table = VersionedTable(spark, f"{folder}/t")
    for low in (0, 40):
        events.where(f"sequence_number BETWEEN {low} AND {low + 39}").repartition(3).write.mode("append").parquet(f"{folder}/e")
        main(arguments)
    # Two runs of one batch each, though a batch was to have one file: once takes what is there.
    assert table.current_version() == 1 and table.snapshot().buckets == 3
    assert rows(table.read()) == [(k, max(i for i in range(60) if i % 7 == k)) for k in range(7)]
    spec = tr.EventSpec(tr.log_signature("files", "e"), f"{folder}/t", "append")
    assert tr.EventTransfer(spark, spec).offsets() == {"0": 57, "1": 58, "2": 59}


def test_chunks_of_a_commit_rewrite_disjoint_buckets(spark, folder):
    rows_ = spark.range(2_000).selectExpr("id AS k", "id AS v")
    table = VersionedTable(spark, f"{folder}/t", 8)
    table.apply(rows_, "merge", MergeSpec(("k",)))
    seen = spark.sparkContext.accumulator(0)

    def tell(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    f = spark.range(2_000).selectExpr("id AS k", "-id AS v", "'insert' AS _change_type", "0L AS _commit_version", "now() AS _commit_timestamp")
    VersionedTable(spark, f"{folder}/s").import_feed(f)
    t = tr.Transfer(spark, tr.TransferSpec(f"{folder}/s", f"{folder}/t", "merge", MergeSpec(("k",)), adaptive=True, buckets=8))
    read = t.source.read_feed
    t.source.read_feed = lambda a, b: read(a, b).mapInArrow(tell, read(a, b).schema)
    t.tunables.create("tunables-0000000000.json", '{"split_threshold_rows": 1000, "chunk_target_rows": 450, "merge_threshold_rows": 1000}')
    done = t.run()
    assert len(done) == 5 and seen.value == 2_000
    snapshot = table.snapshot()
    # Every bucket was written by exactly one of the five commits, so no row was written twice.
    assert sorted(e.bucket for e in snapshot.extents) == list(range(8)) and {e.first for e in snapshot.extents} == {1, 2, 3, 4, 5}
    changed = spark.read.parquet(f"{folder}/t/data").where("_commit_version >= 1 AND _part = 'state'").count()
    assert changed <= 2_200 and rows(table.read()) == [(i, -i) for i in range(2_000)]
