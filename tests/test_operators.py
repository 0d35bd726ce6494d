"""Feeds, event records, commit files, JSON, previews, runs, layouts and generators."""

import base64
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from changeflow.functions import json as js
from changeflow.functions import zorder
from changeflow.functions.zorder import quantile_ranks
from changeflow.operators import datagen, feed, inspect, maintenance, runs
from changeflow.operators.transform import sql_transform
from changeflow.registry.fixtures import table
from changeflow.sinks.files import Folder
from changeflow.sources import commits, events, feeds
from conftest import SMALL
from test_merge import S, rows


def test_feed_errors_and_untyped_rows(spark):
    f = spark.createDataFrame([(1, 1, None, 0), (2, 2, "update_preimage", 0), (3, 3, "delete", 1)], S)
    f = f.withColumn("_commit_timestamp", F.lit(None).cast("timestamp"))
    assert [r.k for r in feed.read_changes(f, 0, 1).orderBy("k").collect()] == [1, 3]
    assert [r.k for r in feed.without_tombstones(f).orderBy("k").collect()] == [1, 2]
    assert feed.strip_metadata(f).columns == ["k", "v"]
    with pytest.raises(ValueError, match="before start"):
        feed.read_changes(f, 2, 1)
    with pytest.raises(ValueError, match="not a change feed"):
        feed.read_changes(f.drop("_change_type"), 0, 1)
    assert feed.baseline_version(f) == 1
    assert feed.baseline_version(f.limit(0)) == -1
    assert (feed.end_version(5), feed.end_version(5, 3), feed.end_version(5, 9)) == (5, 3, 5)
    assert [feed.resolve_start(*a) for a in ((3, 7), (None, 7), (None, None))] == [2, 7, -1]


def test_a_version_range_prunes_folders(spark, folder):
    f = spark.range(100).selectExpr("id", "'insert' AS _change_type", "id % 10 AS _commit_version", "now() AS _commit_timestamp")
    f.write.partitionBy("_commit_version").parquet(folder)
    got = feed.read_changes(feeds.read_feed_folder(spark, folder), 3, 4)
    assert got.count() == 20
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_commit_version" in plan
    stream = feeds.stream_changes(spark, folder, feeds.read_feed_folder(spark, folder).schema, 5)
    query = stream.writeStream.format("memory").queryName("folder_feed").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("folder_feed").count() == 100


def test_connectors_say_what_is_missing(spark):
    with pytest.raises(RuntimeError, match="Delta connector"):
        feeds.read_delta_changes(spark, "/nowhere", 0, 1)
    with pytest.raises(RuntimeError, match="Delta connector"):
        feeds.stream_delta_changes(spark, "/nowhere", 0)
    with pytest.raises(RuntimeError, match="Kafka connector"):
        events.stream_kafka(spark, "localhost:1", "t", 10)


def test_raw_events(spark):
    long = bytes([255, 0] * 100)
    schema = "partition_id int, offset bigint, sequence_number bigint, enqueued_time timestamp, body binary, properties map<string,int>"
    old = dt.datetime(1969, 12, 31, tzinfo=dt.UTC)
    raw = spark.createDataFrame(
        [(1, 5, 5, old, long, {"a": 1, "b": None}), (1, None, None, None, "ü".encode(), None), (2, 1, 1, None, None, {})],
        schema,
    )
    a, b, c = events.normalize_events(raw).orderBy(F.col("sequence_number").desc()).collect()
    assert a.body == '{"_b64":"' + base64.b64encode(long).decode() + '"}'
    assert a.enqueued_time is None and a.properties == '{"a":"1","b":null}'
    assert (c.sequence_number, c.offset, c.body, c.properties) == (-1, None, "ü", None)
    assert (b.body, b.properties, b.partition_id) == ("", "{}", "2")
    tagged = events.normalize_events(raw, "_bytes").where("sequence_number = 5").first()
    assert tagged.body.startswith('{"_bytes":"')


def test_commit_files(spark, folder):
    log = Folder(spark, f"{folder}/log")
    log.create("00000000000000000000.json", '{"add":{"path":"a","size":7,"stats":"{\\"numRecords\\":3}"}}\n\n{"add":{"path":"b","stats":{"numRecords":4}}}\n')
    log.create("00000000000000000001.json", '{"remove":{"path":"a"}}\n{"add": broken\n{"commitInfo":{"timestamp":1700000000000,"operation":"DELETE"}}\n')
    log.create("00000000000000000002.json", '{"add":{"path":"a","stats":"not json"}}\n{"add":{"path":"c","stats":"{\\"numRecords\\":-5}"}}\n')
    log.create("notes.txt", "no commit")
    lines = commits.read_log(spark, log.path)
    assert rows(commits.commit_rows(lines)) == [(0, 7), (1, 0), (2, 0)]
    assert rows(commits.live_files(lines).select("path", "rows")) == [("a", None), ("b", 4), ("c", -5)]
    assert tuple(commits.table_stats(commits.live_files(lines)).first()) == (3, 4)
    assert rows(commits.history(lines, 2)) == [(1, "2023-11-14 22:13:20 UTC", "DELETE"), (2, "", "")]


def test_json(spark):
    text = '{"s":"x","n":5,"f":1.5,"b":true,"o":{"a":[10,20]},"l":[1,2,3],"z":null}'
    df = spark.createDataFrame([(text,), ("broken",)], "j string")
    got = df.select(
        js.json_get_str("j", "s"), js.json_get_int("j", "n"), js.json_get_float("j", "f"), js.json_get_bool("j", "b"),
        js.json_get_int("j", "o", "a", 1), js.json_get_json("j", "o"), js.json_contains("j", "z"), js.json_contains("j", "q"),
        js.json_length("j"), js.json_length("j", "l"), js.json_object_keys("j", "o"), js.json_get_int("j", "s"),
    ).collect()
    assert tuple(got[0]) == ("x", 5, 1.5, True, 20, '{"a":[10,20]}', True, False, 7, 3, ["a"], None)
    assert tuple(got[1])[:6] == (None,) * 6
    out = sql_transform(df, "SELECT json_get_str(j, 's') s, json_contains(j, 'n') n FROM __src")
    assert rows(out) == [("x", True), (None, False)] or rows(out) == sorted([("x", True), (None, False)], key=repr)


def test_preview(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "x") for i in range(2_000)], "i int, s string")
    assert inspect.preview(df).count() == 100
    assert (inspect.preview(df, 0).count(), inspect.preview(df, 5_000).count()) == (1, 1_000)
    got = inspect.preview(df, 3, "  WHERE i > 10  ", ["i"]).collect()
    assert [tuple(r) for r in got] == [("11", "NULL"), ("12", "x"), ("13", "NULL")]
    assert inspect.preview(df, 5, " where ").count() == 5
    assert inspect.preview(df.withColumnRenamed("i", "whereabouts"), 5, "whereabouts < 3").count() == 3
    assert rows(inspect.schema_rows(df)) == [("i", "int", True), ("s", "string", True)]


def test_rolling_means(spark):
    r = random.Random(3)
    data = [(j, i * 7, r.randrange(100)) for j, n in (("a", 900), ("b", 40)) for i in range(n)]
    df = spark.createDataFrame(data, "job string, seq bigint, duration_ms bigint")
    want = {}
    for j in "ab":
        values = [x for x in data if x[0] == j]
        for i, (_, s, _d) in enumerate(values):
            last = [d for _, _, d in values[max(0, i - 49) : i + 1]]
            want[j, s] = sum(last) // len(last)
    got = runs.rolling_means(df, m=("duration_ms", 50), far=("duration_ms", 130)).collect()
    assert {(x.job, x.seq): x.m for x in got} == want
    assert runs.recent_runs(df, 50).groupBy("job").count().agg(F.max("count")).first()[0] == 50


def test_zorder_ranks_are_even_and_ordered(spark):
    df = spark.range(20_000).selectExpr("id", "pow(id, 3) AS x", "date_add(date'2020-01-01', int(id % 700)) AS d", "hex(id) AS s")
    for c, kinds in (("x", 256), ("d", 256)):
        rank = quantile_ranks(df, [c])[0]
        per = df.groupBy(rank.alias("r")).agg(F.count("*").alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi")).orderBy("r").collect()
        assert len(per) > kinds * 0.9 and max(p.n for p in per) < 4 * 20_000 / kinds
        assert all(a.hi < b.lo for a, b in zip(per, per[1:], strict=False))


def test_zorder_clusters_and_cuts_hot_keys(spark):
    df = spark.range(0, 20_000, 1, 8).selectExpr("IF(id % 3 = 0, 5, id % 199) AS a", "IF(id % 3 = 0, 5, id % 211) AS b", "id")
    out = maintenance.zorder_cluster(df, ["a", "b"], 8)
    sizes = [r[1] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2.5 * 20_000 / 8
    assert rows(out) == rows(df)


def test_generated_events(spark):
    ids = datagen.row_ids(spark, 5_000)
    df = datagen.sample_events(ids, 0.4).withColumn("id", F.lit(1)).cache()
    assert df.count() == 5_000
    reused = df.where("status = 'updated'").count()
    assert 0.3 < reused / 5_000 < 0.4
    fresh = df.where("status <> 'updated'").select("event_id")
    assert fresh.distinct().count() == fresh.count() == 5_000 - reused
    assert df.where("status = 'updated'").join(fresh, "event_id", "left_anti").count() == 0
    lo, hi = df.agg(F.min("amount"), F.max("amount")).first()
    assert 0.1 <= lo and hi < 5_000
    assert dict(df.dtypes)["amount"] == "decimal(18,4)"
    assert datagen.sample_events(ids, 0.0).where("status = 'updated'").count() == 0
    again = datagen.sample_events(ids.repartition(3), 0.4)
    assert again.exceptAll(df.drop("id")).count() == 0


def test_wide_table(spark):
    ids = datagen.row_ids(spark, 5)
    df = datagen.wide_table(ids, 12, version=datagen.commit_of(5, 4))
    assert [t for _, t in df.dtypes] == ["string", "timestamp_ntz", *(["string", "bigint", "double", "boolean", "int"] * 2), "bigint"]
    assert df.columns[2:5] == ["str_00", "int64_01", "dbl_02"] and df.columns[10:12] == ["bool_08", "int32_09"]
    assert sorted(r[0] for r in df.select("_commit_version").collect()) == [0, 0, 1, 1, 2]
    for bad in (lambda: datagen.row_ids(spark, 0), lambda: datagen.wide_table(ids, 1), lambda: datagen.commit_of(5, 0)):
        with pytest.raises(ValueError, match=">="):
            bad()


def test_scans_read_only_what_a_query_needs(spark):
    counts = feed.change_counts(table(spark, SMALL, "events").selectExpr("event_type AS _change_type", "user_id AS _commit_version", "props"))
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<user_id:bigint,event_type:string>" in plan


def exact_ranks(values, bits):
    """Rank of each value among the exact quantiles; 0 for None."""
    known = sorted(v for v in values if v is not None)
    bounds = [known[-(-k * len(known) // 2**bits) - 1] for k in range(1, 2**bits)] if known else []
    return [0 if v is None else sum(b <= v for b in bounds) for v in values]


@pytest.mark.parametrize("few", [1_024, 2])
def test_text_ranks_are_those_of_all_rows(spark, monkeypatch, few):
    monkeypatch.setattr(zorder, "FEW", few)
    monkeypatch.setattr(zorder, "FINE", 1 << 30)
    r = random.Random(few)
    start = ["", "https://www.example.com/", "https://www.example.com/a/", "é", "z" * 3_000]
    texts = [r.choice(start) + "".join(r.choice("ab/é") for _ in range(r.randrange(6))) for _ in range(2_000)]
    texts += ["https://www.example.com/hot"] * 700 + [None] * 50 + ["", "a", "ab"] * 20
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(5)
    (rank,) = zorder.quantile_ranks(df, ["t"], 4)
    got = {x.i: x.r for x in df.select("i", rank.alias("r")).collect()}
    want = exact_ranks([None if t is None else t.encode() for t in texts], 4)
    assert [got[i] for i in range(len(texts))] == want


def test_number_ranks_are_those_of_all_rows_and_stay_in_the_jvm(spark):
    r = random.Random(1)
    values = [r.choice([None, float("nan"), 5.0, r.gauss(0, 1), -1e300, float("inf")]) for _ in range(3_000)]
    df = spark.createDataFrame([(i, v, str(v)) for i, v in enumerate(values)], "i int, v double, t string").repartition(5)
    ranks = zorder.quantile_ranks(df, ["v", "t"], 5)
    ranked = df.select("i", ranks[0].alias("r"), ranks[1].alias("t"))
    assert "Python" not in ranked._jdf.queryExecution().executedPlan().toString()
    got = {x.i: x.r for x in ranked.collect()}
    assert [got[i] for i in range(len(values))] == exact_ranks([None if v is None or v != v else v for v in values], 5)
    assert zorder.quantile_ranks(df.limit(0), ["v", "t"])[0] is not None
