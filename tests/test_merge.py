"""Merge clauses, edge cases and properties."""

import random

import pytest

from changeflow.operators.diff import diff_snapshots
from changeflow.operators.latest import latest_per_key, replay
from changeflow.operators.merge import (
    MergeSpec,
    merge,
    merge_change_feed,
    merge_metrics,
    merge_prepared,
    parse_mode,
    prepare_source,
)

T = "k bigint, v bigint"
S = "k bigint, v bigint, _change_type string, _commit_version bigint"
KEY = MergeSpec(("k",))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def actions(target, source, spec):
    return {r[0]: r[1] for r in merge_metrics(target, source, spec).collect()}


@pytest.fixture
def target(spark):
    return spark.createDataFrame([(1, 10), (2, 20), (3, 30)], T)


def source(spark, *changes, schema=S):
    return spark.createDataFrame(list(changes), schema)


def test_all_clauses(spark, target):
    s = source(spark, (1, 11, "update_postimage", 1), (2, 0, "delete", 1), (4, 40, "insert", 1), (5, 0, "delete", 1), (6, 60, None, 1))
    assert rows(merge(target, s, KEY)) == [(1, 11), (3, 30), (4, 40), (6, 60)]
    assert actions(target, s, KEY) == {"update": 1, "delete": 1, "insert": 2, "keep": 1, "skip": 1}


def test_user_delete_comes_before_update_but_after_tombstones(spark, target):
    s = source(spark, (1, 99, "insert", 1), (2, 1, "insert", 1), (3, 99, "delete", 1))
    spec = MergeSpec(("k",), when_matched_delete="source.v > target.v", when_matched_update="true")
    assert rows(merge(target, s, spec)) == [(2, 1)]


def test_null_predicates_do_not_hold(spark, target):
    s = source(spark, (1, None, "insert", 1), (7, None, "insert", 1))
    spec = MergeSpec(
        ("k",),
        when_matched_update="source.v > 0",
        when_matched_delete="source.v > 0",
        when_not_matched_insert="source.v > 0",
    )
    assert rows(merge(target, s, spec)) == rows(target)


def test_restricted_update_columns_do_not_restrict_inserts(spark):
    t = spark.createDataFrame([(1, 1, 1)], "k int, a int, b int")
    s = spark.createDataFrame([(1, 2, 2), (3, 3, 3)], "k int, a int, b int")
    assert rows(merge(t, s, MergeSpec(("k",), ("a",)))) == [(1, 2, 1), (3, 3, 3)]


def test_a_null_key_never_matches_but_deduplicates(spark):
    t = spark.createDataFrame([(None, 1), (None, 1), (1, 1)], T)
    s = source(spark, (None, 2, "insert", 1), (None, 3, "insert", 2), (1, 5, "insert", 1))
    assert rows(merge(t, s, KEY)) == sorted([(None, 1), (None, 1), (None, 3), (1, 5)], key=repr)


def test_nan_keys_match(spark):
    t = spark.createDataFrame([(float("nan"), 1)], "k double, v int")
    s = spark.createDataFrame([(float("nan"), 2)], "k double, v int")
    assert [r.v for r in merge(t, s, KEY).collect()] == [2]


def test_delete_then_insert_in_one_commit_keeps_the_row(spark, target):
    s = source(spark, (1, 0, "delete", 4), (1, 12, "insert", 4))
    assert (1, 12) in rows(merge(target, s, KEY))


def test_nulls_of_the_dedupe_column_win(spark):
    s = spark.createDataFrame([(1, 5, 3), (1, 6, None), (1, 7, 9)], "k int, v int, o int")
    assert [r.v for r in latest_per_key(s, ["k"], "o").collect()] == [6]


def test_dedupe_falls_back_to_the_first_key(spark):
    s = spark.createDataFrame([(1, 5), (1, 5), (2, 1)], "k int, v int")
    assert rows(latest_per_key(s, ["k"])) == [(1, 5), (2, 1)]


def test_evolution_and_safe_cast(spark):
    t = spark.createDataFrame([(1, 1)], "k int, v int")
    s = spark.createDataFrame([(1, "x", "new"), (2, "7", "new")], "k int, v string, extra string")
    out = merge(t, s, KEY)
    assert out.dtypes == [("k", "int"), ("v", "int"), ("extra", "string")]
    assert rows(out) == [(1, None, "new"), (2, 7, "new")]


def test_odd_column_names(spark):
    t = spark.createDataFrame([(1, 1)], "`a.b` int, `c d` int")
    s = spark.createDataFrame([(1, 2), (3, 4)], "`a.b` int, `c d` int")
    assert rows(merge(t, s, MergeSpec(("a.b",)))) == [(1, 2), (3, 4)]


def test_nested_columns_pass_through(spark):
    schema = "k int, m map<string,int>, l array<struct<x:int>>"
    t = spark.createDataFrame([(1, {"a": 1}, [(1,)])], schema)
    s = spark.createDataFrame([(1, {"a": 2}, [(2,)]), (2, {}, [])], schema)
    out = {r.k: (r.m, [x.x for x in r.l]) for r in merge(t, s, KEY).collect()}
    assert out == {1: ({"a": 2}, [2]), 2: ({}, [])}


def test_duplicate_target_rows_are_all_updated(spark):
    t = spark.createDataFrame([(1, 1), (1, 2), (2, 2)], T)
    s = source(spark, (1, 9, "insert", 1))
    assert rows(merge(t, s, KEY)) == [(1, 9), (1, 9), (2, 2)]


def test_transform_errors(spark, target):
    s = source(spark, (1, 1, "insert", 1))
    with pytest.raises(ValueError, match="columns left.*'other'"):
        merge(target, s, MergeSpec(("k",), transform_sql="SELECT v AS other FROM __src"))
    with pytest.raises(ValueError, match="feed column"):
        MergeSpec(("_commit_version",))
    with pytest.raises(ValueError, match="one or more"):
        MergeSpec(())
    with pytest.raises(ValueError, match="exclusive"):
        MergeSpec(("k",), transform_sql="SELECT 1", transform_arrow=lambda b: b, transform_schema="k int")


def test_an_error_in_a_batch_transform_ends_the_job(spark, target):
    def broken(batch):
        raise RuntimeError("bad batch")

    spec = MergeSpec(("k",), transform_arrow=broken, transform_schema=S)
    with pytest.raises(Exception, match="bad batch"):
        merge(target, source(spark, (1, 1, "insert", 1)), spec).collect()


def test_parse_mode():
    assert parse_mode("APPEND") == ("append", None)
    mode, spec = parse_mode("Merge", " a, ,b ", "c,", when_matched_update="source.x > 1")
    assert (mode, spec.keys, spec.update_columns) == ("merge", ("a", "b"), ("c",))
    assert spec.when_matched_update == "source.x > 1"
    with pytest.raises(ValueError, match="one or more"):
        parse_mode("merge", " , ")
    with pytest.raises(ValueError, match="unknown sink mode"):
        parse_mode("upsert")


def random_feed(spark, seed, versions=12, keys=20):
    r = random.Random(seed)
    out = []
    for v in range(versions):
        for k in r.sample(range(keys), 8):
            out.append((k, r.randrange(1000), r.choice(["insert", "update_postimage", "delete"]), v))
    return spark.createDataFrame(out, S)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_grouping_gives_the_same_state(spark, target, seed):
    feed = random_feed(spark, seed)
    whole = rows(merge(target, feed, KEY))
    state = target
    for first, last in ((0, 4), (5, 5), (6, 11)):
        state = merge(state, feed.where(f"_commit_version BETWEEN {first} AND {last}"), KEY)
    assert rows(state) == whole
    assert rows(merge(merge(target, feed, KEY), feed, KEY)) == whole
    assert rows(replay(feed, ["k"])) == rows(merge(None, feed, KEY))


@pytest.mark.parametrize("seed", [3, 4])
def test_a_diff_and_an_emitted_feed_rebuild_the_state(spark, target, seed):
    feed = random_feed(spark, seed)
    after = merge(target, feed, KEY)
    diff = diff_snapshots(target, after, ["k"]).where("_change_type <> 'update_preimage'")
    assert rows(merge(target, diff, KEY)) == rows(after)
    emitted = merge_change_feed(target, feed, KEY).where("_change_type <> 'update_preimage'")
    assert rows(merge(target, emitted, KEY)) == rows(after)


def test_diff_of_null_keys(spark):
    old = spark.createDataFrame([(None, 1), (1, 1), (2, 2)], T)
    new = spark.createDataFrame([(None, 1), (1, 5), (3, 3)], T)
    assert rows(diff_snapshots(old, new, ["k"])) == sorted(
        [(None, 1, "delete"), (None, 1, "insert"), (1, 1, "update_preimage"), (1, 5, "update_postimage"),
         (2, 2, "delete"), (3, 3, "insert")],
        key=repr,
    )


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_plan_prunes_ranks_and_reuses_the_source(spark, conf, folder):
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    random_feed(spark, 5).write.parquet(f"{folder}/s")
    spark.range(100).selectExpr("id AS k", "id AS v").write.parquet(f"{folder}/t")
    plan = plan_of(merge(spark.read.parquet(f"{folder}/t"), spark.read.parquet(f"{folder}/s"), KEY))
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert "ReusedExchange" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def hot(spark, folder, key="1"):
    """A target with a third of its rows on one key."""
    t = spark.range(30_000).selectExpr(f"IF(id % 3 = 0, {key}, id) AS k", "id AS v", "repeat('x', 50) AS p")
    t.repartition(8).write.parquet(f"{folder}/t")
    s = spark.range(20_000).selectExpr("id AS k", "id * 2 AS v", "'s' AS p")
    s.repartition(4).write.parquet(f"{folder}/s")
    return spark.read.parquet(f"{folder}/t"), spark.read.parquet(f"{folder}/s")


@pytest.mark.parametrize("key", ["1", "CAST(NULL AS BIGINT)"])
def test_a_hot_target_key_is_split(spark, conf, folder, key):
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="20KB",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="20KB",
        spark__sql__shuffle__partitions="16",
    )
    t, s = hot(spark, folder, key)
    out = merge_prepared(t, prepare_source(s, KEY), KEY)
    assert "skew=true" in plan_of(out)
    t.createOrReplaceTempView("hot_t")
    s.createOrReplaceTempView("hot_s")
    want = spark.sql(
        "SELECT coalesce(t.k, s.k) k, coalesce(s.v, t.v) v, coalesce(s.p, t.p) p "
        "FROM hot_t t FULL JOIN hot_s s ON t.k = s.k"
    )
    assert rows(out) == rows(want)


def test_a_measured_large_source_is_shuffled_once(spark, folder):
    t, s = hot(spark, folder)
    plan = plan_of(merge_prepared(t, s, KEY, small_source=False))
    assert "Broadcast" not in plan
    assert "ReusedExchange" in plan


def test_small_source_gives_the_same_rows_without_shuffling_the_target(spark, folder):
    t, s = hot(spark, folder)
    source = prepare_source(s, KEY)
    small = merge_prepared(t, source, KEY, small_source=True)
    assert rows(small) == rows(merge_prepared(t, source, KEY))
    assert "BroadcastHashJoin" in plan_of(small) and "SortMergeJoin" not in plan_of(small)
