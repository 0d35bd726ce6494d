"""Compaction of folders, diffs by digests, and scans over blocks."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from changeflow.operators import compaction
from changeflow.operators.compaction import compact_folder, finish, packed, partitioned_files, size_classes
from changeflow.operators.diff import diff_by_digest, diff_snapshots
from changeflow.plans.scan import FAN, Scan, before_blocks
from changeflow.registry import table_queries
from changeflow.sinks.files import Folder


def test_packing_fits_and_is_tight():
    r = random.Random(1)
    for _ in range(200):
        sizes = [r.randrange(1, 90) for _ in range(r.randrange(1, 80))]
        out = packed(sizes, 100)
        fill = {}
        for s, o in zip(sizes, out, strict=True):
            fill[o] = fill.get(o, 0) + s
        assert max(fill.values()) <= 100 and sorted(fill) == list(range(len(fill)))
        if len(fill) > 1:
            assert sum(sorted(fill.values())[:2]) > 100  # no two output files fit into one


def table(spark, folder):
    df = spark.range(3_000).selectExpr("id AS k", "id % 3 AS p", "repeat(cast(id AS string), 5) AS t")
    df.where("k < 2400").repartition(1).write.partitionBy("p").parquet(folder)
    for i in range(5):
        df.where(f"k >= 2400 AND k % 5 = {i}").repartition(1).write.mode("append").partitionBy("p").parquet(folder)
    return df


def files(folder):
    return {os.path.relpath(p, folder): os.stat(p).st_ino for p in glob.glob(f"{folder}/**/*.parquet", recursive=True)}


def read(spark, folder):
    return sorted((r.k, r.p, r.t) for r in spark.read.parquet(folder).collect())


def test_only_small_files_are_exchanged(spark, folder):
    df = table(spark, folder)
    want, before = sorted((r.k, r.p, r.t) for r in df.collect()), files(folder)
    target = min(sorted((os.path.getsize(p) for p in glob.glob(f"{folder}/p={i}/*.parquet")), reverse=True)[0] for i in range(3))
    assert {(r.partition, r.size_class): r.files for r in size_classes(partitioned_files(spark, folder), target).collect()}["p=0", "small"] == 5
    assert compact_folder(spark, folder, target) == (15, 3)
    after = files(folder)
    assert read(spark, folder) == want and len(after) == 6
    kept = before.items() & after.items()
    assert len(kept) == 3
    assert compact_folder(spark, folder, target) == (0, 0) and files(folder) == after
    assert not [n for n in os.listdir(folder) if n.startswith("_compact")]


def test_rounds_and_groups_of_files(spark, folder, monkeypatch):
    monkeypatch.setattr(compaction, "ROUND", 4)
    monkeypatch.setattr(compaction, "GROUP", 3)
    df = table(spark, folder)
    removed, added = compact_folder(spark, folder, 1 << 20)
    assert removed > added > 0 and read(spark, folder) == sorted((r.k, r.p, r.t) for r in df.collect())


@pytest.mark.parametrize("stop", ["before", "within"])
def test_a_lost_compaction_is_finished(spark, folder, monkeypatch, stop):
    df = table(spark, folder)
    want, remove, calls = sorted((r.k, r.p, r.t) for r in df.collect()), Folder.remove, []

    def lost(self, name):
        calls.append(name)
        if len(calls) > (0 if stop == "before" else 4):
            raise RuntimeError("lost")
        remove(self, name)

    with monkeypatch.context() as m:
        m.setattr(Folder, "remove", lost)
        with pytest.raises(RuntimeError):
            compact_folder(spark, folder, 1 << 20)
    finish(spark, folder)
    assert read(spark, folder) == want and len(files(folder)) == 3
    finish(spark, folder)


def test_unpartitioned_and_empty_folders(spark, folder):
    spark.range(100).repartition(6).write.parquet(f"{folder}/a")
    assert compact_folder(spark, f"{folder}/a") == (6, 1)
    assert spark.read.parquet(f"{folder}/a").count() == 100
    os.makedirs(f"{folder}/b")
    assert compact_folder(spark, f"{folder}/b") == (0, 0)


# Diffs by digests


def diffed(df):
    return sorted(map(repr, df.collect()))


def test_digest_diff_equals_the_diff(spark):
    old = spark.range(5_000).selectExpr("id AS k", "cast(id % 9 AS string) AS a", "cast(NULL AS string) AS b", "array(id, NULL) AS xs", "map('x', id) AS m")
    changed = F.col("k").isin(17, 1_000, 4_321)
    # Values that change places with NULLs leave plain hashes as they are.
    new = old.where("k <> 44").select(
        "k", F.when(changed, None).otherwise(F.col("a")).alias("a"), F.when(changed, F.col("a")).alias("b"),
        F.when(F.col("k") == 99, F.expr("array(NULL, k)")).otherwise(F.col("xs")).alias("xs"),
        F.when(F.col("k") == 7, F.expr("map('y', k)")).otherwise(F.col("m")).alias("m"),
    ).unionByName(spark.sql("SELECT 9999L AS k, 'n' AS a, 'n' AS b, array(1L) AS xs, map('x', 1L) AS m"))
    none = spark.sql("SELECT cast(NULL AS bigint) AS k, 'n' AS a, 'n' AS b, array(1L) AS xs, map('x', 1L) AS m")
    old, new = old.unionByName(none), new.unionByName(none)
    as_text = lambda d: d.withColumn("m", F.to_json("m"))
    feed, ranges = diff_by_digest(as_text(old), as_text(new), ["k"])
    assert diffed(feed) == diffed(diff_snapshots(as_text(old), as_text(new), ["k"])) and ranges == 7
    assert {r.k for r in feed.collect()} == {17, 1_000, 4_321, 44, 99, 7, 9999, None}


def test_digest_diff_of_equal_and_empty_snapshots(spark):
    df = spark.range(50).selectExpr("id AS k", "id AS v")
    feed, ranges = diff_by_digest(df, df.repartition(7), ["k"])
    assert feed.count() == ranges == 0
    feed, ranges = diff_by_digest(df.limit(0), df, ["k"])
    assert feed.where("_change_type = 'insert'").count() == feed.count() == 50 and ranges > 40


def test_only_rows_of_differing_ranges_are_shuffled(spark):
    df = spark.range(20_000).selectExpr("id AS k", "id AS v")
    feed, ranges = diff_by_digest(df, df.withColumn("v", F.when(F.col("k") == 5, 0).otherwise(F.col("v"))), ["k"])
    assert ranges == 1
    plan = feed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin LeftSemi") + plan.count("LeftSemi") >= 2 and "CartesianProduct" not in plan


# Scans


@pytest.mark.parametrize("n", [1, FAN, FAN + 1, 5_000])
def test_scans_of_sums_and_of_last_values(spark, n):
    r = random.Random(n)
    blocks = sorted(r.sample(range(-7, 3 * n), n))
    rows = [((g,), b, r.randrange(9)) for g in ("a", None) for b in blocks]
    df = spark.createDataFrame(rows, "g struct<g: string>, n bigint, v bigint")
    got = before_blocks(df, Scan("a + b", "s + b", "bigint"), "0L", -7, 3 * n + 7).collect()
    want = {}
    for g in ("a", None):
        total = 0
        for (h,), b, v in rows:
            if h == g:
                want[g, b] = total
                total += v
    assert {(x.g.g, x.n): x.before for x in got} == want and len(got) == 2 * n
    lists = df.withColumn("v", F.array("n", "v"))
    last = Scan("slice(concat(a, b), -3, 3)", "slice(concat(array(0L, 0L, 0L), s, b), -3, 3)", "array<bigint>")
    first = before_blocks(lists, last, "array(0L, 0L, 0L)", -7, 3 * n + 7)
    by = {(x.g.g, x.n): list(x.before) for x in first.collect()}
    for g in ("a", None):
        own = [(b, v) for (h,), b, v in rows if h == g]
        flat = [0, 0, 0]
        for b, v in own:
            assert by[g, b] == flat[-3:]
            flat += [b, v]


def test_a_large_table_is_compacted_in_parts(spark, folder, monkeypatch):
    rows = spark.range(20_000).selectExpr("id AS l_orderkey", "1 AS l_linenumber", "substr('AN', 1 + int(id % 2), 1) AS l_returnflag")
    rows.write.parquet(f"{folder}/lineitem.parquet")
    monkeypatch.setattr(table_queries, "_PART_ROWS", 5_000, raising=False)
    monkeypatch.setattr(table_queries, "work_dir", lambda spark, name: f"{folder}/{name}")
    got = {r["mode"]: r.asDict() for r in table_queries.compact_small_files(spark, folder).collect()}
    for i, mode in enumerate("AN"):
        counts = {"large_before": 1, "small_before": 4, "large_kept": 1, "small_after": 1, "small_kept": 0}
        assert got.pop(mode) == {"mode": mode, "rows": 10_000, "key_sum": sum(range(i, 20_000, 2)), **counts}
    assert not got
    files = spark.read.parquet(f"{folder}/compact/table").groupBy(F.input_file_name()).count()
    assert files.agg(F.max("count")).first()[0] < 3_500  # a task's rows don't grow with the table
