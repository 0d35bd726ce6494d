"""Commit grouping and chunking against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from changeflow.plans.grouping import (
    chunk_by_key,
    chunk_by_position,
    plan_adaptive,
    plan_row_cap,
    plan_version_cap,
    progress_table,
    split_chunks,
)
from changeflow.plans.positions import row_positions, running_sum


def greedy(commits, split, limit, k):
    out, group, total, size, closed = [], -1, 0, 0, True
    for version, n in sorted(commits):
        if split is not None and n > split:
            group, closed = group + 1, True
        elif not closed and total + n <= limit and size < k:
            total, size = total + n, size + 1
        else:
            group, total, size, closed = group + 1, n, 1, False
        out.append((version, n, group))
    return out


def some_commits(seed, n, sparse):
    r = random.Random(seed)
    versions = sorted(r.sample(range(n * 40), n)) if sparse else list(range(n))
    return [(v, r.choice([0, 1, 5, 20, 50, 400])) for v in versions]


@pytest.mark.parametrize("seed,n,sparse,k", [(1, 1, False, 10), (2, 255, False, 10), (3, 2600, True, 10), (4, 700, True, 3), (5, 530, False, 1), (6, 900, False, 70)])
def test_plans_equal_brute_force(spark, seed, n, sparse, k):
    commits = some_commits(seed, n, sparse)
    df = spark.createDataFrame(commits, "version bigint, rows bigint")
    got = plan_adaptive(df, 100, 80, k).select("version", "rows", "group")
    assert sorted(map(tuple, got.collect())) == greedy(commits, 100, 80, k)
    got = plan_row_cap(df, 90, k)
    assert sorted(map(tuple, got.collect())) == greedy(commits, None, 90, k)


def test_modes(spark):
    df = spark.createDataFrame([(0, 5), (1, 5), (2, 500), (3, 90)], "version bigint, rows bigint")
    got = {r.version: r.mode for r in plan_adaptive(df, 100, 80).collect()}
    assert got == {0: "merged", 1: "merged", 2: "split", 3: "single"}


def test_version_cap_counts_from_the_start(spark):
    df = spark.createDataFrame([(v, 1) for v in range(7)], "version bigint, rows bigint")
    got = {r.version: r.group for r in plan_version_cap(df, 2, 2).collect()}
    assert got == {2: 0, 3: 0, 4: 1, 5: 1, 6: 2}
    with pytest.raises(ValueError):
        plan_row_cap(df, 0)


def test_chunks_add_up(spark):
    df = spark.createDataFrame([(0, 101), (1, 7), (2, 1000)], "version bigint, rows bigint")
    got = sorted(map(tuple, split_chunks(df, 100, 300).collect()))
    assert got == [(0, 0, 2, 50), (0, 1, 2, 51), (2, 0, 4, 250), (2, 1, 4, 250), (2, 2, 4, 250), (2, 3, 4, 250)]


def test_rows_fall_into_chunks_of_the_planned_size(spark):
    feed = spark.range(3_000).selectExpr("IF(id < 1001, 0L, 1L) AS _commit_version", "id * 977 AS event_id")
    sizes = feed.groupBy(F.col("_commit_version").alias("version")).agg(F.count("*").alias("rows"))
    want = {(r.version, r.chunk): r.chunk_rows for r in split_chunks(sizes, 1, 300).collect()}
    got = chunk_by_position(feed, 300, "event_id").groupBy("_commit_version", "chunk").count()
    assert {(r[0], r[1]): r[2] for r in got.collect()} == want


def test_a_key_lies_in_one_chunk(spark):
    feed = spark.range(1_000).selectExpr("id % 37 AS k", "id AS v")
    per_key = chunk_by_key(feed, ["k"], 5).groupBy("k").agg(F.count_distinct("chunk").alias("n"))
    assert per_key.where("n <> 1").count() == 0


def test_positions_and_running_sums(spark):
    r = random.Random(9)
    data = [(r.choice(["a", "b", None]), i * r.randrange(1, 9) * 1000 + i, r.randrange(50)) for i in range(1, 800)]
    data = list({(g, o): (g, o, v) for g, o, v in data}.values())
    df = spark.createDataFrame(data, "g string, o bigint, v bigint")
    want = {}
    for g in ("a", "b", None):
        for i, (_, o, _v) in enumerate(sorted((x for x in data if x[0] == g), key=lambda x: x[1])):
            want[g, o] = i
    got = row_positions(df, ["g"], "o", width=1000, size="n")
    got = got.collect()
    assert {(x.g, x.o): x.position for x in got} == want
    assert {(x.g, x.n) for x in got} == {(g, sum(x[0] == g for x in data)) for g in ("a", "b", None)}
    unique = df.dropDuplicates(["o"])
    total, sums = 0, {}
    for _, o, v in sorted(map(tuple, unique.collect()), key=lambda x: x[1]):
        total += v
        sums[o] = total
    got = running_sum(unique, "o", F.col("v"), width=500)
    assert {x.o: x.total for x in got.collect()} == sums


def test_progress(spark):
    df = spark.createDataFrame([(0, 5), (1, 6), (2, 500)], "version bigint, rows bigint")
    got = progress_table(plan_adaptive(df, 100, 80), 200).orderBy("rows_committed")
    assert [(r.checkpoint, r.rows_committed) for r in got.collect()] == [
        ("v1:complete", 11), ("v1+chunk1", 177), ("v1+chunk2", 343), ("v2:complete", 511)
    ]


def test_no_step_gathers_all_blocks(spark):
    df = spark.createDataFrame(some_commits(7, 3_000, True), "version bigint, rows bigint")
    plan = plan_adaptive(df, 100, 80)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan
    aggregates = [line for line in plan.split("\n") if "Aggregate" in line and "collect_list" in line]
    assert aggregates and not any(re.search(r"Aggregate \[collect_list", line) for line in aggregates)


def test_commits_far_apart_and_of_one_block(spark):
    for versions in ([5], [-3, 10**12, 10**15], list(range(300))):
        commits = [(v, 30) for v in versions]
        df = spark.createDataFrame(commits, "version bigint, rows bigint")
        got = plan_adaptive(df, 100, 80, 3).select("version", "rows", "group")
        assert sorted(map(tuple, got.collect())) == greedy(commits, 100, 80, 3)
    assert plan_adaptive(df.limit(0), 100, 80).count() == 0
