"""User functions in transforms, and the run rows that a stream leaves."""

import json
import os
import threading

import pandas as pd
import pytest
from pyspark.sql import functions as F

from changeflow.operators import runs
from changeflow.operators.merge import MergeSpec, merge
from changeflow.operators.transform import sql_transform, with_private_names
from changeflow.sinks.parquet import AppendFolder, StateFolder
from changeflow.sources.feed_source import write_feed
from changeflow.streaming.micro_batches import FeedTransfer, drain
from changeflow.streaming.run_log import RunLog, read_runs


def test_only_calls_are_renamed():
    sql = "SELECT f(a), F ( b ), s.f(c), f, 'f(x)', `f`(d), g(f(e)) /* f(h) */ FROM __src -- f(i)"
    assert with_private_names(sql, {"f": "p"}) == "SELECT p(a), p ( b ), s.f(c), f, 'f(x)', `f`(d), g(p(e)) /* f(h) */ FROM __src -- f(i)"
    assert with_private_names("SELECT f(1", {"f": "p"}) == "SELECT f(1" and with_private_names(sql, {}) == sql


def adder(n):
    @F.pandas_udf("long")
    def add(v: pd.Series) -> pd.Series:
        return v + n

    return add


def test_functions_of_one_name_do_not_meet(spark):
    df, got = spark.range(100).toDF("v"), {}

    def run(n):
        for _ in range(3):
            rows = sql_transform(df, "SELECT sum(own(v)) AS s FROM __src", {"own": adder(n)}).first()
            got.setdefault(n, set()).add(rows.s)

    threads = [threading.Thread(target=run, args=(n,)) for n in (1, 2, 3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert got == {n: {4950 + 100 * n} for n in (1, 2, 3)}
    assert not [f for f in spark.catalog.listFunctions() if f.name.startswith("own")]
    with pytest.raises(Exception, match="own"):
        sql_transform(df, "SELECT own(v) FROM __src")


def test_functions_of_the_session_come_second(spark):
    spark.udf.register("own", adder(1000))
    try:
        df = spark.range(1).toDF("v")
        assert sql_transform(df, "SELECT own(v) AS v FROM __src").first().v == 1000
        assert sql_transform(df, "SELECT own(v) AS v FROM __src", {"own": adder(5)}).first().v == 5
        assert sql_transform(df, "SELECT own(v) AS v FROM __src").first().v == 1000
    finally:
        spark.sql("DROP TEMPORARY FUNCTION own")


@F.udtf(returnType="k bigint, v bigint")
class Twice:
    def eval(self, k: int, v: int):
        yield k, v
        yield k + 100, v


def test_functions_in_a_merge(spark):
    @F.pandas_udf("long")
    def top(v: pd.Series) -> int:
        return v.max()

    df = spark.createDataFrame([(1, 5), (1, 7), (2, 1)], "k bigint, v bigint")
    spec = MergeSpec(("k",), transform_sql="SELECT t.k, top(t.v) AS v FROM __src s, LATERAL twice(s.k, s.v) t GROUP BY t.k", transform_functions={"top": top, "twice": Twice})
    assert sorted(map(tuple, merge(None, df, spec).collect())) == [(1, 7), (2, 1), (101, 7), (102, 1)]


def feed(spark, versions):
    rows = [(v * 10 + i, t, v) for v in versions for i, t in enumerate(["insert", "insert", "delete", "update_preimage", "update_postimage", None])]
    return spark.createDataFrame(rows, "k bigint, _change_type string, _commit_version bigint").withColumn("_commit_timestamp", F.timestamp_seconds("k"))


class Fails(AppendFolder):
    at = None

    def apply(self, changes, number):
        if self.at == number:
            changes = changes.withColumn("k", F.raise_error(F.lit("no such thing")).cast("bigint"))
        super().apply(changes, number)


def test_a_stream_leaves_a_row_for_each_batch(spark, folder):
    write_feed(feed(spark, range(5)), f"{folder}/f")
    target = Fails(spark, f"{folder}/t")

    def run(**options):
        log = RunLog(spark, f"{folder}/runs", "job")
        drain(FeedTransfer(spark, f"{folder}/f", target, max_versions=2, log=log, **options).start(f"{folder}/c"), log)

    target.at = 1
    with pytest.raises(Exception, match="no such thing"):
        run()
    rows = read_runs(spark, f"{folder}/runs").orderBy("seq").collect()
    assert [(r.seq, r.rows, r.error is None) for r in rows] == [(0, 10, True), (1, None, False)]
    assert "no such thing" in rows[1].error and rows[0].duration_ms > 0
    target.at = None
    run()
    good = read_runs(spark, f"{folder}/runs").where("error IS NULL")
    assert [(r.seq, r.rows, r.inserts, r.updates, r.deletes, r.appended) for r in good.orderBy("seq").collect()] == [
        (0, 10, 4, 2, 2, 8), (1, 10, 4, 2, 2, 8), (2, 5, 2, 1, 1, 4),
    ]
    (total,) = runs.run_totals(good).collect()
    assert (total.job, total.batches, total.inserts, total.appended) == ("job", 3, 10, 20)
    assert runs.rows_per_sec(good).first().rows_per_sec > 0
    before = sorted(os.listdir(f"{folder}/runs"))
    run()  # nothing new, no row
    assert sorted(os.listdir(f"{folder}/runs")) == before


def test_logs_of_other_jobs_are_left_alone(spark, folder):
    write_feed(feed(spark, range(2)), f"{folder}/f")
    idle = RunLog(spark, f"{folder}/idle", "idle")
    idle.add()
    spec = MergeSpec(("k",))
    log = RunLog(spark, f"{folder}/runs", "busy")
    drain(FeedTransfer(spark, f"{folder}/f", StateFolder(spark, f"{folder}/t", spec, 2), log=log).start(f"{folder}/c"), log)
    idle.remove(0)
    assert not os.path.exists(f"{folder}/idle")
    (name,) = [n for n in os.listdir(f"{folder}/runs") if n.endswith(".json")]
    with open(f"{folder}/runs/{name}") as f:
        assert json.load(f)["rows"] == 10
