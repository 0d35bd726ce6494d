"""The derived inputs of the registered queries, once for Spark and once as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def feed(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    kind = (
        F.when(F.col("event_type") == "error", "delete")
        .when(F.col("event_id") % 10 == 0, "update_preimage")
        .when(F.col("event_id") % 10 == 1, "update_postimage")
        .otherwise("insert")
    )
    return e.select(
        "user_id",
        "event_id",
        "event_type",
        "value",
        "props",
        kind.alias("_change_type"),
        (F.dayofmonth("ts") - 1).cast("bigint").alias("_commit_version"),
        F.col("ts").alias("_commit_timestamp"),
    )


FEED = """SELECT user_id, event_id, event_type, value, props,
  CASE WHEN event_type = 'error' THEN 'delete'
       WHEN event_id % 10 = 0 THEN 'update_preimage'
       WHEN event_id % 10 = 1 THEN 'update_postimage' ELSE 'insert' END AS _change_type,
  CAST(day(ts) - 1 AS BIGINT) AS _commit_version, ts AS _commit_timestamp
FROM events"""

POST = f"SELECT * FROM ({FEED}) f WHERE _change_type <> 'update_preimage'"


def target(spark: SparkSession, sf: str) -> DataFrame:
    """Accounts in good standing: keys the feed matches and keys it does not."""
    return table(spark, sf, "customer").where("c_acctbal > 3000").select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_nationkey").cast("bigint").alias("event_id"),
        F.col("c_mktsegment").alias("event_type"),
        F.col("c_acctbal").alias("value"),
        F.concat(F.lit('{"name": "'), F.col("c_name"), F.lit('"}')).alias("props"),
    )


TARGET = """SELECT c_custkey AS user_id, CAST(c_nationkey AS BIGINT) AS event_id,
  c_mktsegment AS event_type, c_acctbal AS value,
  concat('{"name": "', c_name, '"}') AS props FROM customer WHERE c_acctbal > 3000"""

COLUMNS = ["user_id", "event_id", "event_type", "value", "props"]


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        (F.col("user_id") % 4).cast("string").alias("partition_id"),
        F.col("event_id").cast("string").alias("offset"),
        F.col("event_id").alias("sequence_number"),
        F.col("ts").alias("enqueued_time"),
        F.col("props").alias("body"),
        F.lit(None).cast("string").alias("properties"),
    )


EVENT_LOG = """SELECT CAST(user_id % 4 AS VARCHAR) AS partition_id,
  CAST(event_id AS VARCHAR) AS "offset", event_id AS sequence_number, ts AS enqueued_time,
  props AS body, CAST(NULL AS VARCHAR) AS properties FROM events"""



def commits(spark: SparkSession, sf: str) -> DataFrame:
    return (
        feed(spark, sf)
        .groupBy(F.col("_commit_version").alias("version"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )


COMMITS = f'SELECT _commit_version AS version, count(*) AS "rows" FROM ({FEED}) f GROUP BY 1'


def last_sql(source: str, keys: str, order: str) -> str:
    """The first row per key of ``source`` in ``order``."""
    return (
        "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY "
        f"{keys} ORDER BY {order}) AS rn FROM ({source}) s0) q WHERE rn = 1"
    )


def merge_sql(
    tgt: str,
    src: str,
    keys: list[str],
    columns: list[str],
    update: list[str] | None = None,
    typed: bool = True,
    when_update: str = "true",
    when_delete: str = "false",
    when_insert: str = "true",
    select: str | None = None,
) -> str:
    """The merge of a deduplicated ``src`` into ``tgt`` as one full outer join, for the checks."""
    on = " AND ".join(f"target.{k} = source.{k}" for k in keys)
    gone = "coalesce(source._change_type = 'delete', false)" if typed else "false"
    action = (
        f"CASE WHEN target.t AND source.s AND ({gone}) THEN 'delete' "
        f"WHEN target.t AND source.s AND ({when_delete}) THEN 'delete' "
        f"WHEN target.t AND source.s AND ({when_update}) AND NOT {gone} THEN 'update' "
        "WHEN target.t THEN 'keep' "
        f"WHEN ({when_insert}) AND NOT {gone} THEN 'insert' ELSE 'skip' END"
    )
    update = [c for c in columns if c not in keys] if update is None else update
    out = ", ".join(
        f"CASE WHEN _action = 'insert' THEN s_{c} "
        + (f"WHEN _action = 'update' THEN s_{c} " if c in update else "")
        + f"ELSE t_{c} END AS {c}"
        for c in columns
    )
    both = ", ".join(f"target.{c} AS t_{c}, source.{c} AS s_{c}" for c in columns)
    body = select or f"SELECT {out} FROM j WHERE _action NOT IN ('delete', 'skip')"
    return (
        f"WITH tgt AS ({tgt}), src AS ({src}), j AS (SELECT {both}, {action} AS _action FROM "
        "(SELECT *, true AS t FROM tgt) target FULL OUTER JOIN "
        f"(SELECT *, true AS s FROM src) source ON {on}) {body}"
    )
