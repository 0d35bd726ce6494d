"""Queries over commit lists: grouping, chunking, progress."""

from pyspark.sql import functions as F

from changeflow.plans import grouping as plans
from changeflow.registry import fixtures as fx
from changeflow.registry.base import query

# Sizes that reach every branch of the plans on the 10,000-event feed.
SPLIT, MERGE, CHUNK, CAP, K = 340, 700, 100, 700, 10


def _commits(spark, sf):
    """Hourly commits of the event stream: hundreds of commits, so plans span many blocks."""
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600) - 473_352
    return (
        fx.table(spark, sf, "events")
        .groupBy(hour.cast("bigint").alias("version"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )


_HOURLY = (
    "SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) - 473352 AS version, "
    'count(*) AS "rows" FROM events GROUP BY 1'
)


def greedy(commits, split, limit, k, select):
    return f"""WITH RECURSIVE commits AS ({commits}),
o AS (SELECT version, "rows" AS n, row_number() OVER (ORDER BY version) AS i FROM commits),
r(i, version, n, g, s, k, sp) AS (
  SELECT 0::BIGINT, -1::BIGINT, 0::BIGINT, -1::BIGINT, 0::BIGINT, 0, true
  UNION ALL SELECT o.i, o.version, o.n,
    CASE WHEN o.n > {split} OR r.sp OR r.s + o.n > {limit} OR r.k >= {k} THEN r.g + 1 ELSE r.g END,
    CASE WHEN o.n > {split} THEN 0 WHEN r.sp OR r.s + o.n > {limit} OR r.k >= {k} THEN o.n ELSE r.s + o.n END,
    CASE WHEN o.n > {split} THEN 0 WHEN r.sp OR r.s + o.n > {limit} OR r.k >= {k} THEN 1 ELSE r.k + 1 END,
    o.n > {split} FROM r JOIN o ON o.i = r.i + 1),
plan AS (SELECT version, n AS "rows", g AS "group", CASE WHEN n > {split} THEN 'split'
  WHEN count(*) OVER (PARTITION BY g) > 1 THEN 'merged' ELSE 'single' END AS mode FROM r WHERE i > 0)
{select}"""


_ALL = 'SELECT version, "rows", "group", mode FROM plan'
_NO_MODE = 'SELECT version, "rows", "group" FROM plan'
HUGE = 9_000_000_000_000


@query("plan_adaptive", greedy(fx.COMMITS, SPLIT, MERGE, K, _ALL))
def plan_adaptive(spark, sf):
    return plans.plan_adaptive(fx.commits(spark, sf), SPLIT, MERGE)


@query("plan_adaptive_hourly", greedy(_HOURLY, 22, 60, K, _ALL))
def plan_adaptive_hourly(spark, sf):
    return plans.plan_adaptive(_commits(spark, sf), 22, 60)


@query("plan_row_cap", greedy(fx.COMMITS, HUGE, CAP, K, _NO_MODE))
def plan_row_cap(spark, sf):
    return plans.plan_row_cap(fx.commits(spark, sf), CAP)


@query("plan_row_cap_hourly", greedy(_HOURLY, HUGE, 100, K, _NO_MODE))
def plan_row_cap_hourly(spark, sf):
    return plans.plan_row_cap(_commits(spark, sf), 100)


@query(
    "plan_version_cap",
    f'SELECT version, "rows", (version - 2) // {K} AS "group" FROM ({fx.COMMITS}) c WHERE version >= 2',
)
def plan_version_cap(spark, sf):
    return plans.plan_version_cap(fx.commits(spark, sf), 2, K)


_CHUNKS = f"""SELECT version, "rows", greatest(ceil("rows" / {CHUNK}.0), 2)::BIGINT AS n
FROM ({fx.COMMITS}) c WHERE "rows" > {SPLIT}"""


@query(
    "split_chunks",
    f"""SELECT version, chunk, n AS chunks,
  CASE WHEN chunk = n - 1 THEN "rows" - ("rows" // n) * (n - 1) ELSE "rows" // n END AS chunk_rows
FROM ({_CHUNKS}) c, range(1000000) t(chunk) WHERE chunk < n""",
)
def split_chunks(spark, sf):
    return plans.split_chunks(fx.commits(spark, sf), SPLIT, CHUNK)


@query(
    "chunk_assign",
    f"""WITH f AS ({fx.FEED}), p AS (SELECT event_id, _commit_version,
  row_number() OVER (PARTITION BY _commit_version ORDER BY event_id) - 1 AS pos,
  count(*) OVER (PARTITION BY _commit_version) AS m FROM f),
n AS (SELECT *, greatest(ceil(m / {CHUNK}.0), 2)::BIGINT AS n FROM p)
SELECT _commit_version, event_id, least(pos // greatest(m // n, 1), n - 1) AS chunk FROM n""",
)
def chunk_assign(spark, sf):
    f = fx.feed(spark, sf).select("_commit_version", "event_id")
    return plans.chunk_by_position(f, CHUNK, "event_id")


@query(
    "chunk_assign_sparse",
    f"""WITH f AS ({fx.FEED}), p AS (SELECT event_id * 10000000 - 40000000000 AS event_id, _commit_version,
  row_number() OVER (PARTITION BY _commit_version ORDER BY event_id) - 1 AS pos,
  count(*) OVER (PARTITION BY _commit_version) AS m FROM f),
n AS (SELECT *, greatest(ceil(m / {CHUNK}.0), 2)::BIGINT AS n FROM p)
SELECT _commit_version, event_id, least(pos // greatest(m // n, 1), n - 1) AS chunk FROM n""",
)
def chunk_assign_sparse(spark, sf):
    """Ids far apart, as hashes and timestamps are: nearly every row is a slice of its own."""
    wide = (F.col("event_id") * 10_000_000 - 40_000_000_000).alias("event_id")
    f = fx.feed(spark, sf).select("_commit_version", wide)
    return plans.chunk_by_position(f, CHUNK, "event_id")


@query(
    "chunk_assign_by_key",
    f"""SELECT _commit_version, count(*) AS "rows", count(DISTINCT user_id) AS parts
FROM ({fx.FEED}) f GROUP BY 1""",
)
def chunk_by_key(spark, sf):
    """As many (key, chunk) pairs as keys: no key lies in two chunks."""
    rows = plans.chunk_by_key(fx.feed(spark, sf), ["user_id"], 8)
    parts = F.count_distinct("user_id", "chunk").alias("parts")
    return rows.groupBy("_commit_version").agg(F.count(F.lit(1)).alias("rows"), parts)


@query(
    "progress_table",
    greedy(
        fx.COMMITS,
        SPLIT,
        MERGE,
        K,
        f"""
, t AS (SELECT *, (sum("rows") OVER (ORDER BY version))::BIGINT AS total FROM plan),
u AS (SELECT max(version) AS unit_version, 0::BIGINT AS chunk, max(version) AS last_full_version,
    0::BIGINT AS next_chunk, max(total) AS rows_committed FROM t WHERE mode <> 'split' GROUP BY "group"
  UNION ALL SELECT version, chunk, CASE WHEN chunk = n - 1 THEN version ELSE version - 1 END,
    CASE WHEN chunk = n - 1 THEN 0 ELSE chunk + 1 END,
    total - "rows" + CASE WHEN chunk = n - 1 THEN "rows" ELSE (chunk + 1) * ("rows" // n) END
  FROM (SELECT *, greatest(ceil("rows" / {CHUNK}.0), 2)::BIGINT AS n FROM t WHERE mode = 'split') s,
    range(1000000) x(chunk) WHERE chunk < n)
SELECT *, CASE WHEN next_chunk = 0 THEN concat('v', last_full_version, ':complete')
  ELSE concat('v', last_full_version, '+chunk', next_chunk) END AS checkpoint FROM u""",
    ),
)
def progress_table(spark, sf):
    return plans.progress_table(plans.plan_adaptive(fx.commits(spark, sf), SPLIT, MERGE), CHUNK)
