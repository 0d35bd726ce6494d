"""Queries over change feeds: ranges, filters, latest per key, snapshots."""

from pyspark.sql import functions as F

from changeflow.operators import feed as ops
from changeflow.operators.diff import diff_by_digest, diff_snapshots
from changeflow.operators.latest import latest_per_key, replay
from changeflow.registry import fixtures as fx
from changeflow.registry.base import query

_NEWEST = "_commit_version DESC NULLS FIRST, event_id DESC NULLS FIRST"


@query("feed_version_range", f"{fx.POST} AND _commit_version BETWEEN 3 AND 5")
def feed_version_range(spark, sf):
    return ops.read_changes(fx.feed(spark, sf), 3, 5)


@query("feed_postimages", fx.POST)
def feed_postimages(spark, sf):
    return ops.postimages(fx.feed(spark, sf))


@query("feed_no_tombstones", f"SELECT * FROM ({fx.FEED}) f WHERE _change_type <> 'delete'")
def feed_no_tombstones(spark, sf):
    return ops.without_tombstones(fx.feed(spark, sf))


@query("feed_strip_metadata", f"SELECT user_id, event_id, event_type, value, props FROM ({fx.FEED}) f")
def feed_strip_metadata(spark, sf):
    return ops.strip_metadata(fx.feed(spark, sf))


@query(
    "feed_change_counts",
    f'SELECT _commit_version, _change_type, count(*) AS "rows" FROM ({fx.FEED}) f GROUP BY 1, 2',
)
def feed_change_counts(spark, sf):
    return ops.change_counts(fx.feed(spark, sf))


@query(
    "version_cap",
    f"SELECT * FROM ({fx.FEED}) f WHERE _commit_version <= "
    f"least(17, (SELECT max(_commit_version) FROM ({fx.FEED}) g))",
)
def version_cap(spark, sf):
    f = fx.feed(spark, sf)
    return ops.up_to(f, ops.end_version(ops.latest_version(f), 17))


@query("start_version", f"SELECT * FROM ({fx.FEED}) f WHERE _commit_version >= 12")
def start_version(spark, sf):
    return ops.newer_than(fx.feed(spark, sf), ops.resolve_start(12, last_done=4))


@query(
    "baseline_version",
    f"SELECT * FROM ({fx.FEED}) f WHERE _commit_version > coalesce((SELECT max(_commit_version) "
    f"FROM ({fx.FEED}) g WHERE _commit_timestamp < TIMESTAMP '2024-01-10'), -1)",
)
def baseline_version(spark, sf):
    f = fx.feed(spark, sf)
    before = f.where(F.col("_commit_timestamp") < F.lit("2024-01-10").cast("timestamp_ntz"))
    return ops.newer_than(f, ops.baseline_version(before))


@query("latest_per_key", fx.last_sql(fx.POST, "user_id", _NEWEST))
def latest(spark, sf):
    return latest_per_key(ops.postimages(fx.feed(spark, sf)), ["user_id"], None, ["event_id"])


@query(
    "latest_per_key_custom",
    fx.last_sql(fx.POST, "user_id, event_type", "value DESC NULLS FIRST, event_id DESC NULLS FIRST"),
)
def latest_custom(spark, sf):
    return latest_per_key(
        ops.postimages(fx.feed(spark, sf)), ["user_id", "event_type"], "value", ["event_id"]
    )


@query(
    "feed_replay",
    "SELECT user_id, event_id, event_type, value, props FROM "
    f"({fx.last_sql(fx.POST, 'user_id', _NEWEST)}) r WHERE _change_type <> 'delete'",
)
def feed_replay(spark, sf):
    return replay(fx.feed(spark, sf), ["user_id"], None, ["event_id"])


_OLD = "SELECT o_orderkey AS k, o_orderstatus AS st, o_totalprice AS p FROM orders WHERE o_totalprice < 450000"
_NEW = (
    "SELECT o_orderkey AS k, CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END "
    "AS st, o_totalprice AS p FROM orders WHERE o_totalprice > 40000"
)


SNAPSHOT_DIFF = f"""WITH o AS ({_OLD}), n AS ({_NEW}), c AS (
  SELECT o.k AS ok, o.st AS ost, o.p AS op, n.k AS nk, n.st AS nst, n.p AS np
  FROM o FULL OUTER JOIN n ON o.k = n.k WHERE o.k IS NULL OR n.k IS NULL
    OR o.st IS DISTINCT FROM n.st OR o.p IS DISTINCT FROM n.p)
SELECT nk AS k, nst AS st, np AS p, 'insert' AS _change_type FROM c WHERE ok IS NULL
UNION ALL SELECT ok, ost, op, 'delete' FROM c WHERE nk IS NULL
UNION ALL SELECT ok, ost, op, 'update_preimage' FROM c WHERE ok = nk
UNION ALL SELECT nk, nst, np, 'update_postimage' FROM c WHERE ok = nk"""


def snapshots(spark, sf):
    """The orders before and after: some leave, some are new, the urgent ones change status."""
    o = fx.table(spark, sf, "orders")
    k, p = F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p")
    status = F.when(F.col("o_orderpriority") == "1-URGENT", "X").otherwise(F.col("o_orderstatus"))
    old = o.where("o_totalprice < 450000").select(k, F.col("o_orderstatus").alias("st"), p)
    return old, o.where("o_totalprice > 40000").select(k, status.alias("st"), p)


@query("snapshot_diff", SNAPSHOT_DIFF)
def snapshot_diff(spark, sf):
    return diff_snapshots(*snapshots(spark, sf), ["k"])


_WIDTH, _SPLIT = 640, 40


@query(
    "snapshot_diff_digest",
    f"""WITH d AS ({SNAPSHOT_DIFF}) SELECT *, (SELECT count(DISTINCT k // {_WIDTH // _SPLIT}) FROM d) AS ranges_joined FROM d""",
)
def snapshot_diff_digest(spark, sf):
    """The diff of two snapshots by digests of key ranges, and how many of the ranges were joined."""
    fine = F.floor(F.col("k") / (_WIDTH // _SPLIT))
    feed, joined = diff_by_digest(*snapshots(spark, sf), ["k"], (F.floor(F.col("k") / _WIDTH), fine))
    return feed.withColumn("ranges_joined", F.lit(joined).cast("bigint"))
