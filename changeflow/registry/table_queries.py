"""Queries over commit logs, file lists, run logs and generated tables."""

from pyspark.sql import functions as F

from changeflow.functions.zorder import interleave, quantile_ranks
from changeflow.operators import datagen, inspect, maintenance, runs
from changeflow.operators.compaction import compact_folder, partitioned_files
from changeflow.registry import fixtures as fx
from changeflow.registry.base import query
from changeflow.session import work_dir
from changeflow.sources import commits

# Commit log derived from the feed: adds with text or object statistics, a blank line, a broken
# line, a removal; one line per commit and event type.


def _log(spark, sf):
    groups = fx.feed(spark, sf).groupBy("_commit_version", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.max("_commit_timestamp").alias("at")
    )
    n = F.col("n").cast("string")
    line = (
        F.when(F.col("event_type") == "view", F.concat(F.lit('{"add":{"path":"a","stats":"{\\"numRecords\\":'), n, F.lit('}"}}')))
        .when(F.col("event_type") == "click", F.concat(F.lit('{"add":{"path":"b","stats":{"numRecords":'), n, F.lit("}}}")))
        .when(F.col("event_type") == "signup", F.lit("   "))
        .when(F.col("event_type") == "error", F.lit('{"add":{"stats":'))
        .otherwise(
            F.concat(
                F.lit('{"commitInfo":{"timestamp":'),
                F.unix_millis(F.col("at").cast("timestamp")).cast("string"),
                F.lit(',"operation":"WRITE"}}'),
            )
        )
    )
    name = F.concat(F.lpad(F.col("_commit_version").cast("string"), 20, "0"), F.lit(".json"))
    return commits.log_lines(groups.select(line.alias("value"), name.alias("file_name")))


@query(
    "commit_row_counts",
    f"""SELECT _commit_version AS version, count_if(event_type IN ('view', 'click'))::BIGINT AS "rows"
FROM ({fx.FEED}) f GROUP BY 1""",
)
def commit_row_counts(spark, sf):
    return commits.commit_rows(_log(spark, sf))


@query(
    "history_recent",
    f"""SELECT _commit_version AS version,
  coalesce(strftime(max(CASE WHEN event_type = 'purchase' THEN _commit_timestamp END), '%Y-%m-%d %H:%M:%S UTC'), '') AS "timestamp",
  CASE WHEN count_if(event_type = 'purchase') > 0 THEN 'WRITE' ELSE '' END AS operation
FROM ({fx.FEED}) f GROUP BY 1 ORDER BY 1 DESC LIMIT 10""",
)
def history_recent(spark, sf):
    return commits.history(_log(spark, sf))


@query(
    "preview_where",
    """SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id,
  event_type, coalesce(CASE WHEN user_id > 40 THEN props END, 'NULL') AS props
FROM events WHERE value > 100 AND event_type = 'purchase' ORDER BY events.event_id LIMIT 100""",
)
def preview_where(spark, sf):
    shown = fx.table(spark, sf, "events").withColumn("props", F.expr("CASE WHEN user_id > 40 THEN props END"))
    found = inspect.preview(shown, 100, "where value > 100 AND event_type = 'purchase'", ["event_id"])
    return found.select("event_id", "user_id", "event_type", "props")


# File lists: every part is a file.
_FILES = """SELECT concat('f', CAST(p_partkey AS VARCHAR)) AS path, p_partkey % 20 AS version,
  p_partkey % 3 = 0 AS removed, p_partkey % 17 = 0 AS orphan,
  CAST(p_size AS BIGINT) * 1000 AS size_bytes, p_partkey % 400 AS age_hours, p_brand AS brand FROM part"""


def _files(spark, sf):
    k = F.col("p_partkey")
    return fx.table(spark, sf, "part").select(
        F.concat(F.lit("f"), k.cast("string")).alias("path"),
        (k % 20).alias("version"),
        (k % 3 == 0).alias("removed"),
        (k % 17 == 0).alias("orphan"),
        (F.col("p_size").cast("bigint") * 1000).alias("size_bytes"),
        (k % 400).alias("age_hours"),
        F.col("p_brand").alias("brand"),
    )


def _file_log(spark, sf):
    """Adds (some without statistics, some with a negative count) and later removals."""
    f = _files(spark, sf).where("NOT orphan")
    stats = F.when(F.col("age_hours") > 350, "").when(
        F.col("age_hours") > 300, F.lit(',"stats":"{\\"numRecords\\":-1}"')
    ).otherwise(F.concat(F.lit(',"stats":"{\\"numRecords\\":'), (F.col("size_bytes") / 1000).cast("bigint").cast("string"), F.lit('}"')))
    add = F.concat(F.lit('{"add":{"path":"'), "path", F.lit('"'), stats, F.lit("}}"))
    gone = F.concat(F.lit('{"remove":{"path":"'), "path", F.lit('"}}'))
    return f.select("version", add.alias("action")).unionByName(
        f.where("removed").select((F.col("version") + 20).alias("version"), gone.alias("action"))
    )


@query(
    "table_inspect",
    f"""SELECT count(*) AS num_files, CAST(coalesce(sum(CASE WHEN age_hours <= 300 THEN size_bytes // 1000
  WHEN age_hours <= 350 THEN 0 END), 0) AS BIGINT) AS estimated_rows
FROM ({_FILES}) f WHERE NOT removed AND NOT orphan""",
)
def table_inspect(spark, sf):
    return commits.table_stats(commits.live_files(_file_log(spark, sf)))


@query("vacuum_candidates", f"SELECT path FROM ({_FILES}) f WHERE (removed OR orphan) AND age_hours > 168")
def vacuum_candidates(spark, sf):
    live = commits.live_files(_file_log(spark, sf))
    return maintenance.stale_files(_files(spark, sf), live).select("path")


@query(
    "vacuum_sample",
    f"SELECT path FROM ({_FILES}) f WHERE (removed OR orphan) AND age_hours > 168 ORDER BY path LIMIT 100",
)
def vacuum_sample(spark, sf):
    live = commits.live_files(_file_log(spark, sf))
    return maintenance.sample_paths(maintenance.stale_files(_files(spark, sf), live))


_PLAN = f"""SELECT brand, count(*) AS files_removed, CAST(greatest(ceil(sum(size_bytes) / 40000.0), 1) AS BIGINT) AS files_added
FROM ({_FILES}) f WHERE size_bytes < 40000 GROUP BY brand"""


@query("compaction_plan", f"SELECT * FROM ({_PLAN}) p WHERE files_removed > files_added")
def compaction_plan(spark, sf):
    return maintenance.compaction_plan(_files(spark, sf), ["brand"], 40_000)


@query(
    "compaction_report",
    f"""SELECT CAST(sum(files_added) AS BIGINT) AS files_added, CAST(sum(files_removed) AS BIGINT) AS files_removed,
  count(*) AS partitions_optimized FROM ({_PLAN}) p WHERE files_removed > files_added""",
)
def compaction_report(spark, sf):
    return maintenance.compaction_report(maintenance.compaction_plan(_files(spark, sf), ["brand"], 40_000))


@query("compact", "SELECT * FROM orders")
def compact(spark, sf):
    size = maintenance.list_files(spark, f"{sf}/orders.parquet").agg(F.sum("size_bytes")).first()[0]
    return maintenance.compacted(fx.table(spark, sf, "orders"), size, 1_000_000)


#: Rows of one part of the table that is compacted, so that no file is more than a task's work.
_PART_ROWS = 2_000_000


@query(
    "compact_small_files",
    """SELECT l_returnflag AS mode, count(*) AS rows, CAST(sum(l_orderkey) AS BIGINT) AS key_sum,
  CAST(1 AS BIGINT) AS large_before, CAST(4 AS BIGINT) AS small_before, CAST(1 AS BIGINT) AS large_kept,
  CAST(1 AS BIGINT) AS small_after, CAST(0 AS BIGINT) AS small_kept FROM lineitem GROUP BY 1""",
)
def compact_small_files(spark, sf):
    """Each return flag has a large file and four small ones; the small ones become one, the large one stays as it is.

    A large table has several parts of a return flag, all alike: were one not, its flag would come out in two rows.
    """
    folder = f"{work_dir(spark, 'compact')}/table"
    lines = fx.table(spark, sf, "lineitem")
    parts = -(-lines.count() // _PART_ROWS) or 1
    part = F.pmod(F.xxhash64(F.lit("part"), "l_orderkey"), F.lit(parts))
    rows = lines.withColumn("mode", F.col("l_returnflag")).withColumn("part", part)

    def write(some, mode):  # a file for each return flag of each part
        dealt = some.repartition(4 * parts, "mode", "part")
        dealt.write.mode(mode).partitionBy("mode", "part").parquet(folder)

    hundredth = F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(100))
    write(rows.where(hundredth >= 4), "error")
    for k in range(4):
        write(rows.where(hundredth == k), "append")
    before = partitioned_files(spark, folder)
    before = before.sparkSession.createDataFrame(before.collect(), before.schema)
    target = before.groupBy("partition").agg(F.max("size_bytes").alias("size")).agg(F.min("size")).first()[0]
    compact_folder(spark, folder, target)
    both = before.withColumn("before", F.lit(True)).join(
        partitioned_files(spark, folder).withColumn("after", F.lit(True)), ["path", "partition", "size_bytes"], "full_outer"
    )
    is_large, was, stays = F.col("size_bytes") >= target, F.col("before").isNotNull(), F.col("after").isNotNull()
    mode = F.regexp_replace("partition", "^mode=|/part=[0-9]+$", "").alias("mode")
    files = both.groupBy(mode, "partition").agg(
        F.count_if(is_large & was).alias("large_before"),
        F.count_if(~is_large & was).alias("small_before"),
        F.count_if(is_large & was & stays).alias("large_kept"),
        F.count_if(~was & stays).alias("small_after"),
        F.count_if(~is_large & was & stays).alias("small_kept"),
    )
    files = files.drop("partition").distinct()
    read = spark.read.parquet(folder).groupBy("mode")
    return read.agg(F.count("*").alias("rows"), F.sum("l_orderkey").alias("key_sum")).join(files, "mode")


@query("zorder_cluster", "SELECT * FROM orders")
def zorder_cluster(spark, sf):
    o = fx.table(spark, sf, "orders")
    return maintenance.zorder_cluster(o, ["o_orderdate", "o_custkey"], 8)


_BITS = 5
_TEXT = "'https://example.com/items/' || o_orderpriority || '/' || o_orderkey"


def _rank(name):
    return f"""(SELECT count(*) FROM (SELECT b.{name} FROM numbered b JOIN range(1, {2**_BITS}) t(k)
      ON b.rn_{name} = (t.k * b.n + {2**_BITS - 1}) // {2**_BITS}) x WHERE x.{name} <= o.{name})"""


@query(
    "zorder_ranks",
    f"""WITH o AS (SELECT o_orderkey, o_totalprice AS price, {_TEXT} AS url FROM orders),
numbered AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY price) AS rn_price,
  row_number() OVER (ORDER BY url) AS rn_url FROM o)
SELECT o_orderkey, {_rank("price")} AS price_rank, {_rank("url")} AS url_rank FROM o""",
)
def zorder_ranks(spark, sf):
    """Ranks of numbers and of long texts that begin alike, among all rows."""
    url = F.concat(F.lit("https://example.com/items/"), "o_orderpriority", F.lit("/"), F.col("o_orderkey").cast("string"))
    o = fx.table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), url.alias("url"))
    price, text = quantile_ranks(o, ["price", "url"], _BITS)
    return o.select("o_orderkey", price.alias("price_rank"), text.alias("url_rank"))


@query(
    "zorder_overlap",
    "SELECT 16 AS partitions, CAST(count(*) AS BIGINT) AS rows, true AS narrow_keys, true AS narrow_texts FROM orders",
)
def zorder_overlap(spark, sf):
    """How much of each column's range a partition spans: rows left as they are would span all of it."""
    url = F.concat(F.lit("https://example.com/"), F.lpad(F.pmod(F.xxhash64("o_orderkey"), F.lit(10**9)).cast("string"), 9, "0"))
    o = fx.table(spark, sf, "orders").select("o_custkey", url.alias("url"), F.expr("cast(right(url, 9) AS bigint)").alias("place"))
    placed = maintenance.zorder_cluster(o, ["o_custkey", "url"], 16).withColumn("p", F.spark_partition_id())
    spans = placed.groupBy("p").agg(
        F.count("*").alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("o_custkey", "place") for f in (F.min, F.max)]
    )

    def narrow(c):
        whole = F.max(f"max_{c}") - F.min(f"min_{c}")
        return F.avg((F.col(f"max_{c}") - F.col(f"min_{c}")).cast("double")) < 0.5 * whole

    return spans.agg(
        F.count("*").cast("int").alias("partitions"),
        F.sum("n").alias("rows"),
        narrow("o_custkey").alias("narrow_keys"),
        narrow("place").alias("narrow_texts"),
    )


_Z = " | ".join(
    [f"((((o_custkey % 256) >> {i}) & 1) << {2 * i})" for i in range(8)]
    + [f"((((o_orderkey % 256) >> {i}) & 1) << {2 * i + 1})" for i in range(8)]
)


@query("zorder_keys", f"SELECT o_orderkey, CAST({_Z} AS BIGINT) AS z FROM orders")
def zorder_keys(spark, sf):
    ranks = [F.col("o_custkey") % 256, F.col("o_orderkey") % 256]
    return fx.table(spark, sf, "orders").select("o_orderkey", interleave(ranks).alias("z"))


# Run logs: every order is a run of the job named by its status.
_RUNS = """SELECT o_orderstatus AS job, o_orderkey AS seq, CAST(floor(o_totalprice) AS BIGINT) AS "rows",
  o_custkey % 997 AS duration_ms, o_custkey % 7 AS inserts, o_custkey % 5 AS updates,
  o_custkey % 3 AS deletes, o_custkey % 2 AS appended FROM orders"""


def _runs(spark, sf):
    c = F.col("o_custkey")
    return fx.table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("job"),
        F.col("o_orderkey").alias("seq"),
        F.floor("o_totalprice").cast("bigint").alias("rows"),
        (c % 997).alias("duration_ms"),
        (c % 7).alias("inserts"),
        (c % 5).alias("updates"),
        (c % 3).alias("deletes"),
        (c % 2).alias("appended"),
    )


@query(
    "run_totals",
    f"""SELECT job, count(*) AS batches, sum(inserts)::BIGINT AS inserts, sum(updates)::BIGINT AS updates,
  sum(deletes)::BIGINT AS deletes, sum(appended)::BIGINT AS appended FROM ({_RUNS}) r GROUP BY 1""",
)
def run_totals(spark, sf):
    return runs.run_totals(_runs(spark, sf))


@query(
    "rows_per_sec",
    f"""SELECT job, CAST(sum("rows") AS DOUBLE) / greatest(CAST(sum(duration_ms) AS DOUBLE) / 1000.0::DOUBLE, 0.001::DOUBLE) AS rows_per_sec
FROM ({_RUNS}) r GROUP BY 1""",
)
def rows_per_sec(spark, sf):
    return runs.rows_per_sec(_runs(spark, sf))


def _rolling(last):
    return f"CAST(sum(duration_ms) OVER (PARTITION BY job ORDER BY seq ROWS {last - 1} PRECEDING) // count(*) OVER (PARTITION BY job ORDER BY seq ROWS {last - 1} PRECEDING) AS BIGINT)"


@query(
    "run_history_rolling",
    f"SELECT job, seq, {_rolling(100)} AS mean_latency, {_rolling(50)} AS mean_duration FROM ({_RUNS}) r",
)
def run_history_rolling(spark, sf):
    r = _runs(spark, sf).select("job", "seq", "duration_ms")
    means = {"mean_latency": ("duration_ms", 100), "mean_duration": ("duration_ms", 50)}
    return runs.rolling_means(r, **means).drop("duration_ms")


@query(
    "run_history_recent",
    f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY seq DESC) AS rn FROM ({_RUNS}) r) q WHERE rn <= 50",
)
def run_history_recent(spark, sf):
    return runs.recent_runs(_runs(spark, sf))


# Generated tables take their row ids from a given table, so they grow with it.


def _hash(salt):
    """The generator's hash, written out for SQL."""
    p, n = datagen.PRIME, datagen.salt_number(salt)
    a, b, c = datagen.FACTORS
    x = f"(((id % {p} + (id // {p}) * 7919 + {n}) % {p}) * {a} + {n}) % {p}"
    x = f"(xor({x}, ({x}) >> 15) * {b} + 1) % {p}"
    return f"(xor({x}, ({x}) >> 13) * {c} % {p})"


def _pick(values, salt):
    return f"list_extract({values!r}, CAST({_hash(salt)} % {len(values)} AS INTEGER) + 1)"


def _uuid(i):
    h = f"md5(concat({i}, '/event'))"
    parts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return "concat_ws('-', " + ", ".join(f"substr({h}, {a}, {n})" for a, n in parts) + ")"


_IDS = "SELECT event_id AS id FROM events"
_REUSE = f"(id % 10 <> 0 AND {_hash('reuse')} % 1000000 < 300000)"


@query(
    "sample_events",
    f"""SELECT {_uuid(f"CASE WHEN {_REUSE} THEN greatest(id - id % 10 - ({_hash('back')} % 10000) * 10, 0) ELSE id END")} AS event_id,
  concat('acct-', lpad(CAST({_hash('account')} % 99999999 AS VARCHAR), 8, '0')) AS account_id,
  TIMESTAMP '2024-06-01' - to_seconds({_hash('time')} % 3600) AS event_timestamp,
  {_pick(datagen.EVENT_TYPES, 'type')} AS event_type, {_pick(datagen.CATEGORIES, 'category')} AS category,
  {_pick(datagen.PRODUCTS, 'product')} AS product,
  CAST(CAST({_hash('amount')} % 49999000 + 1000 AS DECIMAL(18, 0)) / 10000 AS DECIMAL(18, 4)) AS amount,
  {_pick(datagen.CURRENCIES, 'currency')} AS currency, {_hash('eligible')} % 100 < 85 AS is_eligible,
  {_pick(datagen.REGIONS, 'region')} AS region,
  CASE WHEN {_REUSE} THEN 'updated' ELSE {_pick(datagen.STATUSES, 'status')} END AS status,
  CAST(7 AS INTEGER) AS batch_id FROM ({_IDS}) i""",
)
def sample_events(spark, sf):
    ids = fx.table(spark, sf, "events").select(F.col("event_id").alias("id"))
    return datagen.sample_events(ids, 0.3, batch_id=7)


@query(
    "wide_table",
    f"""SELECT {_uuid('id')} AS event_id, TIMESTAMP '2024-06-01' - to_seconds({_hash('time')} % 2592000) AS event_timestamp,
  md5(concat(id, '/c0')) AS str_00, {_hash('c1')} * 4294967296 + {_hash('c1+')} * 2 - 4611686014132420608 AS int64_01,
  CAST({_hash('c2')} AS DOUBLE) / 2147483647.0::DOUBLE * 1000000.0::DOUBLE AS dbl_02,
  {_hash('c3')} % 2 = 0 AS bool_03, CAST({_hash('c4')} * 2 - 2147483646 AS INTEGER) AS int32_04,
  md5(concat(id, '/c5')) AS str_05, id // 2500 AS _commit_version FROM ({_IDS}) i""",
)
def wide_table(spark, sf):
    ids = fx.table(spark, sf, "events").select(F.col("event_id").alias("id"))
    return datagen.wide_table(ids, 8, version=datagen.commit_of(10_000, 4))
