"""Queries over the partitioned event log."""

from pyspark.sql import functions as F

from changeflow.functions import json as js
from changeflow.operators.merge import MergeSpec, merge
from changeflow.operators.transform import sql_transform
from changeflow.registry import fixtures as fx
from changeflow.registry.base import query
from changeflow.sources import events as ev

_RAW_SQL = """SELECT CAST(user_id % 4 AS VARCHAR) AS partition_id,
  CAST(event_id AS VARCHAR) AS "offset",
  CASE WHEN event_type = 'error' THEN -1 ELSE event_id END AS sequence_number,
  CASE WHEN event_type = 'signup' THEN NULL ELSE ts END AS enqueued_time,
  CASE event_type WHEN 'view' THEN '{"_b64":"//4="}' WHEN 'click' THEN '' ELSE props END AS body,
  CASE WHEN event_type = 'purchase' THEN NULL
    ELSE concat('{"type":"', event_type, '","none":null}') END AS properties FROM events"""


@query("event_log_normalize", _RAW_SQL)
def event_log_normalize(spark, sf):
    e = fx.table(spark, sf, "events")
    kind = F.col("event_type")
    raw = e.select(
        (F.col("user_id") % 4).alias("partition_id"),
        F.col("event_id").alias("offset"),
        F.when(kind != "error", F.col("event_id")).alias("sequence_number"),
        F.when(kind == "signup", F.col("ts") - F.make_interval(years=F.lit(70)))
        .otherwise(F.col("ts"))
        .cast("timestamp")
        .alias("enqueued_time"),
        F.when(kind == "view", F.unhex(F.lit("FFFE")))
        .when(kind != "click", F.col("props").cast("binary"))
        .alias("body"),
        F.when(
            kind != "purchase",
            F.create_map(F.lit("type"), kind, F.lit("none"), F.lit(None).cast("string")),
        ).alias("properties"),
    )
    # Time zones do not compare across engines: the check looks at the UTC wall clock.
    utc = F.col("enqueued_time").cast("timestamp_ntz")
    return ev.normalize_events(raw).withColumn("enqueued_time", utc)


_BEFORE = f"SELECT * FROM ({fx.EVENT_LOG}) e WHERE enqueued_time < TIMESTAMP '2024-01-12'"


def _before(log):
    return log.where(F.col("enqueued_time") < F.lit("2024-01-12").cast("timestamp_ntz"))


@query(
    "event_log_resume",
    f"""WITH o AS (SELECT partition_id AS p, max(sequence_number) AS s FROM ({_BEFORE}) b
  WHERE partition_id <> '3' GROUP BY 1)
SELECT e.* FROM ({fx.EVENT_LOG}) e LEFT JOIN o ON e.partition_id = o.p
WHERE s IS NULL OR sequence_number > s""",
)
def event_log_resume(spark, sf):
    log = fx.event_log(spark, sf)
    known = ev.batch_offsets(_before(log)).where("partition_id <> '3'")
    return ev.resume_events(log, known, "earliest")


@query(
    "event_log_resume_latest",
    f"""WITH o AS (SELECT partition_id AS p, max(sequence_number) AS s FROM ({fx.EVENT_LOG}) b
  WHERE partition_id = '3' AND enqueued_time < TIMESTAMP '2024-01-20' OR
    partition_id <> '3' AND enqueued_time < TIMESTAMP '2024-01-12' GROUP BY 1)
SELECT e.* FROM ({fx.EVENT_LOG}) e LEFT JOIN o ON e.partition_id = o.p
WHERE s IS NULL OR sequence_number > s""",
)
def event_log_resume_latest(spark, sf):
    """Partition 3 has no stored offset: it starts at what was latest when reading began."""
    log = fx.event_log(spark, sf)
    known = ev.batch_offsets(_before(log)).where("partition_id <> '3'")
    start = log.where(F.col("enqueued_time") < F.lit("2024-01-20").cast("timestamp_ntz"))
    return ev.resume_events(log, known, "newest", ev.batch_offsets(start))


@query("event_log_partitions", f"SELECT * FROM ({fx.EVENT_LOG}) e WHERE partition_id IN ('1', '3')")
def event_log_partitions(spark, sf):
    return ev.select_partitions(fx.event_log(spark, sf), "1, ,3")


@query(
    "event_log_offsets",
    f"SELECT partition_id, max(sequence_number) AS sequence_number FROM ({fx.EVENT_LOG}) e GROUP BY 1",
)
def event_log_offsets(spark, sf):
    return ev.batch_offsets(fx.event_log(spark, sf))


@query(
    "event_log_offsets_merge",
    f"""SELECT partition_id, max(sequence_number) AS sequence_number FROM (
  SELECT * FROM ({_BEFORE}) a WHERE partition_id <> '3' UNION ALL
  SELECT * FROM ({fx.EVENT_LOG}) c WHERE partition_id IN ('1', '3')) u GROUP BY 1""",
)
def event_log_offsets_merge(spark, sf):
    log = fx.event_log(spark, sf)
    known = ev.batch_offsets(_before(log)).where("partition_id <> '3'")
    return ev.merge_offsets(known, ev.batch_offsets(ev.select_partitions(log, ["1", "3"])))


JSON_MERGE = (
    "SELECT json_get_int(body, 'k') AS k, partition_id, sequence_number FROM __src "
    "WHERE json_contains(body, 'k')"
)


@query(
    "event_log_merge_json",
    "SELECT * EXCLUDE (rn) FROM (SELECT CAST(json_extract_string(body, '$.k') AS BIGINT) AS k, "
    "partition_id, sequence_number, row_number() OVER (PARTITION BY json_extract_string(body, '$.k') "
    f"ORDER BY sequence_number DESC) AS rn FROM ({fx.EVENT_LOG}) e) q WHERE rn = 1",
)
def event_log_merge_json(spark, sf):
    """The merge key is taken from the JSON body by the transform."""
    return merge(None, fx.event_log(spark, sf), MergeSpec(("k",), transform_sql=JSON_MERGE))


@query(
    "json_extract",
    "SELECT event_id, json_extract_string(props, '$.k') AS text, "
    "TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS n, "
    "TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS x, "
    "json_extract_string(props, '$.none') AS missing, true AS has_k, false AS has_none, "
    "1 AS length, '69' = json_extract_string(props, '$.k') AS hit FROM events",
)
def json_extract(spark, sf):
    e = fx.table(spark, sf, "events")
    return e.select(
        "event_id",
        js.json_get_str("props", "k").alias("text"),
        js.json_get_int("props", "k").alias("n"),
        js.json_get_float("props", "k").alias("x"),
        js.json_get_str("props", "none").alias("missing"),
        js.json_contains("props", "k").alias("has_k"),
        js.json_contains("props", "none").alias("has_none"),
        js.json_length("props").alias("length"),
        (js.json_get_json("props", "k") == "69").alias("hit"),
    )


_NESTED = """SELECT event_id, '{"a": {"n": [' || event_id || ', {"t": "' || event_type || '"}], "0": true},'
  || ' "it''s": ' || props || ', "v": ' || value || '}' AS j FROM events"""


def _nested(spark, sf):
    e = fx.table(spark, sf, "events")
    start = F.concat(F.lit('{"a": {"n": ['), "event_id", F.lit(', {"t": "'), "event_type", F.lit('"}], "0": true}, '))
    j = F.concat(start, F.lit('"it\'s": '), "props", F.lit(', "v": '), "value", F.lit("}"))
    return e.select("event_id", j.alias("j"))


@query(
    "json_extract_sql",
    f"""WITH e AS ({_NESTED}) SELECT event_id, json_extract_string(j, '$.a.n[1].t') AS text,
  CAST(json_extract_string(j, '$.a.n[0]') AS BIGINT) AS n, CAST(json_extract_string(j, '$.v') AS DOUBLE) AS x,
  true AS flag, CAST(json_extract_string(j, '$."it''s".k') AS BIGINT) AS quoted, 2 AS n_items, 3 AS n_keys,
  CAST(NULL AS VARCHAR) AS missing, '{{"t":"' || json_extract_string(j, '$.a.n[1].t') || '"}}' AS inner_json,
  json_extract_string(j, '$.a.n[1].t') AS as_text, true AS has, json_extract_string(j, '$.a.n[0]') AS any_value,
  'a,it''s,v' AS keys FROM e""",
)
def json_extract_sql(spark, sf):
    """Every JSON function by its SQL name, over nested values, positions and a key with a quote."""
    return sql_transform(
        _nested(spark, sf),
        """SELECT event_id, json_get_str(j, 'a', 'n', 1, 't') AS text, json_get_int(j, 'a', 'n', 0) AS n,
  json_get_float(j, 'v') AS x, json_get_bool(j, 'a', '0') AS flag, json_get_int(j, "it's", 'k') AS quoted,
  json_length(j, 'a', 'n') AS n_items, json_length(j) AS n_keys, json_get_str(j, 'a', 'none') AS missing,
  json_get_json(j, 'a', 'n', 1) AS inner_json, json_as_text(j, 'a', 'n', 1, 't') AS as_text,
  json_contains(j, "it's") AS has, to_json(json_get(j, 'a', 'n', 0)) AS any_value,
  array_join(json_object_keys(j), ',') AS keys FROM __src""",
    )


@query(
    "json_operators_sql",
    f"""WITH e AS ({_NESTED}), x AS (SELECT event_id, json_extract_string(j, '$.a.n[1].t') AS kind,
  CAST(json_extract_string(j, '$.v') AS DOUBLE) AS v, CAST(json_extract_string(j, '$."it''s".k') AS BIGINT) AS k FROM e)
SELECT event_id, kind AS text, '[' || event_id || ',{{"t":"' || kind || '"}}]' AS inner_json, 1 + 2 * k AS odd, kind || '->' || k AS joined,
  true AS has_a, false AS has_none, kind IN ('view', 'error') AS listed, v > 50 AND NOT kind = 'click' AS large,
  CASE WHEN k % 2 = 0 THEN 'even ' || kind ELSE '? ->> ' || event_id END AS label, k AS cast_value,
  CAST(event_id AS VARCHAR) || ',' || kind AS items, k + event_id AS total FROM x
WHERE kind LIKE '%i%' OR k BETWEEN 10 AND 60""",
)
def json_operators_sql(spark, sf):
    """The JSON operators: chains, positions, precedence, casts, comments, strings and lambdas that hold arrows."""
    return sql_transform(
        _nested(spark, sf),
        """SELECT event_id, j -> 'a'->'n' -> 1 ->> 't' AS text, -- the text under j -> 'a'
  j->'a'->'n' AS inner_json, 1 + 2 * (j -> "it's" ->> 'k')::bigint AS odd,
  j->'a'->'n'->1->>'t' || '->' || (j /* ? */ -> 'it\\'s' ->> 'k') AS joined, j ? 'a' AS has_a, j -> 'a' ? 'none' AS has_none,
  j->'a'->'n'->1->>'t' IN ('view', 'error') AS listed,
  (j ->> 'v')::double > 50 AND NOT j->'a'->'n'->1->>'t' = 'click' AS large,
  CASE WHEN try_cast(j->'it''s'->>'k' AS BIGINT) % 2 = 0 THEN 'even ' || (j->'a'->'n'->1->>'t')
    ELSE '? ->> ' || (j->'a'->'n'->>0) END AS label,
  CAST(j->"it's" ->> CASE WHEN j ? 'v' THEN 'k' ELSE 'none' END AS BIGINT) AS cast_value,
  array_join(transform(from_json(j->'a'->'n', 'array<string>'), (x, i) -> CASE WHEN i = 0 THEN x ELSE x ->> 't' END), ',') AS items,
  aggregate(array(j->'it''s'->>'k', j->'a'->'n'->>0), 0L, (acc, x) -> acc + x::bigint, acc -> acc) AS total
FROM __src
WHERE j->'a'->'n'->1->>'t' LIKE '%i%' OR (j->'it''s'->>'k')::bigint BETWEEN 10 AND 60""",
    )
