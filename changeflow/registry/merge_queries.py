"""Queries over the keyed merge and its transforms."""

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from changeflow.operators import feed as ops
from changeflow.operators.merge import MergeSpec, merge, merge_change_feed, merge_metrics, prepare_source
from changeflow.operators.transform import arrow_transform, sql_transform
from changeflow.registry import fixtures as fx
from changeflow.registry.base import query

COLS = fx.COLUMNS
_NEWEST = "_commit_version DESC NULLS FIRST, event_id DESC NULLS FIRST"
_LAST = fx.last_sql(fx.POST, "user_id", _NEWEST)


def _spec(**options):
    return MergeSpec(**{"keys": ("user_id",), "tie_breakers": ("event_id",), **options})


def _run(spark, sf, **options):
    return merge(fx.target(spark, sf), ops.postimages(fx.feed(spark, sf)), _spec(**options))


@query("merge_upsert_delete", fx.merge_sql(fx.TARGET, _LAST, ["user_id"], COLS))
def merge_upsert_delete(spark, sf):
    return _run(spark, sf)


@query(
    "merge_version_range",
    fx.merge_sql(
        fx.TARGET,
        fx.last_sql(f"{fx.POST} AND _commit_version BETWEEN 3 AND 5", "user_id", _NEWEST),
        ["user_id"],
        COLS,
    ),
)
def merge_version_range(spark, sf):
    return merge(fx.target(spark, sf), ops.read_changes(fx.feed(spark, sf), 3, 5), _spec())


@query(
    "merge_missing_target",
    f"SELECT user_id, event_id, event_type, value, props FROM ({_LAST}) r WHERE _change_type <> 'delete'",
)
def merge_missing_target(spark, sf):
    return merge(None, ops.postimages(fx.feed(spark, sf)), _spec())


@query(
    "merge_delete_predicate",
    fx.merge_sql(fx.TARGET, _LAST, ["user_id"], COLS, when_delete="target.value > 6000 AND source.value < 100"),
)
def merge_delete_predicate(spark, sf):
    return _run(spark, sf, when_matched_delete="target.value > 6000 AND source.value < 100")


@query(
    "merge_update_predicate",
    fx.merge_sql(fx.TARGET, _LAST, ["user_id"], COLS, when_update="source.value > 40"),
)
def merge_update_predicate(spark, sf):
    return _run(spark, sf, when_matched_update="source.value > 40")


@query(
    "merge_update_columns",
    fx.merge_sql(fx.TARGET, _LAST, ["user_id"], COLS, update=["value", "props"]),
)
def merge_update_columns(spark, sf):
    return _run(spark, sf, update_columns=("value", "props"))


@query(
    "merge_insert_predicate",
    fx.merge_sql(fx.TARGET, _LAST, ["user_id"], COLS, when_insert="source.event_type = 'purchase'"),
)
def merge_insert_predicate(spark, sf):
    return _run(spark, sf, when_not_matched_insert="source.event_type = 'purchase'")


@query(
    "late_update_guard",
    fx.merge_sql(
        fx.last_sql(f"{fx.POST} AND _commit_version > 20 AND _change_type <> 'delete'", "user_id", _NEWEST)
        .replace("SELECT * EXCLUDE (rn)", "SELECT user_id, event_id, event_type, value, props, _commit_timestamp AS seen", 1),
        fx.last_sql(
            f"SELECT user_id, event_id, event_type, value, props, _commit_timestamp AS seen, _change_type, _commit_version FROM ({fx.POST}) p",
            "user_id",
            "value DESC NULLS FIRST, event_id DESC NULLS FIRST",
        ),
        ["user_id"],
        [*COLS, "seen"],
        when_update="source.seen > target.seen",
    ),
)
def late_update_guard(spark, sf):
    """Stale changes (here: the most valuable ever, whatever its age) do not replace newer rows."""
    f = ops.postimages(fx.feed(spark, sf)).withColumn("seen", F.col("_commit_timestamp"))
    base = merge(None, ops.without_tombstones(ops.newer_than(f, 20)), _spec())
    guard = "source.seen > target.seen"
    return merge(base, f, _spec(dedupe_order_by="value", when_matched_update=guard))


_K = "CASE WHEN event_type IN ('view', 'MACHINERY') THEN NULL ELSE user_id END"


@query(
    "merge_null_keys",
    fx.merge_sql(
        f"SELECT {_K} AS k, event_type, value FROM ({fx.TARGET}) t",
        fx.last_sql(
            f"SELECT {_K} AS k, event_type, value, _change_type, _commit_version, event_id FROM ({fx.POST}) p",
            "k",
            _NEWEST,
        ),
        ["k"],
        ["k", "event_type", "value"],
    ),
)
def merge_null_keys(spark, sf):
    k = F.expr(_K).alias("k")
    tgt = fx.target(spark, sf).select(k, "event_type", "value")
    src = ops.postimages(fx.feed(spark, sf)).select(
        k, "event_type", "value", "_change_type", "_commit_version", F.col("event_id").alias("_tie")
    )
    spec = MergeSpec(("k",), tie_breakers=("_tie",))
    return merge(tgt, src, spec).drop("_tie")


_TEXT_KEY = "CASE WHEN user_id % 7 = 0 THEN concat('x', user_id) ELSE concat('0', user_id) END"


@query(
    "merge_key_cast",
    fx.merge_sql(
        f"SELECT user_id, event_type, value FROM ({fx.TARGET}) t",
        "SELECT TRY_CAST(k AS BIGINT) AS user_id, event_type, value, _change_type FROM ("
        + fx.last_sql(
            f"SELECT {_TEXT_KEY} AS k, event_type, value, _change_type, _commit_version, event_id FROM ({fx.POST}) p",
            "k",
            _NEWEST,
        )
        + ") s",
        ["user_id"],
        ["user_id", "event_type", "value"],
    ),
)
def merge_key_cast(spark, sf):
    """Keys come as text, the target has numbers; what is no number becomes NULL and matches nothing."""
    tgt = fx.target(spark, sf).select("user_id", "event_type", "value")
    src = ops.postimages(fx.feed(spark, sf)).select(
        F.expr(_TEXT_KEY).alias("user_id"),
        "event_type",
        "value",
        "_change_type",
        "_commit_version",
        F.col("event_id").alias("_tie"),
    )
    return merge(tgt, src, MergeSpec(("user_id",), tie_breakers=("_tie",))).drop("_tie")


@query(
    "merge_composite_key",
    fx.merge_sql(
        fx.last_sql(f"{fx.POST} AND _commit_version < 10 AND _change_type <> 'delete'", "user_id, event_type", _NEWEST)
        .replace("SELECT * EXCLUDE (rn)", "SELECT user_id, event_id, event_type, value, props", 1),
        fx.last_sql(f"{fx.POST} AND _commit_version >= 10", "user_id, event_type", _NEWEST),
        ["user_id", "event_type"],
        COLS,
    ),
)
def merge_composite_key(spark, sf):
    f = ops.postimages(fx.feed(spark, sf))
    spec = _spec(keys=("user_id", "event_type"))
    base = merge(None, ops.without_tombstones(ops.up_to(f, 9)), spec)
    return merge(base, ops.newer_than(f, 9), spec)


@query(
    "merge_metrics",
    fx.merge_sql(
        fx.TARGET,
        _LAST,
        ["user_id"],
        COLS,
        select='SELECT _action, count(*) AS "rows" FROM j GROUP BY 1',
    ),
)
def metrics(spark, sf):
    return merge_metrics(fx.target(spark, sf), ops.postimages(fx.feed(spark, sf)), _spec())


def _side(prefix):
    return ", ".join(f"{prefix}_{c} AS {c}" for c in COLS)


@query(
    "merge_change_feed",
    fx.merge_sql(
        fx.TARGET,
        _LAST,
        ["user_id"],
        COLS,
        select=f"""SELECT {_side('s')}, 'insert' AS _change_type FROM j WHERE _action = 'insert'
UNION ALL SELECT {_side('t')}, 'delete' FROM j WHERE _action = 'delete'
UNION ALL SELECT {_side('t')}, 'update_preimage' FROM j WHERE _action = 'update'
UNION ALL SELECT {_side('s')}, 'update_postimage' FROM j WHERE _action = 'update'""",
    ),
)
def change_feed(spark, sf):
    return merge_change_feed(fx.target(spark, sf), ops.postimages(fx.feed(spark, sf)), _spec())


@query(
    "merge_schema_evolution",
    fx.merge_sql(
        f"SELECT user_id, value, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS event_type, CAST(NULL AS VARCHAR) AS props FROM ({fx.TARGET}) t",
        _LAST,
        ["user_id"],
        COLS,
    ),
)
def merge_schema_evolution(spark, sf):
    tgt = fx.target(spark, sf).select("user_id", "value")
    return merge(tgt, ops.postimages(fx.feed(spark, sf)), _spec())


@query(
    "merge_safe_cast",
    fx.merge_sql(
        f"SELECT user_id, CAST(event_id AS INTEGER) AS n FROM ({fx.TARGET}) t",
        fx.last_sql(
            f"SELECT user_id, TRY_CAST(CASE WHEN event_type = 'click' THEN props ELSE CAST(event_id AS VARCHAR) END AS INTEGER) AS n, _change_type, _commit_version, event_id FROM ({fx.POST}) p",
            "user_id",
            _NEWEST,
        ),
        ["user_id"],
        ["user_id", "n"],
    ),
)
def merge_safe_cast(spark, sf):
    tgt = fx.target(spark, sf).select("user_id", F.col("event_id").cast("int").alias("n"))
    text = F.when(F.col("event_type") == "click", F.col("props")).otherwise(F.col("event_id").cast("string"))
    src = ops.postimages(fx.feed(spark, sf)).withColumn("n", text)
    src = src.select("user_id", "n", "_change_type", "_commit_version", "_commit_timestamp")
    return merge(tgt, src, MergeSpec(("user_id",)))


_UPPER = (
    "SELECT user_id, event_id, upper(event_type) AS event_type, value * 2 AS value, props, "
    "_change_type, _commit_version FROM {} WHERE event_type IN ('click', 'purchase', 'error')"
)


@query(
    "merge_transform_sql",
    fx.merge_sql(
        fx.TARGET, fx.last_sql(_UPPER.format(f"({fx.POST}) p"), "user_id", _NEWEST), ["user_id"], COLS
    ),
)
def merge_transform_sql(spark, sf):
    return _run(spark, sf, transform_sql=_UPPER.format("__src"))


_NO_TYPE = "SELECT user_id, event_id, event_type, value, props, _commit_version FROM {}"


@query(
    "merge_transform_drops_type",
    fx.merge_sql(
        fx.TARGET,
        fx.last_sql(_NO_TYPE.format(f"({fx.POST}) p"), "user_id", _NEWEST),
        ["user_id"],
        COLS,
        typed=False,
    ),
)
def merge_transform_drops_type(spark, sf):
    return _run(spark, sf, transform_sql=_NO_TYPE.format("__src"))


def _transform(name, sql):
    @query(name, sql.replace("__src", f"({fx.FEED})"))
    def run(spark, sf):
        return sql_transform(fx.feed(spark, sf), sql)


_transform(
    "transform_agg",
    "SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS n, max(value) AS top FROM __src s GROUP BY user_id, event_type",
)
_transform(
    "transform_window",
    "SELECT user_id, event_id, value FROM (SELECT user_id, event_id, value, row_number() OVER "
    "(PARTITION BY user_id ORDER BY value DESC, event_id) AS place FROM __src s) r WHERE place <= 3",
)
_transform(
    "transform_self_join",
    "SELECT a.user_id, a.event_id, b.top FROM __src a JOIN (SELECT user_id, max(value) AS top FROM __src c GROUP BY user_id) b ON a.user_id = b.user_id AND a.value = b.top",
)
_transform(
    "transform_union",
    "SELECT user_id, value FROM __src a WHERE event_type = 'click' UNION SELECT user_id, value FROM __src b WHERE event_type = 'view'",
)


def _double_clicks(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Keep clicks and errors, double their value, drop the payload."""
    kept = batch.filter(pc.is_in(batch["event_type"], pa.array(["click", "error"])))
    names = ["user_id", "event_id", "event_type", "_change_type", "_commit_version"]
    columns = [kept[n] for n in names] + [pc.multiply(kept["value"], 2.0)]
    return pa.RecordBatch.from_arrays(columns, names=[*names, "value"])


_ARROW_SCHEMA = (
    "user_id bigint, event_id bigint, event_type string, _change_type string, "
    "_commit_version bigint, value double"
)
_ARROW_SQL = (
    "SELECT user_id, event_id, event_type, _change_type, _commit_version, value * 2 AS value "
    f"FROM ({fx.POST}) p WHERE event_type IN ('click', 'error')"
)


@query("arrow_transform", _ARROW_SQL)
def arrow(spark, sf):
    return arrow_transform(ops.postimages(fx.feed(spark, sf)), _double_clicks, _ARROW_SCHEMA)


@query(
    "merge_transform_arrow",
    fx.merge_sql(
        f"SELECT user_id, event_id, event_type, value FROM ({fx.TARGET}) t",
        fx.last_sql(_ARROW_SQL, "user_id", _NEWEST),
        ["user_id"],
        ["user_id", "event_id", "event_type", "value"],
    ),
)
def merge_arrow(spark, sf):
    tgt = fx.target(spark, sf).drop("props")
    src = ops.postimages(fx.feed(spark, sf))
    return merge(tgt, src, _spec(transform_arrow=_double_clicks, transform_schema=_ARROW_SCHEMA))


# The user's own functions in a transform ---------------------------------------------------------


class _Halves:
    """Two rows for a value, the second of which takes the rest."""

    def eval(self, value: float):
        if value is not None:
            low = float(int(value) // 2)
            yield "low", low
            yield "high", value - low


def _spread(values: pd.Series) -> float:
    return float(values.max() - values.min())


@query(
    "transform_udtf",
    f"""WITH f AS ({fx.POST}) SELECT event_id, 'low' AS half, CAST(CAST(trunc(value) AS BIGINT) // 2 AS DOUBLE) AS amount FROM f WHERE event_type = 'click'
UNION ALL SELECT event_id, 'high', value - CAST(CAST(trunc(value) AS BIGINT) // 2 AS DOUBLE) FROM f WHERE event_type = 'click'""",
)
def transform_udtf(spark, sf):
    """A table function of the user's, called beside each row of the batch."""
    source = fx.feed(spark, sf).where("_change_type <> 'update_preimage'")
    sql = "SELECT event_id, half, amount FROM __src, LATERAL halves(value) WHERE event_type = 'click' -- halves(x)"
    return sql_transform(source, sql, {"halves": F.udtf(_Halves, returnType="half string, amount double", useArrow=True)})


@query(
    "transform_udaf",
    f"SELECT user_id, max(value) - min(value) AS spread, 'spread(value)' AS text FROM ({fx.POST}) f GROUP BY user_id HAVING max(value) - min(value) > 40",
)
def transform_udaf(spark, sf):
    """A grouped aggregate of the user's."""
    source = fx.feed(spark, sf).where("_change_type <> 'update_preimage'")
    sql = "SELECT user_id, Spread(value) AS spread, 'spread(value)' AS text FROM __src GROUP BY user_id HAVING SPREAD(value) > 40"
    return sql_transform(source, sql, {"spread": F.pandas_udf(_spread, "double")})


def _accepted(make) -> bool:
    try:
        make()
    except ValueError:
        return False
    return True


@query(
    "key_validation",
    """SELECT column_name AS key, column_name IN ('user_id', 'event_type') AS after_transform, true AS without_transform
FROM (DESCRIBE events) UNION ALL SELECT name, false, false FROM (VALUES ('_change_type'), ('_commit_version')) t(name)""",
)
def key_validation(spark, sf):
    """Which columns of the events may be merge keys, with a transform that keeps some of them and without."""
    events = fx.table(spark, sf, "events").withColumns({"_change_type": F.lit("insert"), "_commit_version": F.lit(0)})
    kept = "SELECT user_id, event_type, _change_type, _commit_version FROM __src"
    rows = [
        tuple([c, *(_accepted(lambda c=c, sql=sql: prepare_source(events, MergeSpec((c,), transform_sql=sql))) for sql in (kept, None))])
        for c in events.columns
    ]
    return spark.createDataFrame(rows, "key string, after_transform boolean, without_transform boolean")
