"""A change feed from two snapshots of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow.operators.merge import ACTION, images
from changeflow.schema import CHANGE_TYPE, DELETE, INSERT, column, require_columns

#: Ranges on each of the two levels of digests; at most their product is broadcast, as 8 MB of numbers.
RANGES = 1_024


def diff_snapshots(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Feed rows that turn ``old`` into ``new``; a key names at most one row per snapshot.

    Rows with a NULL key match nothing, so they skip the join (and its shuffle): old ones are
    deletes, new ones inserts. Both snapshots have the same columns.
    """
    require_columns(old, keys, "old snapshot")
    require_columns(new, old.columns, "new snapshot")
    cols = old.columns
    new = new.select(*[column(c) for c in cols])
    no_null = [column(k).isNotNull() for k in keys]
    complete = no_null[0]
    for c in no_null[1:]:
        complete = complete & c

    o = old.where(complete).select(
        *[column(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.struct(*[column(c) for c in cols]).alias("old"),
    )
    n = new.where(complete).select(
        *[column(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.struct(*[column(c) for c in cols]).alias("new"),
    )
    action = (
        F.when(F.col("old").isNull(), "insert")
        .when(F.col("new").isNull(), "delete")
        .otherwise("update")
    )
    changed = (
        o.join(n, [f"__k{i}" for i in range(len(keys))], "full_outer")
        .where(~F.col("old").eqNullSafe(F.col("new")))
        .select(action.alias(ACTION), "old", "new")
    )
    return (
        images(changed)
        .unionByName(old.where(~complete).withColumn(CHANGE_TYPE, F.lit(DELETE)))
        .unionByName(new.where(~complete).withColumn(CHANGE_TYPE, F.lit(INSERT)))
    )


def _row_digest(df: DataFrame) -> Column:
    """64 bits of a row. Hashes pass over NULLs, so where they are is hashed beside the values."""
    simple = (T.NumericType, T.StringType, T.BinaryType, T.BooleanType, T.DatetimeType)
    values = []
    for f in df.schema.fields:
        c = column(f.name)
        values.append(c if isinstance(f.dataType, simple) else F.to_json(F.struct(c), {"ignoreNullFields": "false"}))
        if f.nullable:
            values.append(c.isNull())
    return F.xxhash64(*values)


def _digests(df: DataFrame, group: str) -> DataFrame:
    """Digests of the rows of each group that don't depend on their order; copies count."""
    low, high = F.col("__d").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("__d", 32)
    return df.groupBy(group).agg(
        F.count("*").alias("n"), F.bit_xor("__d").alias("x"), F.sum(low).alias("low"), F.sum(high).alias("high")
    )


def _differing(old: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """The groups whose digests are not the same on both sides."""
    o, n = (_digests(side, group).select(group, F.struct("n", "x", "low", "high").alias(name)) for side, name in ((old, "o"), (new, "n")))
    return o.join(n, group, "full_outer").where(~F.col("o").eqNullSafe(F.col("n"))).select(group)


def diff_by_digest(
    old: DataFrame, new: DataFrame, keys: Sequence[str], ranges: tuple[Column, Column] | None = None
) -> tuple[DataFrame, int]:
    """As ``diff_snapshots``, for snapshots that differ little; also the number of key ranges it compared.

    Rows are gathered by ranges of keys, of which only digests are compared: first of ``RANGES`` coarse ones,
    then, where these differ, of ``RANGES`` fine ones in each. Only rows of fine ranges that differ are
    joined; no other row is shuffled. ``ranges`` are two integer columns made of the keys, the coarse and the
    fine range (unique on its own); by default hashes of the keys. Two ranges with the same number of rows
    and different rows have equal digests in one of 2 ** 64 cases. Rows with a NULL key take no
    part in this: as in ``diff_snapshots`` old ones are deletes and new ones inserts.
    """
    require_columns(new, old.columns, "new snapshot")
    new = new.select(*[column(c) for c in old.columns])
    if ranges is None:
        h = F.xxhash64(*[column(k) for k in keys])
        ranges = F.pmod(h, F.lit(RANGES)), F.pmod(h, F.lit(RANGES * RANGES))
    coarse, fine = (c.cast("bigint") for c in ranges)
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | column(k).isNull()
    digested = [coarse.alias("__c"), fine.alias("__f"), _row_digest(old).alias("__d")]
    o, n = (d.where(~no_key).select(*digested) for d in (old, new))
    spark = old.sparkSession
    first = [r[0] for r in _differing(o, n, "__c").collect()]  # one row a coarse range
    found = F.broadcast(spark.createDataFrame([(c,) for c in first], "__c bigint"))
    second = [r[0] for r in _differing(*(d.join(found, "__c", "left_semi") for d in (o, n)), "__f").collect()]
    differing = F.broadcast(spark.createDataFrame([(f,) for f in second], "__f bigint"))

    def kept(d: DataFrame) -> DataFrame:
        some = d.where(~no_key).withColumn("__f", fine).join(differing, "__f", "left_semi")
        return some.select(*[column(c) for c in d.columns]).unionByName(d.where(no_key))

    return diff_snapshots(kept(old), kept(new), keys), len(second)
