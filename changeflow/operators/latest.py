"""Keep the newest change of every merge key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeflow.schema import (
    CHANGE_TYPE,
    COMMIT_TIMESTAMP,
    COMMIT_VERSION,
    DELETE,
    column,
    hashable_columns,
    require_columns,
)


def recency_order(
    df: DataFrame,
    keys: Sequence[str],
    order_by: str | None = None,
    tie_breakers: Sequence[str] | None = None,
) -> list[Column]:
    """Sort expressions that put the winning row of a key first.

    NULLs of a descending column come first, as in the engine whose results this follows.
    Without explicit tie breakers the order ends in a hash of the row, so a recomputed task
    picks the same winner again.
    """
    if order_by:
        require_columns(df, [order_by], "dedupe order")
        order = [column(order_by).desc_nulls_first()]
    elif COMMIT_VERSION in df.columns:
        order = [column(COMMIT_VERSION).desc_nulls_first()]
    elif "sequence_number" in df.columns:
        order = [column("sequence_number").desc_nulls_first()]
    else:
        order = [column(keys[0]).asc_nulls_last()]
    if tie_breakers is not None:
        return order + [column(c).desc_nulls_first() for c in tie_breakers]
    if COMMIT_TIMESTAMP in df.columns:
        order.append(column(COMMIT_TIMESTAMP).desc_nulls_first())
    if CHANGE_TYPE in df.columns:
        order.append(F.coalesce(column(CHANGE_TYPE) == DELETE, F.lit(False)).asc())
    return order + [F.xxhash64(*[column(c) for c in hashable_columns(df)]).asc()]


def latest_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order_by: str | None = None,
    tie_breakers: Sequence[str] | None = None,
) -> DataFrame:
    """One row per key, the first in ``recency_order``; NULL keys form one group.

    ``row_number() <= 1`` lets Spark keep one row per key in each map task before the shuffle,
    so a key that holds a third of the input sends one row per task, not all its rows.
    """
    require_columns(df, keys, "dedupe key")
    order = recency_order(df, keys, order_by, tie_breakers)
    w = Window.partitionBy(*[column(k) for k in keys]).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def replay(
    feed: DataFrame,
    keys: Sequence[str],
    order_by: str | None = None,
    tie_breakers: Sequence[str] | None = None,
) -> DataFrame:
    """Current state from a whole feed: latest change per key, deleted keys left out."""
    from changeflow.operators.feed import postimages, strip_metadata, without_tombstones

    last = latest_per_key(postimages(feed), keys, order_by, tie_breakers)
    return strip_metadata(without_tombstones(last))
