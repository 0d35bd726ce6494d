"""Row selection on a change feed: version ranges, image filters, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeflow.schema import (
    CHANGE_TYPE,
    COMMIT_VERSION,
    DELETE,
    META,
    PREIMAGE,
    is_not_type,
    require_columns,
)


def postimages(feed: DataFrame) -> DataFrame:
    """Drop pre-update images; rows without a type stay."""
    return feed.where(is_not_type(PREIMAGE))


def without_tombstones(feed: DataFrame) -> DataFrame:
    """Drop delete rows. A source without change types (an event log) passes unchanged."""
    if CHANGE_TYPE not in feed.columns:
        return feed
    return feed.where(is_not_type(DELETE))


def strip_metadata(feed: DataFrame) -> DataFrame:
    return feed.drop(*META)


def read_changes(feed: DataFrame, start: int, end: int) -> DataFrame:
    """Changes of the versions ``start..end``, both included, without pre-update images.

    On a feed partitioned by version the range prunes folders, so no other commit is opened.
    """
    require_columns(feed, META, "not a change feed")
    if end < start:
        raise ValueError(f"end version {end} lies before start version {start}")
    return postimages(feed.where(F.col(COMMIT_VERSION).between(start, end)))


def latest_version(feed: DataFrame) -> int:
    """Highest version in the feed, -1 if it has none."""
    return feed.agg(F.coalesce(F.max(COMMIT_VERSION), F.lit(-1))).first()[0]


baseline_version = latest_version


def end_version(current: int, wanted: int | None = None) -> int:
    """The last version to read: never beyond the current one."""
    return current if wanted is None else min(wanted, current)


def up_to(feed: DataFrame, last: int) -> DataFrame:
    return feed.where(F.col(COMMIT_VERSION) <= last)


def newer_than(feed: DataFrame, last_done: int) -> DataFrame:
    return feed.where(F.col(COMMIT_VERSION) > last_done)


def resolve_start(start_version: int | None, last_done: int | None) -> int:
    """The version after which reading resumes: explicit start, else stored progress, else -1."""
    if start_version is not None:
        return start_version - 1
    return -1 if last_done is None else last_done


def change_counts(feed: DataFrame) -> DataFrame:
    """Rows per version and change type."""
    return feed.groupBy(COMMIT_VERSION, CHANGE_TYPE).agg(F.count(F.lit(1)).alias("rows"))


def commit_sizes(feed: DataFrame) -> DataFrame:
    """One row per commit: ``version`` and exact feed row count."""
    return feed.groupBy(F.col(COMMIT_VERSION).alias("version")).agg(
        F.count(F.lit(1)).alias("rows")
    )
