"""Whole jobs on target tables: create, inspect, optimise, report stale files, track snapshots."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.operators import datagen, maintenance
from changeflow.operators.diff import diff_snapshots
from changeflow.operators.feed import postimages
from changeflow.operators.inspect import MAX_PREVIEW, preview, schema_rows
from changeflow.operators.merge import MergeSpec
from changeflow.sinks.table import BUCKET, Outcome, VersionedTable
from changeflow.sources.commits import history, live_files, read_log


def create_table(
    spark: SparkSession,
    path: str,
    rows: int = 200_000,
    commits: int = 1,
    columns: int = 30,
    zorder_by: Sequence[str] = (),
    overwrite: bool = False,
) -> VersionedTable:
    """A wide test table of exactly ``rows`` rows in so many commits, z-ordered if asked."""
    table = VersionedTable(spark, path)
    ids = datagen.row_ids(spark, rows)
    commit = datagen.commit_of(rows, commits)
    for number in range(commits):
        mode = "overwrite" if overwrite and number == 0 else "append"
        table.apply(datagen.wide_table(ids.where(commit == number), columns), mode)
    if zorder_by:
        optimize(table, zorder_by)
    return table


def produce_events(
    table: VersionedTable, batches: int, rows: int, update_fraction: float = 0.3, now: str = "2024-06-01 00:00:00"
) -> None:
    """Append batches of sample transactions; some take up event ids of earlier rows again.

    How far the ids have come is part of each commit, so a later call goes on from there.
    """
    for _ in range(batches):
        first = table.snapshot().progress.get("producer", {}).get("rows", 0)
        ids = table.spark.range(first, first + rows)
        batch = datagen.sample_events(ids, update_fraction, table.current_version() + 1, now)
        table.apply(batch, "append", job="producer", progress={"rows": first + rows})


@dataclass(frozen=True)
class OptimizeReport:
    mode: str
    starting_version: int
    new_version: int
    files_added: int
    files_removed: int
    partitions_optimized: int
    duration_ms: int


def optimize(
    table: VersionedTable, zorder_by: Sequence[str] = (), target_bytes: int = maintenance.TARGET_FILE_BYTES
) -> OptimizeReport:
    """Rewrite the table into files of about ``target_bytes``, along a z-order curve if asked.

    The buckets of a merged table count as partitions and stay; without z-order the session's
    advisory partition size takes the place of ``target_bytes`` there.
    """
    started = time.monotonic()
    before = table.snapshot()
    size = sum(e.bytes for e in before.extents)

    bucket = [BUCKET] if before.keys else []

    def layout(df: DataFrame) -> DataFrame:
        if zorder_by:
            parts = max(1, -(-size // target_bytes))
            # File and row index tell whole-row copies apart, so a run of them can be cut too.
            row = F.xxhash64("_metadata.file_path", "_metadata.row_index")
            return maintenance.zorder_cluster(df, zorder_by, parts, row, bucket)
        if bucket:
            return df.hint("rebalance", BUCKET)
        return maintenance.compacted(df, size, target_bytes)

    table.rewrite(layout, "ZORDER" if zorder_by else "OPTIMIZE")
    after = table.snapshot()
    return OptimizeReport(
        "zorder" if zorder_by else "compact",
        before.version,
        after.version,
        sum(e.files for e in after.extents),
        sum(e.files for e in before.extents),
        len({e.bucket for e in before.extents}),
        int((time.monotonic() - started) * 1000),
    )


def change_buckets(table: VersionedTable, buckets: int) -> None:
    """Divide a merged table into another number of buckets, as it outgrows the old one."""
    if not table.snapshot().keys:
        raise ValueError("only a merged table has buckets")
    table.rewrite(lambda df: df.hint("rebalance", BUCKET), "REBUCKET", buckets)


def stale_table_files(
    table: VersionedTable,
    retention_hours: int = maintenance.SAFE_RETENTION_HOURS,
    enforce_retention: bool = True,
) -> DataFrame:
    """``path, size_bytes, age_hours`` of files no live commit needs; nothing is deleted."""
    live = live_files(read_log(table.spark, table.log_path))
    parent = F.regexp_extract("file", r"(data/.*)/[^/]*$", 1)
    files = maintenance.list_files(table.spark, f"{table.path}/data")
    files = files.withColumnRenamed("path", "file").withColumn("path", parent)
    stale = maintenance.stale_files(files, live, retention_hours, enforce_retention)
    return stale.select(F.col("file").alias("path"), "size_bytes", "age_hours")


def inspect(table: VersionedTable) -> dict[str, DataFrame]:
    """Summary, schema and newest commits of a table."""
    return {
        "table": table.describe(),
        "schema": schema_rows(table.read()),
        "commits": history(table.newest_log(10)),
    }


@dataclass(frozen=True)
class Preview:
    columns: list[str]
    rows: list[list[str]]
    limit: int

    @property
    def truncated(self) -> bool:
        return len(self.rows) >= self.limit


def show_preview(df: DataFrame, limit: int = 100, where: str | None = None) -> Preview:
    """A preview on the driver: 1,000 rows at most."""
    limit = min(max(limit, 1), MAX_PREVIEW)
    return Preview(df.columns, [list(r) for r in preview(df, limit, where).collect()], limit)


def track_snapshot(table: VersionedTable, snapshot: DataFrame, keys: Sequence[str]) -> Outcome:
    """Bring a table to a snapshot of a source that keeps no change feed.

    The difference becomes one commit, so from the second snapshot on the table has the feed the
    source lacks. Keys name at most one row and are not NULL.
    """
    spec = MergeSpec(tuple(keys), tie_breakers=())
    if table.current_version() < 0:
        return table.apply(snapshot, "merge", spec)
    return table.apply(postimages(diff_snapshots(table.read(), snapshot, keys)), "merge", spec)
