"""Compaction, clustering and stale-file reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.functions.zorder import bits_for, interleave, quantile_ranks
from changeflow.schema import column

TARGET_FILE_BYTES = 256 * 1024 * 1024
SAFE_RETENTION_HOURS = 168
REPORTED_PATHS = 100


def compaction_plan(
    files: DataFrame, partition_by: Sequence[str], target_bytes: int = TARGET_FILE_BYTES
) -> DataFrame:
    """Per partition, how many small files become how many files of the target size.

    ``files`` has the partition columns and ``size_bytes``. Files of the target size stay, and so
    does a partition that would not end with fewer files.
    """
    small = files.where(F.col("size_bytes") < target_bytes)
    plan = small.groupBy(*partition_by).agg(
        F.count(F.lit(1)).alias("files_removed"),
        F.greatest(F.ceil(F.sum("size_bytes") / F.lit(target_bytes)), F.lit(1)).cast("bigint").alias(
            "files_added"
        ),
    )
    return plan.where(F.col("files_removed") > F.col("files_added"))


def compaction_report(plan: DataFrame) -> DataFrame:
    """Totals over a compaction plan."""
    return plan.agg(
        F.coalesce(F.sum("files_added"), F.lit(0)).alias("files_added"),
        F.coalesce(F.sum("files_removed"), F.lit(0)).alias("files_removed"),
        F.count(F.lit(1)).alias("partitions_optimized"),
    )


def compacted(df: DataFrame, total_bytes: int, target_bytes: int = TARGET_FILE_BYTES) -> DataFrame:
    """The same rows in about ``total_bytes / target_bytes`` even partitions, ready to write."""
    return df.repartition(max(1, -(-total_bytes // target_bytes)))


def zorder_key(df: DataFrame, columns: Sequence[str], partitions: int = 1) -> Column:
    """The curve's key; it is the finer, the more partitions it has to tell apart."""
    bits = bits_for(partitions, len(columns))
    return interleave(quantile_ranks(df, columns, bits), bits)


def zorder_cluster(
    df: DataFrame,
    columns: Sequence[str],
    partitions: int,
    spread: Column | None = None,
    within: Sequence[str] = (),
) -> DataFrame:
    """Rows laid out along the z-order curve of ``columns``, in range partitions.

    Rows of one key may be many, so ``spread`` (a hash of the row unless given) orders them
    further and the range partitioner can cut between them. Pass a row id, such as file and row
    index, where whole rows repeat. ``within`` names columns, such as a bucket, to sort by first.
    """
    # Along one column the curve is its order.
    key = column(columns[0]) if len(columns) == 1 else zorder_key(df, columns, partitions)
    rest = F.xxhash64(*[column(c) for c in df.columns]) if spread is None else spread
    keyed = df.withColumn("__z", key).withColumn("__spread", rest)
    return (
        keyed.repartitionByRange(partitions, *within, "__z", "__spread")
        .sortWithinPartitions(*within, "__z")
        .drop("__z", "__spread")
    )


def stale_files(
    listing: DataFrame,
    live: DataFrame,
    retention_hours: int = SAFE_RETENTION_HOURS,
    enforce_retention: bool = True,
) -> DataFrame:
    """Files of ``listing`` (``path, age_hours``) no live commit names, older than the retention.

    This is a report; nothing is deleted.
    """
    if enforce_retention and retention_hours < SAFE_RETENTION_HOURS:
        raise ValueError(
            f"retention of {retention_hours} h is below the safe {SAFE_RETENTION_HOURS} h; "
            "set enforce_retention=False to accept it"
        )
    old = listing.where(F.col("age_hours") > retention_hours)
    return old.join(live.select("path"), "path", "left_anti")


def sample_paths(stale: DataFrame, n: int = REPORTED_PATHS) -> DataFrame:
    """The first ``n`` paths for display."""
    return stale.select("path").orderBy("path").limit(n)


def list_files(spark, folder: str) -> DataFrame:
    """``path, size_bytes, age_hours`` of all data files below ``folder``; contents stay unread."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(folder)
    )
    age = (F.unix_seconds(F.current_timestamp()) - F.unix_seconds("modificationTime")) / 3600.0
    return files.select("path", F.col("length").alias("size_bytes"), age.alias("age_hours"))
