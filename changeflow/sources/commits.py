"""Commit logs: one JSON-lines file of actions per version, named by its number.

Reading one gives row counts, history and live files without opening a data file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_NAME = r"([0-9]+)\.json"


def read_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``version, action`` for each non-blank line of ``path/NNN.json``, or of the files listed."""
    lines = spark.read.text(path, pathGlobFilter="*.json")
    return log_lines(lines.select("value", F.col("_metadata.file_name").alias("file_name")))


def log_lines(lines: DataFrame) -> DataFrame:
    """``version, action`` from columns ``value`` and ``file_name``."""
    version = F.regexp_extract("file_name", FILE_NAME, 1).try_cast("bigint")
    return lines.select(version.alias("version"), F.trim("value").alias("action")).where(
        F.col("version").isNotNull() & (F.col("action") != "")
    )


def num_records(action: Column) -> Column:
    """Rows an add action reports; its statistics are a JSON string or an object."""
    stats = F.get_json_object(action, "$.add.stats")
    return F.get_json_object(stats, "$.numRecords").try_cast("bigint")


def commit_rows(log: DataFrame) -> DataFrame:
    """``version, rows``: rows added by each commit, 0 without adds; broken lines count nothing."""
    n = num_records(F.col("action"))
    return log.groupBy("version").agg(
        F.coalesce(F.sum(F.when(n >= 0, n)), F.lit(0)).alias("rows")
    )


def history(log: DataFrame, newest: int = 10) -> DataFrame:
    """``version, timestamp, operation`` of the newest commits."""
    millis = F.get_json_object("action", "$.commitInfo.timestamp").try_cast("bigint")
    operation = F.get_json_object("action", "$.commitInfo.operation")
    text = F.date_format(F.timestamp_millis("millis"), "yyyy-MM-dd HH:mm:ss 'UTC'")
    return (
        log.groupBy("version")
        .agg(F.max(millis).alias("millis"), F.max(operation).alias("operation"))
        .orderBy(F.col("version").desc())
        .limit(newest)
        .select(
            "version",
            F.coalesce(text, F.lit("")).alias("timestamp"),
            F.coalesce("operation", F.lit("")).alias("operation"),
        )
    )


def live_files(log: DataFrame) -> DataFrame:
    """``path, rows, size_bytes`` of files added and not removed by a later commit."""
    action = F.col("action")
    added, removed = F.get_json_object(action, "$.add.path"), F.get_json_object(action, "$.remove.path")
    last = (
        log.select(
            F.coalesce(added, removed).alias("path"),
            # In one commit a removal comes before an addition of the same path.
            F.struct(
                "version",
                added.isNotNull().alias("live"),
                num_records(action).alias("rows"),
                F.get_json_object(action, "$.add.size").try_cast("bigint").alias("size_bytes"),
            ).alias("state"),
        )
        .where(F.col("path").isNotNull())
        .groupBy("path")
        .agg(F.max("state").alias("state"))
    )
    return last.where("state.live").select("path", "state.rows", "state.size_bytes")


def table_stats(files: DataFrame) -> DataFrame:
    """``num_files, estimated_rows``: unknown counts are skipped, negative ones count 0."""
    return files.agg(
        F.count(F.lit(1)).alias("num_files"),
        F.coalesce(F.sum(F.greatest("rows", F.lit(0))), F.lit(0)).alias("estimated_rows"),
    )
