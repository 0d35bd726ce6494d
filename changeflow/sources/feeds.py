"""Change feeds that other systems wrote: parquet folders and, with its connector, Delta tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from changeflow.sinks.files import Folder


def read_feed_folder(spark: SparkSession, path: str) -> DataFrame:
    """A feed stored as parquet below ``path/_commit_version=N``."""
    return spark.read.parquet(path)


def stream_changes(spark: SparkSession, path: str, schema: T.StructType, max_files: int) -> DataFrame:
    """New files of such a feed as they appear; files, not commits, make up a micro-batch.

    ``changeflow.sources.feed_source.stream_feed`` keeps commits whole.
    """
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def _delta(load):
    try:
        return load()
    except Exception as e:
        if "DATA_SOURCE_NOT_FOUND" in str(e) or "Failed to find" in str(e):
            raise RuntimeError("the Delta connector is not on the class path") from e
        raise


def read_delta_changes(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """The change data feed of a Delta table, all images; needs the connector."""
    if end < start:
        raise ValueError(f"end version {end} lies before start version {start}")
    reader = (
        spark.read.format("delta")
        .option("readChangeFeed", "true")
        .option("startingVersion", start)
        .option("endingVersion", end)
    )
    return _delta(lambda: reader.load(path))


class DeltaSource:
    """A Delta table to transfer from: its log names the versions, its connector reads the feed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self.log = Folder(spark, self.log_path)

    @property
    def log_path(self) -> str:
        return f"{self.path}/_delta_log"

    def current_version(self) -> int:
        names = [n.removesuffix(".json") for n in self.log.names() if n.endswith(".json")]
        return max((int(n) for n in names if n.isdigit()), default=-1)

    def read_feed(self, start: int, end: int) -> DataFrame:
        return read_delta_changes(self.spark, self.path, start, end)


def stream_delta_changes(spark: SparkSession, path: str, start: int, max_files: int = 1_000) -> DataFrame:
    """The change data feed of a Delta table as a stream; needs the connector."""
    reader = (
        spark.readStream.format("delta")
        .option("readChangeFeed", "true")
        .option("startingVersion", start)
        .option("maxFilesPerTrigger", max_files)
    )
    return _delta(lambda: reader.load(path))
