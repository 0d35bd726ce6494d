"""Partitioned event logs: normalise raw records, resume by offset, track offsets.

A raw record has ``partition_id``, ``offset``, ``sequence_number``, ``enqueued_time``, ``body``
(bytes) and ``properties`` (a map of strings). Normalised, it has ``EVENT_SCHEMA``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow.schema import EVENT_SCHEMA

# Offsets given as a dict: of so many log partitions they travel inside the plan, of so many they are
# broadcast. A table of offsets is joined, by Spark's own choice of how.
INLINE_PARTITIONS = 32
BROADCAST_PARTITIONS = 100_000


def _body_text(body: Column, tag: str) -> Column:
    """Valid UTF-8 as it is, other bytes as a JSON object holding them in base64, NULL as ''."""
    text = body.cast("string")
    # base64() wraps long values; the wire format has no line breaks.
    packed = F.regexp_replace(F.base64(body), r"\s", "")
    packed = F.concat(F.lit('{"' + tag + '":"'), packed, F.lit('"}'))
    return F.when(body.isNull(), "").when(F.is_valid_utf8(text), text).otherwise(packed)


def normalize_events(raw: DataFrame, binary_tag: str = "_b64") -> DataFrame:
    """Raw log records with the six columns of ``EVENT_SCHEMA``."""
    kinds = dict(raw.dtypes)
    body = F.col("body") if kinds["body"] == "binary" else F.col("body").cast("binary")
    enqueued = F.col("enqueued_time")
    epoch = F.lit("1970-01-01 00:00:00").cast(raw.schema["enqueued_time"].dataType)
    properties = F.col("properties")
    if isinstance(raw.schema["properties"].dataType, T.MapType):
        as_text = properties.cast("map<string,string>")
        properties = F.to_json(as_text, {"ignoreNullFields": "false"})
    return raw.select(
        F.coalesce(F.col("partition_id").cast("string"), F.lit("")).alias("partition_id"),
        F.col("offset").cast("string").alias("offset"),
        F.coalesce(F.col("sequence_number").cast("bigint"), F.lit(-1)).alias("sequence_number"),
        F.when(enqueued >= epoch, enqueued).cast("timestamp").alias("enqueued_time"),
        _body_text(body, binary_tag).alias("body"),
        properties.alias("properties"),
    )


def select_partitions(events: DataFrame, partitions: Sequence[str] | str | None) -> DataFrame:
    """Only these log partitions; a comma list is split, nothing given means all."""
    if isinstance(partitions, str):
        partitions = [p.strip() for p in partitions.split(",") if p.strip()]
    if not partitions:
        return events
    return events.where(F.col("partition_id").isin(list(partitions)))


def initial_position(text: str) -> str:
    """``earliest`` or ``latest`` from the words users write."""
    word = text.strip().lower()
    if word in ("", "latest", "newest"):
        return "latest"
    if word in ("earliest", "oldest", "beginning"):
        return "earliest"
    raise ValueError(f"a log is read from its earliest or its latest event on, not from '{text}'")


def batch_offsets(events: DataFrame) -> DataFrame:
    """Highest sequence number per log partition."""
    return events.groupBy("partition_id").agg(F.max("sequence_number").alias("sequence_number"))


def merge_offsets(known: DataFrame, seen: DataFrame) -> DataFrame:
    """Per partition the higher of both; partitions of only one side keep their value."""
    return batch_offsets(
        known.select("partition_id", "sequence_number").unionByName(
            seen.select("partition_id", "sequence_number")
        )
    )


def _offset_column(offsets: dict[str, int]) -> Column:
    if not offsets:
        return F.lit(None).cast("bigint")
    entries = [F.lit(x) for pair in sorted(offsets.items()) for x in pair]
    return F.try_element_at(F.create_map(*entries), F.col("partition_id"))


def resume_events(
    events: DataFrame,
    offsets: DataFrame | dict[str, int],
    initial: str = "latest",
    latest: DataFrame | dict[str, int] | None = None,
) -> DataFrame:
    """Events strictly after the stored offset of their partition.

    A partition without an offset is read from the start (``earliest``) or only beyond ``latest``,
    the offsets when reading began. Offsets are one row per partition; nothing runs
    while this is built.
    """
    start = initial_position(initial)
    if start == "latest" and latest is None:
        raise ValueError("initial position 'latest' needs the offsets at the start")
    tables = {"o": offsets} if start == "earliest" else {"o": offsets, "l": latest}
    after = []
    result = events
    for name, table in tables.items():
        small = isinstance(table, dict) and len(table) <= BROADCAST_PARTITIONS
        if isinstance(table, dict) and len(table) <= INLINE_PARTITIONS:
            after.append(_offset_column(table))
            continue
        if isinstance(table, dict):
            table = events.sparkSession.createDataFrame(
                sorted(table.items()), "partition_id string, sequence_number bigint"
            )
        side = table.select("partition_id", F.col("sequence_number").alias(f"__{name}"))
        result = result.join(F.broadcast(side) if small else side, "partition_id", "left")
        after.append(F.col(f"__{name}"))
    # A partition in neither table has only new events.
    after = F.coalesce(*after)
    keep = after.isNull() | (F.col("sequence_number") > after)
    return result.where(keep).select(*events.columns)


# Connectors --------------------------------------------------------------------------------


def _loaded(load):
    try:
        return load()
    except Exception as e:
        if "Failed to find data source" in str(e) or "DATA_SOURCE_NOT_FOUND" in str(e):
            raise RuntimeError("the Kafka connector is not on the class path") from e
        raise


def _last_of_each_key(headers: Column) -> Column:
    """Header names may repeat; the last value counts."""
    return F.filter(
        headers,
        lambda h, i: ~F.exists(F.slice(headers, i + 2, F.size(headers)), lambda later: later["key"] == h["key"]),
    )


def from_kafka(records: DataFrame) -> DataFrame:
    """Records of Spark's Kafka source in the raw layout (many hosted event logs speak its protocol)."""
    return records.select(
        F.col("partition").cast("string").alias("partition_id"),
        F.col("offset").cast("string").alias("offset"),
        F.col("offset").alias("sequence_number"),
        F.col("timestamp").alias("enqueued_time"),
        F.col("value").alias("body"),
        F.map_from_entries(
            F.transform(
                _last_of_each_key(F.col("headers")),
                lambda h: F.struct(h["key"].alias("key"), h["value"].cast("string").alias("value")),
            )
        ).alias("properties"),
    )


def stream_kafka(spark: SparkSession, servers: str, topic: str, max_events: int, **options) -> DataFrame:
    """Normalised events of a Kafka topic as a stream; needs the connector."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("includeHeaders", "true")
        .option("maxOffsetsPerTrigger", max_events)
    )
    for key, value in options.items():
        reader = reader.option(key, value)
    return normalize_events(from_kafka(_loaded(reader.load)))


def stream_event_files(
    spark: SparkSession, path: str, schema: T.StructType = EVENT_SCHEMA, max_files: int = 100
) -> DataFrame:
    """Raw events that arrive as parquet files."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", max_files)
        .parquet(path)
    )
