"""A change feed in parquet folders as a Spark data source, read in batches and as a stream.

A feed is a folder with one sub-folder ``_commit_version=N`` a commit. A commit counts once its sub-folder
holds a marker (``_SUCCESS``), so a half-written one is never seen, and reading stops before the first
commit without one. ``write_feed`` writes both; any other writer may, too.

The stream's offsets are commit versions, so a micro-batch is made of whole commits, at a restart too.
Files are cut into splits of about ``splitBytes``, small ones put together; a split reads the row groups that
begin in it, only the columns of the schema asked for, and hands them to Spark as Arrow batches. A batch
read opens no commit outside the versions asked for by option or by a filter on ``_commit_version``.

Options: ``path``; ``startingVersion`` (a version, or ``latest`` to begin behind what is there);
``endingVersion``; ``splitBytes``; for streams ``maxVersionsPerTrigger``, ``maxRowsPerTrigger`` (rows by the
markers; one commit at least; without effect on commits whose marker has no count) and ``checkpoint``, the
stream's checkpoint, from which a restarted reader learns where to count its limits from.
Paths are opened by pyarrow: local ones, ``hdfs``, ``viewfs``, ``s3``, ``gs``, ``abfs``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from changeflow.schema import COMMIT_VERSION
from changeflow.sinks.files import Folder

FORMAT = "changefeed"
MARKER = "_SUCCESS"
SPLIT_BYTES = 128 << 20
#: Bytes that opening a file counts for, when small files are put together.
OPEN_BYTES = 4 << 20
#: Rows of an Arrow batch.
BATCH_ROWS = 10_000
_ROW_METADATA = b"org.apache.spark.sql.parquet.row.metadata"


@dataclass(frozen=True)
class Commit:
    version: int
    rows: int | None
    files: tuple[tuple[str, int], ...]  # path and bytes


@dataclass
class FeedSplit(InputPartition):
    """Byte ranges of files, with the version each belongs to."""

    parts: tuple[tuple[str, int, int, int], ...]

    def __init__(self, parts):
        super().__init__(None)
        self.parts = tuple(parts)


class FeedFolder:
    """What is in a feed's folder, by listing it."""

    def __init__(self, path: str):
        self.system, self.root = fs.FileSystem.from_uri(path.rstrip("/"))

    def _names(self) -> list[int]:
        infos = self.system.get_file_info(fs.FileSelector(self.root, allow_not_found=True))
        names = [i.base_name.partition("=") for i in infos if i.type == fs.FileType.Directory]
        return sorted(int(v) for k, _, v in names if k == COMMIT_VERSION and v.lstrip("-").isdigit())

    def commit(self, version: int) -> Commit | None:
        """A commit's files; None while it has no marker."""
        infos = self.system.get_file_info(fs.FileSelector(f"{self.root}/{COMMIT_VERSION}={version}", recursive=True))
        by_name = {i.base_name: i for i in infos if i.type == fs.FileType.File}
        if MARKER not in by_name:
            return None
        files = sorted((i.path, i.size) for i in by_name.values() if i.base_name[0] not in "_.")
        return Commit(version, self._rows(by_name[MARKER]), tuple(files))

    def _rows(self, marker: fs.FileInfo) -> int | None:
        if not marker.size:
            return None
        with self.system.open_input_file(marker.path) as f:
            try:
                return json.loads(f.read())["rows"]
            except (ValueError, KeyError, TypeError):
                return None

    def commits(self, after: int | None, last: int | None) -> Iterator[Commit]:
        """The commits behind ``after``, up to ``last`` or the first that isn't complete."""
        for version in self._names():
            if (after is None or version > after) and (last is None or version <= last):
                commit = self.commit(version)
                if commit is None:
                    return
                yield commit

    def latest(self) -> int:
        """The last complete version, -1 if there is none."""
        last = -1
        for version in self._names():
            if self.system.get_file_info(f"{self.root}/{COMMIT_VERSION}={version}/{MARKER}").type != fs.FileType.File:
                break
            last = version
        return last

    def schema(self) -> T.StructType:
        """The data columns of the newest commit that has files, and the version."""
        for version in reversed(self._names()):
            commit = self.commit(version)
            for path, _ in commit.files[:1] if commit else ():
                with self.system.open_input_file(path) as f:
                    found = pq.read_schema(f)
                stored = (found.metadata or {}).get(_ROW_METADATA)
                data = T.StructType.fromJson(json.loads(stored)) if stored else from_arrow_schema(found)
                return T.StructType([*data.fields, T.StructField(COMMIT_VERSION, T.LongType())])
        raise ValueError(f"no complete commit with files in {self.root}: give a schema")


def cut(commits: Sequence[Commit], split_bytes: int) -> list[FeedSplit]:
    """Splits of about ``split_bytes``: large files cut, small ones together. Splits don't mix commits' order."""
    splits, held, size = [], [], 0
    for c in commits:
        for path, length in c.files:
            for begin in range(0, max(length, 1), split_bytes):
                end = min(begin + split_bytes, length)
                cost = end - begin + OPEN_BYTES
                if held and size + cost > split_bytes:
                    splits.append(FeedSplit(held))
                    held, size = [], 0
                held.append((path, begin, end, c.version))
                size += cost
    return [*splits, FeedSplit(held)] if held else splits


def fitted(column: pa.Array, wanted: pa.DataType) -> pa.Array:
    """A column in the type asked for."""
    if pa.types.is_timestamp(wanted) and pa.types.is_timestamp(column.type) and column.type != wanted:
        # Wall time and instant have the same numbers where the session's zone is UTC.
        return column.cast(pa.timestamp("us")).cast(pa.int64()).cast(wanted)
    return column if column.type == wanted else column.cast(wanted)


def _batches(path: str, split: FeedSplit, schema: T.StructType) -> Iterator[pa.RecordBatch]:
    system, _ = fs.FileSystem.from_uri(path)
    wanted = to_arrow_schema(schema)
    for name, begin, end, version in split.parts:
        with system.open_input_file(name) as opened:
            file = pq.ParquetFile(opened, coerce_int96_timestamp_unit="us")
            meta = file.metadata
            starts = [min(_offset(meta.row_group(g).column(c)) for c in range(meta.num_columns)) for g in range(meta.num_row_groups)]
            groups = [g for g, s in enumerate(starts) if begin <= s < end]
            there = set(file.schema_arrow.names)
            columns = [f.name for f in wanted if f.name in there and f.name != COMMIT_VERSION]
            for b in file.iter_batches(BATCH_ROWS, row_groups=groups, columns=columns) if groups else ():
                arrays = []
                for f in wanted:
                    if f.name == COMMIT_VERSION:
                        arrays.append(pa.array([version] * len(b), f.type))
                    elif f.name in there:
                        arrays.append(fitted(b.column(f.name), f.type))
                    else:
                        arrays.append(pa.nulls(len(b), f.type))  # a commit from before the column
                yield pa.RecordBatch.from_arrays(arrays, schema=wanted)


def _offset(column: pq.ColumnChunkMetaData) -> int:
    return column.dictionary_page_offset or column.data_page_offset


class _Reading:
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.table_schema = options["path"], schema
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))
        end, start = options.get("endingversion"), options.get("startingversion")
        self.end = None if end is None else int(end)
        self.start = start if start in (None, "latest") else int(start)

    def folder(self) -> FeedFolder:
        return FeedFolder(self.path)

    def read(self, partition: FeedSplit) -> Iterator[pa.RecordBatch]:
        return _batches(self.path, partition, self.table_schema)


class FeedReader(_Reading, DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        super().__init__(options, schema)
        self.after = None if self.start is None else self.folder().latest() if self.start == "latest" else self.start - 1

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of versions are taken; all other filters stay with Spark."""
        for f in filters:
            if getattr(f, "attribute", None) != (COMMIT_VERSION,) or not isinstance(
                f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)
            ):
                yield f
                continue
            low = f.value - 1 if isinstance(f, (EqualTo, GreaterThanOrEqual)) else f.value if isinstance(f, GreaterThan) else None
            high = f.value if isinstance(f, (EqualTo, LessThanOrEqual)) else f.value - 1 if isinstance(f, LessThan) else None
            if low is not None:
                self.after = low if self.after is None else max(self.after, low)
            if high is not None:
                self.end = high if self.end is None else min(self.end, high)

    def partitions(self) -> Sequence[FeedSplit]:
        return cut(list(self.folder().commits(self.after, self.end)), self.split_bytes)


class FeedStreamReader(_Reading, DataSourceStreamReader):
    def __init__(self, options: dict, schema: T.StructType):
        super().__init__(options, schema)
        self.versions = int(options.get("maxversionspertrigger", 0))
        self.rows = int(options.get("maxrowspertrigger", 0))
        # Without a checkpoint to look into it is not known where the stream stands until it plans a batch.
        self.last = None
        if "checkpoint" in options:
            self.last = (planned_offset(options["checkpoint"]) or self._first())["version"]

    def _first(self) -> dict:
        return {"version": self.folder().latest() if self.start == "latest" else -1 if self.start is None else self.start - 1}

    def initialOffset(self) -> dict:
        # Spark may have asked for the latest offset before.
        return self._first() if self.last is None else {"version": self.last}

    def latestOffset(self) -> dict:
        """The end of the next micro-batch; the last one again if nothing is new."""
        end, total, taken = self.last, 0, 0
        for c in self.folder().commits(self.last, self.end):
            total += c.rows or 0
            limited = self.last is not None and (0 < self.versions <= taken or 0 < self.rows < total)
            if taken and limited:
                break
            end, taken = c.version, taken + 1
        return {"version": -1 if end is None else end}

    def partitions(self, start: dict, end: dict) -> Sequence[FeedSplit]:
        self.last = end["version"]
        return cut(list(self.folder().commits(start["version"], end["version"])), self.split_bytes)

    def commit(self, end: dict) -> None:
        self.last = end["version"]


def planned_offset(checkpoint: str) -> dict | None:
    """The offset that a stream of one source has planned last, from its checkpoint; None for a new one."""
    system, root = fs.FileSystem.from_uri(checkpoint.rstrip("/"))
    infos = system.get_file_info(fs.FileSelector(f"{root}/offsets", allow_not_found=True))
    batches = [i for i in infos if i.base_name.isdigit()]
    if not batches:
        return None
    with system.open_input_file(max(batches, key=lambda i: int(i.base_name)).path) as f:
        return json.loads(f.read().decode().strip().split("\n")[-1])


class ChangeFeedSource(DataSource):
    """``spark.read.format("changefeed")`` and ``spark.readStream.format("changefeed")``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _options(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}

    def schema(self) -> T.StructType:
        return FeedFolder(self._options()["path"]).schema()

    def reader(self, schema: T.StructType) -> FeedReader:
        return FeedReader(self._options(), schema)

    def streamReader(self, schema: T.StructType) -> FeedStreamReader:
        return FeedStreamReader(self._options(), schema)


def register_feed_source(spark: SparkSession) -> None:
    """Make the format known to this session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ChangeFeedSource)


def _load(reader, path: str, schema: T.StructType | None, options: dict) -> DataFrame:
    reader = reader.format(FORMAT).option("path", path)
    for key, value in options.items():
        reader = reader if value is None else reader.option(key, str(value))
    return (reader.schema(schema) if schema is not None else reader).load()


def read_feed(spark: SparkSession, path: str, schema: T.StructType | None = None, **options) -> DataFrame:
    """The change rows of the complete commits; a ``schema`` of some columns reads only those."""
    register_feed_source(spark)
    return _load(spark.read, path, schema, options)


def stream_feed(spark: SparkSession, path: str, schema: T.StructType | None = None, **options) -> DataFrame:
    """The change rows as a stream of whole commits."""
    register_feed_source(spark)
    return _load(spark.readStream, path, schema, options)


def write_feed(feed: DataFrame, path: str) -> None:
    """Add the commits in ``feed`` to a folder, as complete once their rows are written.

    A version that is there already is refused. Rows of a commit whose marker is missing, left by a job
    that failed, are replaced.
    """
    spark = feed.sparkSession
    folder = Folder(spark, path)
    done = {n for n in folder.names() if Folder(spark, f"{path}/{n}").exists(MARKER)}
    staged = f"{path.rstrip('/')}/.staged"
    feed.write.mode("overwrite").partitionBy(COMMIT_VERSION).parquet(staged)
    written = spark.read.parquet(staged)
    counts = written.groupBy(COMMIT_VERSION).agg(F.count("*").alias("rows")).orderBy(COMMIT_VERSION).collect()  # one row a commit
    names = {f"{COMMIT_VERSION}={r[0]}": r["rows"] for r in counts}
    if known := sorted(done & set(names)):
        folder.remove(".staged")
        raise ValueError(f"commits are there already: {known}")
    for name, rows in names.items():
        folder.remove(name)
        folder.move(f".staged/{name}", name)
        Folder(spark, f"{path}/{name}").create(MARKER, json.dumps({"rows": rows}))
    folder.remove(".staged")
