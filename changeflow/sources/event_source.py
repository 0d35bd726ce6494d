"""Event logs in parquet files, read in batches of a bounded number of events.

Events are taken in the order of files and of rows inside a file; files follow one another by the time they
were written (``order=time``) or by name (``order=name``). Batch k of a log holds its events
``k * max_events`` up to ``(k + 1) * max_events``, so no batch is larger, however large a file is: a file is
cut between two rows. Only footers are read to find the cuts.

``event_batches`` plans a whole backlog as a table: footers are read by tasks, one row a row group, and the
events before each row group come from running sums in windows of bounded size. ``read_event_batch`` reads
one batch, or all. As a stream (``spark.readStream.format("eventfiles")``) the offset is a place in a file,
and ``maxEventsPerTrigger`` bounds a micro-batch; the driver reads footers only of the files of a batch.
``checkpoint`` is the stream's checkpoint, from which a restarted reader learns where it stopped; without it
the first micro-batch after a restart is not bounded. With ``batchesPerTrigger`` a micro-batch takes up to so
many batches of a backlog, each of ``maxEventsPerTrigger`` events at most and told by its ``batch``: a
micro-batch has costs of its own, which a long backlog of small batches should not pay for each of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from changeflow.plans.positions import running_sum
from changeflow.schema import EVENT_SCHEMA
from changeflow.sources.feed_source import BATCH_ROWS, fitted, planned_offset

FORMAT = "eventfiles"
MAX_EVENTS = 5_000
#: Events of one split, and bits of a row group's number within its file.
SPLIT_EVENTS, GROUP_BITS = 100_000, 20
#: Bytes of files that a task of a planned read takes, and files whose footers a stream remembers.
SPLIT_BYTES, FOOTERS = 8 << 20, 1_000


def _listed(path: str, order: str) -> list[fs.FileInfo]:
    """The parquet files of a folder, in the order their events come in."""
    system, root = fs.FileSystem.from_uri(path.rstrip("/"))
    infos = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    files = [i for i in infos if i.type == fs.FileType.File and i.base_name.endswith(".parquet") and i.base_name[0] not in "_."]
    return sorted(files, key=_key(order))


def _key(order: str):
    if order not in ("time", "name"):
        raise ValueError(f"files are ordered by time or by name, not by '{order}'")
    return lambda i: (i.mtime_ns if order == "time" else 0, i.path)


def _group_rows(path: str, name: str) -> list[int]:
    system, _ = fs.FileSystem.from_uri(path)
    with system.open_input_file(name) as f:
        meta = pq.ParquetFile(f).metadata
        return [meta.row_group(g).num_rows for g in range(meta.num_row_groups)]


def _slices(path: str, parts: Sequence[tuple], schema: pa.Schema) -> Iterator[tuple[int, pa.RecordBatch]]:
    """For parts (file, row group, first row, end, ...), in this order: the part's number and its rows.

    A file is opened once for parts that follow one another, and a row group read once.
    """
    system, _ = fs.FileSystem.from_uri(path)
    for name, inside in groupby(enumerate(parts), key=lambda p: p[1][0]):
        with system.open_input_file(name) as opened:
            file = pq.ParquetFile(opened, coerce_int96_timestamp_unit="us")
            for group, own in groupby(inside, key=lambda p: p[1][1]):
                yield from _cut(file, group, [(k, p[2], p[3]) for k, p in own], schema)


def _cut(file: pq.ParquetFile, group: int, parts: list[tuple[int, int, int]], schema: pa.Schema) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of parts (number, first row, end) of a row group; a part begins where or after the one before ends."""
    at, i = 0, 0
    for b in file.iter_batches(BATCH_ROWS, row_groups=[group], columns=schema.names):
        rows = pa.RecordBatch.from_arrays([fitted(b.column(f.name), f.type) for f in schema], schema=schema)
        while i < len(parts) and parts[i][1] < at + len(b):
            k, first, end = parts[i]
            begin, stop = max(first - at, 0), min(end - at, len(b))
            if begin < stop:
                yield k, rows.slice(begin, stop - begin)
            if end > at + len(b):
                break
            i += 1
        at += len(b)
        if i == len(parts):
            return


# A backlog as a table -----------------------------------------------------------------------


def event_batches(spark: SparkSession, path: str, max_events: int = MAX_EVENTS, order: str = "time") -> DataFrame:
    """``batch, file, row_group, first_row, end_row``: which rows of which row groups make up each batch."""
    if max_events < 1:
        raise ValueError("a batch holds at least one event")
    files = [(k, i.path) for k, i in enumerate(_listed(path, order))]
    schema = "batch long, file string, row_group int, first_row long, end_row long"
    if not files:
        return spark.createDataFrame([], schema)

    def footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, f, g, n) for k, f in zip(b.number, b.file, strict=True) for g, n in enumerate(_group_rows(path, f))]
            yield pd.DataFrame(rows, columns=["number", "file", "row_group", "rows"])

    listed = spark.createDataFrame(files, "number long, file string").repartition(min(len(files), 1_000))
    groups = listed.mapInPandas(footers, "number long, file string, row_group int, rows long").where("rows > 0")
    groups = groups.withColumn("at", F.shiftleft("number", GROUP_BITS) + F.col("row_group"))
    placed = running_sum(groups, "at", F.col("rows"), name="end")
    start = F.col("end") - F.col("rows")
    first, last = (F.floor(x / max_events).cast("long") for x in (start, F.col("end") - 1))
    cut = placed.withColumn("start", start).withColumn("batch", F.explode(F.sequence(first, last)))
    return cut.select(
        "batch",
        "file",
        "row_group",
        F.greatest(F.col("batch") * max_events - F.col("start"), F.lit(0)).alias("first_row"),
        F.least((F.col("batch") + 1) * max_events - F.col("start"), F.col("rows")).alias("end_row"),
    )


def read_event_batch(plan: DataFrame, path: str, batch: int | None = None, schema: T.StructType = EVENT_SCHEMA) -> DataFrame:
    """The events of one batch of a plan, or of all, with the number of their ``batch``."""
    wanted = to_arrow_schema(schema)
    out = T.StructType([T.StructField("batch", T.LongType()), *schema.fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            numbers, *columns = (c.to_pylist() for c in b.columns)
            for k, rows in _slices(path, list(zip(*columns, strict=True)), wanted):
                number = pa.array([numbers[k]] * len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays([number, *rows.columns], ["batch", *wanted.names])

    chosen = (plan if batch is None else plan.where(F.col("batch") == batch)).select("batch", "file", "row_group", "first_row", "end_row")
    tasks = 1 if batch is not None else -(-sum(i.size for i in _listed(path, "name")) // SPLIT_BYTES) or 1
    # Dealt by what is to be read: the plan itself is so small that Spark would read all files in a task or two.
    chosen = chosen.repartitionByRange(tasks, "file", "row_group") if tasks > 1 else chosen.coalesce(1)
    return chosen.sortWithinPartitions("file", "row_group", "first_row").mapInArrow(read, out)


# A stream -----------------------------------------------------------------------------------


BEGIN = {"file": "", "time": 0, "row": 0}
BATCH = "batch"


class EventSplit(InputPartition):
    def __init__(self, parts, batch):
        super().__init__(None)
        self.parts, self.batch = tuple(parts), batch


class EventFileReader(DataSourceStreamReader):
    """Offsets are ``{"file", "time", "row"}``: so many rows of that file, and all files before it, are read.

    Where a micro-batch takes several batches they have ``batch`` too, the number of the next one.
    """

    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.order, self.wanted = options["path"], options.get("order", "time"), schema
        self.most = int(options.get("maxeventspertrigger", MAX_EVENTS))
        self.together, self.footers = int(options.get("batchespertrigger", 1)), {}
        self.begin = BEGIN if self.together == 1 else {**BEGIN, "batch": 0}
        planned = planned_offset(options["checkpoint"]) if "checkpoint" in options else None
        if planned and set(planned) != set(self.begin) or self.together > 1 and "checkpoint" not in options:
            raise ValueError("batches can't be numbered: with batchesPerTrigger a stream needs a checkpoint, and one that began with it")
        # Without a checkpoint to look into it is not known where the stream stands until it plans a batch.
        self.last = (planned or self.begin) if "checkpoint" in options else None

    def initialOffset(self) -> dict:
        return self.begin

    def _group_rows(self, info: fs.FileInfo) -> list[int]:
        key = (info.path, info.mtime_ns, info.size)
        if key not in self.footers:
            if len(self.footers) >= FOOTERS:
                self.footers.clear()
            self.footers[key] = _group_rows(self.path, info.path)
        return self.footers[key]

    def _place(self, offset: dict) -> tuple:
        return (offset["time"] if self.order == "time" else 0, offset["file"])

    def _groups(self, start: dict) -> Iterator[tuple[fs.FileInfo, int, int, int, int]]:
        """File, row group, its first row in the file, and the rows to read of it, behind ``start``."""
        key = _key(self.order)
        for info in _listed(self.path, self.order):
            if key(info) < self._place(start):
                continue
            done, at = (start["row"] if key(info) == self._place(start) else 0), 0
            for g, n in enumerate(self._group_rows(info)):
                if at + n > done:
                    yield info, g, at, max(done - at, 0), n
                at += n

    def latestOffset(self) -> dict:
        if self.last is None:
            end, left = self.begin, None
        else:
            end, left = self.last, self.most * self.together
        taken = 0
        for info, _, at, first, n in self._groups(end):
            take = n - first if left is None else min(n - first, left - taken)
            if not take:
                break
            end = {**end, "file": info.path, "time": info.mtime_ns, "row": at + first + take}
            taken += take
        return end if self.together == 1 else {**end, "batch": end["batch"] + -(-taken // self.most)}

    def partitions(self, start: dict, end: dict) -> Sequence[EventSplit]:
        self.last = end
        splits, held, size, before = [], [], 0, 0
        for info, g, at, first, n in self._groups(start):
            place = _key(self.order)(info)
            stop = n if place < self._place(end) else min(n, end["row"] - at) if place == self._place(end) else 0
            for begin in range(first, stop, SPLIT_EVENTS):
                held.append((info.path, g, begin, min(begin + SPLIT_EVENTS, stop), before))
                size += held[-1][3] - begin
                before += held[-1][3] - begin
                if size >= SPLIT_EVENTS:
                    splits.append(EventSplit(held, start.get("batch")))
                    held, size = [], 0
            if place > self._place(end):
                break
        return [*splits, EventSplit(held, start.get("batch"))] if held else splits

    def read(self, partition: EventSplit) -> Iterator[pa.RecordBatch]:
        wanted = to_arrow_schema(self.wanted)
        if partition.batch is None:
            for _, rows in _slices(self.path, partition.parts, wanted):
                yield rows
            return
        wanted = wanted.remove(wanted.get_field_index(BATCH))
        at = partition.parts[0][4]  # events of the micro-batch before this split's, which follow one another
        for _, rows in _slices(self.path, partition.parts, wanted):
            number = partition.batch + np.arange(at, at + len(rows)) // self.most
            at += len(rows)
            columns = dict(zip(wanted.names, rows.columns, strict=True)) | {BATCH: pa.array(number, pa.int64())}
            yield pa.RecordBatch.from_arrays([columns[f.name] for f in self.wanted], schema=to_arrow_schema(self.wanted))

    def commit(self, end: dict) -> None:
        self.last = end


class EventFileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        several = int({k.lower(): v for k, v in self.options.items()}.get("batchespertrigger", 1)) > 1
        return T.StructType([T.StructField(BATCH, T.LongType()), *EVENT_SCHEMA.fields]) if several else EVENT_SCHEMA

    def streamReader(self, schema: T.StructType) -> EventFileReader:
        return EventFileReader({k.lower(): v for k, v in self.options.items()}, schema)


def stream_event_batches(
    spark: SparkSession, path: str, max_events: int = MAX_EVENTS, order: str = "time", checkpoint: str | None = None, together: int = 1
) -> DataFrame:
    """The events as a stream of micro-batches of at most ``max_events``, or of ``together`` such batches by their ``batch``."""
    spark.dataSource.register(EventFileSource)
    reader = spark.readStream.format(FORMAT).option("path", path).option("order", order).option("maxEventsPerTrigger", str(max_events))
    reader = reader.option("batchesPerTrigger", str(together))
    return (reader.option("checkpoint", checkpoint) if checkpoint else reader).load()
