"""Compaction of a folder of parquet files: small files become few, good files are not opened.

The small files of a partition (a sub-folder) are packed into output files of at most the target size, largest
files first, each into the fullest output file that still has room. Only files that share an output
file are read and written. New files are written aside first; a journal then names what is to be
moved in and what to be removed, and whoever finds a journal finishes it, so a job that is lost on the way
loses and doubles no row. While files are exchanged a reader may see some rows twice: compact where
nobody reads, or read through a list of files.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.operators.maintenance import TARGET_FILE_BYTES, list_files
from changeflow.sinks.files import Folder

#: Files packed together in one task, and files exchanged in one round.
GROUP, ROUND = 10_000, 10_000
JOURNAL = "_compaction.json"


def packed(sizes: list[int], target: int) -> list[int]:
    """The output file of each size, from 0; no output file holds more than ``target``, or it holds one file."""
    room: list[tuple[int, int]] = []  # bytes left and number of each output file, sorted
    out = [0] * len(sizes)
    n = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            left, number = room.pop(at)
        else:
            left, number, n = target, n, n + 1
        out[i] = number
        insort(room, (left - sizes[i], number))
    return out


def packing_plan(files: DataFrame, target_bytes: int = TARGET_FILE_BYTES) -> DataFrame:
    """``path, partition, output``: which small files are to become one file.

    ``files`` has ``path``, ``partition`` (the sub-folder) and ``size_bytes``. Files of the target size, and
    those that would stay alone, are not in the plan. A partition of very many files is packed in groups.
    """

    def pack(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("path")
        number = pd.Series(packed(rows.size_bytes.tolist(), target_bytes), index=rows.index)
        shared = number.groupby(number).transform("size") > 1
        output = f"{group[1]}-" + number.astype(str)
        return rows.assign(output=output)[shared][["path", "partition", "size_bytes", "output"]]

    small = files.where(F.col("size_bytes") < target_bytes).select("path", "partition", "size_bytes")
    groups = small.groupBy("partition").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    dealt = small.join(groups, "partition").withColumn("group", F.pmod(F.xxhash64("path"), F.col("groups")).cast("int"))
    schema = "path string, partition string, size_bytes long, output string"
    return dealt.groupBy("partition", "group").applyInPandas(pack, schema)


def partitioned_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, partition, size_bytes`` of the data files of a folder; ``partition`` is the sub-folder, or empty."""
    files = list_files(spark, folder)
    root = Folder(spark, folder).qualified()
    inside = F.expr(f"substring(path, {len(root) + 2})")
    partition = F.regexp_extract(inside, r"^(.*)/[^/]*$", 1)
    return files.select("path", partition.alias("partition"), "size_bytes").where(~inside.rlike(r"(^|/)[_.]"))


def size_classes(files: DataFrame, target_bytes: int = TARGET_FILE_BYTES) -> DataFrame:
    """``partition, size_class, files``: small, half (at least half the target) and full."""
    size = F.col("size_bytes")
    kind = F.when(size >= target_bytes, "full").when(2 * size >= target_bytes, "half").otherwise("small")
    return files.groupBy("partition", kind.alias("size_class")).agg(F.count("*").alias("files"))


def finish(spark: SparkSession, folder: str) -> None:
    """Carry out the journal of a compaction that was cut off, if there is one."""
    table = Folder(spark, folder)
    if not table.exists(JOURNAL):
        return
    journal = json.loads(table.read(JOURNAL))
    for staged, name in journal["moved"]:
        if table.exists(staged):
            table.move(staged, name)
    for name in journal["removed"]:
        table.remove(name)
    table.remove(journal["staging"])
    table.remove(JOURNAL)


def _rounds(plan: list) -> Iterator[list]:
    """Output files with at most ``ROUND`` files together."""
    held: list = []
    for row in plan:
        if held and sum(len(r.paths) for r in held) + len(row.paths) > ROUND:
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def compact_folder(spark: SparkSession, folder: str, target_bytes: int = TARGET_FILE_BYTES) -> tuple[int, int]:
    """Compact a folder, partitioned or not; returns the number of files removed and added.

    The driver holds the names of the small files that are to be exchanged.
    """
    finish(spark, folder)
    plan = packing_plan(partitioned_files(spark, folder), target_bytes)
    outputs = plan.groupBy("partition", "output").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    removed = added = 0
    for part in _rounds(outputs.orderBy("partition", "output").collect()):
        removed += sum(len(r.paths) for r in part)
        added += len(part)
        _exchange(spark, folder, part)
    return removed, added


def _exchange(spark: SparkSession, folder: str, outputs: list) -> None:
    table, staging = Folder(spark, folder), f"_compacting-{uuid.uuid4().hex}"
    root = table.qualified()
    names = [(p, number) for number, r in enumerate(outputs) for p in r.paths]
    # A schema for all, as files may come from before a column was added.
    rows = spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(*[p for p, _ in names])
    numbers = F.broadcast(spark.createDataFrame(names, "__path string, __output int"))  # ROUND rows at most
    marked = rows.withColumn("__path", F.col("_metadata.file_path")).join(numbers, "__path").drop("__path")
    marked.repartition(len(outputs), "__output").write.partitionBy("__output").parquet(f"{folder}/{staging}")
    moved = []
    for number, r in enumerate(outputs):
        place = f"{staging}/__output={number}"
        for k, name in enumerate(n for n in Folder(spark, f"{folder}/{place}").names() if n.endswith(".parquet")):
            into = f"{r.partition}/" if r.partition else ""
            moved.append((f"{place}/{name}", f"{into}compacted-{uuid.uuid4().hex}-{k}.parquet"))
    removed = [p[len(root) + 1 :] for p, _ in names]
    table.create(JOURNAL, json.dumps({"staging": staging, "moved": moved, "removed": removed}))
    finish(spark, folder)
