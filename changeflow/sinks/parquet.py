"""Targets in plain parquet folders, which any reader of partitioned parquet can read.

Both take one batch after another, and a batch that comes again changes nothing more. ``AppendFolder``
keeps each batch in a sub-folder of its own. ``StateFolder`` keeps the merged rows divided by key hash and
rewrites, by Spark's dynamic partition overwrite, only the buckets that a batch touches; a bucket that a
batch empties is removed afterwards. Spark moves a bucket's new files in place when the job is done, so a
reader sees each bucket before or after the batch, and a batch that failed halfway is applied again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.operators import feed as feed_ops
from changeflow.operators.merge import MergeSpec, empty_target, merge_prepared, prepare_source, with_key_bucket
from changeflow.sinks.files import Folder
from changeflow.sinks.table import value_bytes

BATCH, BUCKET = "batch", "bucket"
#: A batch is broadcast up to so many bytes of values: the driver gets them from one batch after another.
BROADCAST_BYTES = 8 << 20


class AppendFolder:
    """Rows that were ever inserted or updated; tombstones are left out."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def apply(self, changes: DataFrame, number: int) -> None:
        rows = feed_ops.strip_metadata(feed_ops.without_tombstones(changes))
        rows.write.mode("overwrite").parquet(f"{self.path}/{BATCH}={number}")

    def apply_batches(self, changes: DataFrame) -> None:
        """Rows of several batches by their number in ``batch``; the folders of other batches stay as they are."""
        rows = feed_ops.strip_metadata(feed_ops.without_tombstones(changes))
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(BATCH).parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(self.path)


class StateFolder:
    """The merged rows of all batches, one row per key.

    The number of buckets and the keys belong to the folder; give the same ones each time. A batch applied
    twice gives the same rows as once, except rows with a NULL key, which match nothing: a spec whose
    batches hold them should leave them out in its transform.
    """

    def __init__(self, spark: SparkSession, path: str, spec: MergeSpec, buckets: int = 64):
        self.spark, self.path, self.spec, self.buckets = spark, path.rstrip("/"), spec, buckets

    def _stored(self, buckets: Sequence[int] | None = None) -> DataFrame | None:
        """The stored rows, or those of some buckets; None before the first batch."""
        names = {f"{BUCKET}={b}" for b in range(self.buckets)}
        if not names & set(Folder(self.spark, self.path).names()):
            return None
        rows = self.spark.read.option("mergeSchema", "true").parquet(self.path)
        return (rows if buckets is None else rows.where(F.col(BUCKET).isin(list(buckets)))).drop(BUCKET)

    def read(self) -> DataFrame:
        rows = self._stored()
        if rows is None:
            raise FileNotFoundError(f"no batch has been merged into {self.path}")
        return rows

    def apply(self, changes: DataFrame, number: int = 0) -> None:
        """Merge change rows (no pre-images) into the buckets that their keys fall into."""
        stored, staged = self._stored(), Folder(self.spark, f"{self.path}.staged")
        kinds = None if stored is None else stored.schema
        # Prepared once: a transform that gives other rows when it runs again can't part keys from buckets.
        prepared = with_key_bucket(prepare_source(changes, self.spec), self.spec.keys, self.buckets, BUCKET, kinds)
        prepared.write.mode("overwrite").parquet(f"{staged.path}/{number}")
        batch = self.spark.read.schema(prepared.schema).parquet(f"{staged.path}/{number}")
        sizes = batch.groupBy(BUCKET).agg(value_bytes(batch).alias("bytes")).collect()  # one row a bucket at most
        if sizes:
            small = sum(r["bytes"] for r in sizes) <= BROADCAST_BYTES
            self._merge(batch.drop(BUCKET), sorted(r[BUCKET] for r in sizes), small)
        staged.remove(str(number))

    def _merge(self, batch: DataFrame, touched: list[int], small: bool) -> None:
        target = self._stored(touched)
        target = empty_target(batch) if target is None else target
        ready = replace(self.spec, transform_sql=None, transform_arrow=None)
        rows = with_key_bucket(merge_prepared(target, batch, ready, small), self.spec.keys, self.buckets, BUCKET)
        # A large bucket is written by several tasks, a small one by one.
        gathered = rows.hint("rebalance", BUCKET)
        # Written beside the table first: what a bucket is overwritten with must not depend on reading it.
        path = f"{self.path}.next"
        gathered.write.mode("overwrite").partitionBy(BUCKET).parquet(path)
        held = {n for n in Folder(self.spark, path).names() if n.startswith(f"{BUCKET}=")}
        if held:
            merged = self.spark.read.schema(rows.schema).parquet(path)
            writer = merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy(BUCKET).parquet(self.path)
        table = Folder(self.spark, self.path)
        for b in touched:
            if f"{BUCKET}={b}" not in held:
                table.remove(f"{BUCKET}={b}")
        Folder(self.spark, path).remove("")
