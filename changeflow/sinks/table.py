"""A target table on plain parquet: append, overwrite and merge with an atomic commit.

Layout below the table's folder::

    commits/00000000000000000007.json             actions of commit 7, one JSON object a line
    data/_commit_version=7/_part=state/...        rows written by commit 7
    data/_commit_version=7/_part=feed/...         change rows of commit 7 (merges)

A commit first writes its data, as ordinary Spark jobs that may be retried, and then its one JSON
file. That file says which folders make up the table, so readers see all of a commit or nothing,
and it carries the progress of the job that wrote it: a batch replayed after a crash finds itself
done. A merged table is divided into hash buckets of its keys, and a merge reads and rewrites only
the buckets its changes fall into. One writer at a time.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow.operators import feed as feed_ops
from changeflow.operators.merge import (
    MergeSpec,
    prepare_source,
    state_and_feed,
    with_key_bucket,
)
from changeflow.schema import (
    CHANGE_TYPE,
    COMMIT_TIMESTAMP,
    COMMIT_VERSION,
    DELETE,
    INSERT,
    META,
    POSTIMAGE,
    column,
    require_columns,
)
from changeflow.sinks.files import Folder
from changeflow.sources.commits import read_log

PART, BUCKET = "_part", "_bucket"
STATE, FEED, TOMBSTONES = "state", "feed", "tombstones"

# A staged batch is broadcast to the target's side up to this many bytes of values.
BROADCAST_BYTES = 32 * 1024 * 1024

# A merge may leave rows where they are, without a shuffle, while files are this large on average
# or a bucket has at most this many of them.
GOOD_FILE_BYTES = 32 * 1024 * 1024
FEW_FILES = 8


@dataclass(frozen=True)
class Extent:
    """Rows of the table: one bucket of one commit, or all a run of append commits wrote."""

    bucket: int | None
    first: int
    last: int
    rows: int
    files: int = 1
    bytes: int = 0


@dataclass(frozen=True)
class Snapshot:
    """The table after a commit. Version -1 is the table that does not exist yet."""

    version: int = -1
    schema: T.StructType | None = None
    feed_schema: T.StructType | None = None
    keys: tuple[str, ...] = ()
    buckets: int = 0
    extents: tuple[Extent, ...] = ()
    progress: dict = field(default_factory=dict)
    info: dict = field(default_factory=dict)

    @property
    def rows(self) -> int:
        return sum(e.rows for e in self.extents)


@dataclass(frozen=True)
class Outcome:
    source_rows: int = 0
    inserts: int = 0
    updates: int = 0
    deletes: int = 0
    appended: int = 0
    target_version: int = -1
    duration_ms: int = 0


def file_name(version: int) -> str:
    return f"{version:020d}.json"


def value_bytes(df: DataFrame) -> Column:
    """Size of the values of all rows: an upper bound for broadcasting them, not an estimate."""
    sizes = []
    for f in df.schema.fields:
        c = column(f.name)
        if isinstance(f.dataType, T.StringType | T.BinaryType):
            sizes.append(F.coalesce(F.octet_length(c), F.lit(0)) + 16)
        elif isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType | T.VariantType):
            sizes.append(F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) * 2 + 16)
        else:
            sizes.append(F.lit(16))
    return F.coalesce(F.sum(sum(sizes[1:], sizes[0]).cast("bigint")), F.lit(0))


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark = spark
        self.path = path.rstrip("/")
        self.buckets = buckets
        self.log = Folder(spark, f"{self.path}/commits")
        self._seen = -1

    # Reading ------------------------------------------------------------------------------

    @property
    def log_path(self) -> str:
        return f"{self.path}/commits"

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.log.names() if n[0].isdigit()]

    def current_version(self) -> int:
        """The newest commit. Commits are dense and stay, so a known one is only probed further."""
        if self._seen >= 0:
            for _ in range(20):
                if not self.log.exists(file_name(self._seen + 1)):
                    return self._seen
                self._seen += 1
        self._seen = max(self.versions(), default=-1)
        return self._seen

    def newest_log(self, commits: int) -> DataFrame:
        """The log lines of the newest commits only."""
        last = self.current_version()
        versions = range(max(0, last - commits + 1), last + 1)
        return read_log(self.spark, [f"{self.log_path}/{file_name(v)}" for v in versions])

    def snapshot(self, version: int | None = None) -> Snapshot:
        version = self.current_version() if version is None else version
        if version < 0:
            return Snapshot()
        actions = [json.loads(line) for line in self.log.read(file_name(version)).splitlines()]
        one = {k: v for a in actions for k, v in a.items() if k in ("metaData", "progress", "commitInfo")}
        meta = one["metaData"]

        def schema(name):
            return T.StructType.fromJson(meta[name]) if meta.get(name) else None

        return Snapshot(
            version,
            schema("schema"),
            schema("feedSchema"),
            tuple(meta.get("keys", ())),
            meta.get("buckets", 0),
            tuple(Extent(**a["extent"]) for a in actions if "extent" in a),
            one.get("progress", {}),
            one.get("commitInfo", {}),
        )

    def _folder(self, version: int, part: str, bucket: int | None = None) -> str:
        path = f"{self.path}/data/{COMMIT_VERSION}={version}/{PART}={part}"
        return path if bucket is None else f"{path}/{BUCKET}={bucket}"

    def _rows(self, schema: T.StructType, extents) -> DataFrame:
        paths = [
            self._folder(v, STATE, e.bucket) for e in extents for v in range(e.first, e.last + 1)
        ]
        if not paths:
            # The false filter lets the optimizer drop joins with this side altogether.
            nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
            return self.spark.range(0).where(F.lit(False)).select(*nothing)
        return self.spark.read.schema(schema).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        """The table's rows, now or after an earlier commit."""
        s = self.snapshot(version)
        if s.version < 0 or s.schema is None:
            raise ValueError(f"no table at {self.path}")
        return self._rows(s.schema, s.extents)

    def read_feed(self, start: int, end: int) -> DataFrame:
        """Change rows of the commits ``start..end``, all images, read from their folders only."""
        if end < start:
            raise ValueError(f"end version {end} lies before start version {start}")
        last = self.snapshot(end)
        data = last.feed_schema or T.StructType(
            [*last.schema.fields, T.StructField(CHANGE_TYPE, T.StringType())]
            + [T.StructField(COMMIT_TIMESTAMP, T.TimestampType())]
        )
        parts, stored = [], []
        for v in range(start, end + 1):
            s = self.snapshot(v)
            kind = s.info.get("feed")
            if kind == "stored":
                stored.append(v)
            elif kind in ("added", "replaced"):
                at = F.timestamp_millis(F.lit(s.info["timestamp"]))
                if any(e.last == v for e in s.extents):
                    new = self._rows(s.schema, [Extent(None, v, v, 0)])
                    parts.append(self._as_feed(new, INSERT, v, at))
                if kind == "replaced" and v > 0:
                    before = self.snapshot(v - 1)
                    if before.extents:
                        old = self._rows(before.schema, before.extents)
                        parts.append(self._as_feed(old, DELETE, v, at))
        if stored or not parts:
            schema = T.StructType(data.fields + [T.StructField(COMMIT_VERSION, T.LongType())])
            names = [f.name for f in data.fields if f.name != COMMIT_TIMESTAMP]
            names += [COMMIT_VERSION, COMMIT_TIMESTAMP]
            if stored:
                read = (
                    self.spark.read.schema(schema)
                    .option("basePath", f"{self.path}/data")
                    .parquet(*[self._folder(v, FEED) for v in stored])
                )
            else:
                read = self.spark.createDataFrame([], schema)
            parts.append(read.select(*[column(c) for c in names]))
        result = parts[0]
        for p in parts[1:]:
            result = result.unionByName(p, allowMissingColumns=True)
        return result

    @staticmethod
    def _as_feed(rows: DataFrame, change_type: str, version: int, at: Column) -> DataFrame:
        return rows.select(
            *[column(c) for c in rows.columns],
            F.lit(change_type).alias(CHANGE_TYPE),
            F.lit(version).cast("bigint").alias(COMMIT_VERSION),
            at.alias(COMMIT_TIMESTAMP),
        )

    # Writing ------------------------------------------------------------------------------

    def _publish(
        self,
        snapshot: Snapshot,
        operation: str,
        extents: list[Extent],
        outcome: Outcome,
        feed_kind: str,
        feed_rows: int,
        before: tuple[Extent, ...] = (),
    ) -> None:
        """The commit itself: one JSON file."""
        v = snapshot.version
        old = set(before)
        merged = [e for e in extents if e not in old]

        def path(e: Extent) -> str:
            return self._folder(e.last, STATE, e.bucket).removeprefix(f"{self.path}/")

        actions: list[dict] = [
            {
                "commitInfo": {
                    "timestamp": int(time.time() * 1000),
                    "operation": operation,
                    "feed": feed_kind,
                    "metrics": {**outcome.__dict__, "target_version": v},
                    **snapshot.info,
                }
            },
            {
                "metaData": {
                    "schema": snapshot.schema and json.loads(snapshot.schema.json()),
                    "feedSchema": snapshot.feed_schema and json.loads(snapshot.feed_schema.json()),
                    "keys": list(snapshot.keys),
                    "buckets": snapshot.buckets,
                }
            },
            {"progress": snapshot.progress},
        ]
        if feed_kind == "stored":
            actions.append({"cdc": {"path": self._folder(v, FEED).removeprefix(f"{self.path}/"), "stats": {"numRecords": feed_rows}}})
        live = {(e.bucket, x) for e in extents for x in range(e.first, e.last + 1)}
        for e in sorted(old, key=lambda e: (e.bucket is None, e.bucket or 0, e.first)):
            for x in range(e.first, e.last + 1):
                if (e.bucket, x) not in live:
                    gone = self._folder(x, STATE, e.bucket).removeprefix(f"{self.path}/")
                    actions.append({"remove": {"path": gone}})
        for e in merged:
            if e.last == v:
                n = outcome.appended if e.bucket is None else e.rows
                actions.append({"add": {"path": path(e), "stats": {"numRecords": n}}})
        actions += [{"extent": e.__dict__} for e in extents]
        self.log.create(file_name(v), "".join(json.dumps(a) + "\n" for a in actions))

    def _next(self, base: Snapshot, job: str, progress: dict | None, info: dict | None, **changes) -> Snapshot:
        state = dict(base.progress)
        if progress is not None:
            state[job] = progress
        values = {**base.__dict__, "info": info or {}, "progress": state, **changes}
        return Snapshot(**{**values, "version": base.version + 1})

    def apply(
        self,
        source: DataFrame,
        mode: str,
        spec: MergeSpec | None = None,
        job: str = "default",
        progress: dict | None = None,
        info: dict | None = None,
        staged: bool = False,
    ) -> Outcome:
        """Apply change rows (no pre-images) as one commit; no rows and no progress, no commit.

        The source is evaluated once; ``staged`` says that it is a stored table already.
        """
        started = time.monotonic()
        base = self.snapshot()
        info = {"job": job, **(info or {})}
        if mode == "merge":
            if spec is None:
                raise ValueError("merge mode needs a MergeSpec")
            return self._merge(base, source, spec, job, progress, info, started, staged)
        if mode in ("append", "overwrite"):
            return self._write(base, source, mode, job, progress, info, started)
        raise ValueError(f"unknown sink mode '{mode}': use append, overwrite or merge")

    def _unchanged(self, base, job, progress, info, outcome: Outcome) -> Outcome:
        """Nothing to write: only the progress, if there is any, moves on."""
        if progress is None:
            return Outcome(**{**outcome.__dict__, "target_version": base.version})
        after = self._next(base, job, progress, info)
        outcome = Outcome(**{**outcome.__dict__, "target_version": after.version})
        self._publish(after, "SKIP", list(base.extents), outcome, "none", 0, base.extents)
        return outcome

    def _write(self, base, source, mode, job, progress, info, started) -> Outcome:
        rows = feed_ops.strip_metadata(source)
        schema = base.schema or rows.schema
        _same_columns(schema, rows)
        after = self._next(base, job, progress, info, schema=_nullable(schema))
        # Written once, tombstones beside the rows; both are counted from the footers of their files.
        dead = F.lit(False)
        if CHANGE_TYPE in source.columns:
            dead = F.coalesce(column(CHANGE_TYPE) == DELETE, F.lit(False))
        part = F.when(dead, TOMBSTONES).otherwise(STATE)
        marked = feed_ops.strip_metadata(source.withColumn(PART, part))
        marked.write.mode("overwrite").partitionBy(PART).parquet(f"{self.path}/data/{COMMIT_VERSION}={after.version}")
        folder = Folder(self.spark, f"{self.path}/data/{COMMIT_VERSION}={after.version}")
        n, skipped = (
            self.spark.read.schema(rows.schema).parquet(self._folder(after.version, p)).count()
            if folder.exists(f"{PART}={p}")
            else 0
            for p in (STATE, TOMBSTONES)
        )
        folder.remove(f"{PART}={TOMBSTONES}")
        total = n + skipped
        outcome = Outcome(source_rows=total, appended=n, duration_ms=_since(started))
        if total == 0 or (n == 0 and mode == "append"):
            return self._unchanged(base, job, progress, info, outcome)
        new = [Extent(None, after.version, after.version, n, *self._files(after.version))] if n else []
        if mode == "append":
            extents = _joined([*base.extents, *new])
        else:
            extents = new
        outcome = Outcome(source_rows=total, appended=n, target_version=after.version, duration_ms=_since(started))
        kind = "added" if mode == "append" else "replaced"
        self._publish(after, mode.upper(), extents, outcome, kind, n, base.extents)
        return outcome

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written to the table's staging folder and read from there."""
        path = f"{self.path}/staging/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _merge(self, base, source, spec, job, progress, info, started, staged) -> Outcome:
        # Staged before it is counted, so a source or transform that gives other rows when it runs
        # again cannot make the counts disagree with what is merged.
        source = source if staged else self.stage(source, f"source-{base.version + 1}")
        total = source.count()
        outcome = Outcome(source_rows=total, duration_ms=_since(started))
        if total == 0:
            return self._unchanged(base, job, progress, info, outcome)
        buckets = base.buckets or self.buckets
        version = base.version + 1

        # Stage the prepared batch once: its buckets and its size are facts from here on, and the
        # transform does not run again, whatever executors are lost.
        staging = Folder(self.spark, f"{self.path}/staging")
        stage = f"{staging.path}/{version}"
        prepared = prepare_source(source, spec)
        prepared = with_key_bucket(prepared, spec.keys, buckets, BUCKET, base.schema)
        prepared.write.mode("overwrite").parquet(stage)
        staged = self.spark.read.schema(prepared.schema).parquet(stage)
        per_bucket = staged.groupBy(BUCKET).agg(value_bytes(staged).alias("bytes")).collect()
        if not per_bucket:
            staging.remove(str(version))
            return self._unchanged(base, job, progress, info, outcome)
        small = sum(r["bytes"] for r in per_bucket) <= BROADCAST_BYTES
        touched = {r[BUCKET] for r in per_bucket}
        if base.keys != spec.keys or any(e.bucket is None for e in base.extents):
            touched = set(range(buckets))  # not bucketed by these keys yet: take it all once
            affected = list(base.extents)
        else:
            affected = [e for e in base.extents if e.bucket in touched]

        batch = staged.drop(BUCKET)
        old_schema = base.schema or T.StructType([f for f in batch.schema.fields if f.name not in META])
        target = self._rows(old_schema, affected)
        # A broadcast merge leaves each target row in the task that read its bucket, so its rows can
        # be written in place. Only the inserts are gathered by bucket, unless files got too small.
        files, size = sum(e.files for e in affected), sum(e.bytes for e in affected)
        in_place = small and bool(affected) and all(e.bucket is not None for e in affected)
        in_place &= files <= FEW_FILES * len(affected) or size >= GOOD_FILE_BYTES * files
        matched, inserted = state_and_feed(target, batch, spec, small)
        matched, inserted = (with_key_bucket(d, spec.keys, buckets, BUCKET) for d in (matched, inserted))
        # Rebalancing gathers the rows of a bucket, yet splits a bucket too large for one task.
        if in_place:
            rows = matched.unionByName(inserted.hint("rebalance", PART, BUCKET))
        else:
            rows = matched.unionByName(inserted).hint("rebalance", PART, BUCKET)
        schema = T.StructType(
            [f for f in rows.schema.fields if f.name not in (PART, BUCKET, CHANGE_TYPE)]
        )
        now = F.when(F.col(PART) == FEED, F.timestamp_millis(F.lit(int(time.time() * 1000))))
        rows = rows.withColumn(COMMIT_TIMESTAMP, now)
        data = f"{self.path}/data/{COMMIT_VERSION}={version}"
        rows.write.mode("overwrite").partitionBy(PART, BUCKET).parquet(data)

        written = self._written(data)
        kinds = {k: sum(r[k] for r in written) for k in (INSERT, POSTIMAGE, DELETE)}
        changed = sum(r["rows"] for r in written if r[PART] == FEED)
        kept = [] if base.keys != spec.keys else [e for e in base.extents if e not in affected]
        extents = kept + sorted(
            (
                Extent(r[BUCKET], version, version, r["rows"], r["files"], r["bytes"])
                for r in written
                if r[PART] == STATE
            ),
            key=lambda e: e.bucket,
        )
        outcome = Outcome(
            total, kinds[INSERT], kinds[POSTIMAGE], kinds[DELETE], 0, version, _since(started)
        )
        after = self._next(
            base, job, progress, info, schema=_nullable(schema), feed_schema=None,
            keys=spec.keys, buckets=buckets,
        )
        kind = "stored" if changed else "none"
        self._publish(after, "MERGE", extents, outcome, kind, changed, base.extents)
        staging.remove(str(version))
        staging.remove(f"source-{version}")
        return outcome

    def _files(self, version: int) -> tuple[int, int]:
        """Files and bytes an append or overwrite wrote, from the folder's listing."""
        return Folder(self.spark, self._folder(version, STATE)).usage()

    def describe(self) -> DataFrame:
        """One row: version, files, rows, bucket keys, whether a change feed can be read."""
        s = self.snapshot()
        return self.spark.createDataFrame(
            [(s.version, sum(e.files for e in s.extents), s.rows, list(s.keys), s.version >= 0)],
            "version bigint, num_files bigint, estimated_rows bigint, partition_columns array<string>, "
            "feed_enabled boolean",
        )

    def _written(self, data: str) -> list:
        """What a merge wrote, per part and bucket, counted from the files themselves.

        Counters kept while writing could count twice when a lost executor's tasks run again.
        """
        schema = f"{CHANGE_TYPE} string, {PART} string, {BUCKET} int"
        kinds = (INSERT, POSTIMAGE, DELETE)
        per_file = (
            self.spark.read.schema(schema)
            .parquet(data)
            .groupBy(PART, BUCKET, "_metadata.file_path", "_metadata.file_size")
            .agg(
                F.count(F.lit(1)).alias("rows"),
                *[F.count_if(column(CHANGE_TYPE) == k).alias(k) for k in kinds],
            )
        )
        return (
            per_file.groupBy(PART, BUCKET)
            .agg(
                F.count(F.lit(1)).alias("files"),
                F.sum("file_size").alias("bytes"),
                *[F.sum(c).alias(c) for c in ("rows", *kinds)],
            )
            .collect()
        )

    # Feeds from elsewhere -----------------------------------------------------------------

    def import_feed(self, feed: DataFrame) -> int:
        """Store a change feed as the commits of a new table (a source to stream from).

        The feed's versions become commits in order, numbered from 0 without gaps.
        """
        require_columns(feed, META, "not a change feed")
        if self.current_version() >= 0:
            raise ValueError(f"{self.path} is not empty")
        sizes = sorted((r["version"], r["rows"]) for r in feed_ops.commit_sizes(feed).collect())
        if sizes and [v for v, _ in sizes] != list(range(len(sizes))):
            raise ValueError("feed versions must run from 0 without gaps")
        data = feed.withColumn(PART, F.lit(FEED)).hint("rebalance", COMMIT_VERSION)
        data.write.mode("overwrite").partitionBy(COMMIT_VERSION, PART).parquet(f"{self.path}/data")
        schema = T.StructType([f for f in feed.schema.fields if f.name not in META])
        stored = T.StructType([f for f in feed.schema.fields if f.name != COMMIT_VERSION])
        for v, n in sizes:
            self._publish(
                Snapshot(v, _nullable(schema), _nullable(stored)), "IMPORT", [], Outcome(appended=n), "stored", n
            )
        return len(sizes)

    def rewrite(
        self,
        layout: Callable[[DataFrame], DataFrame],
        operation: str = "OPTIMIZE",
        buckets: int | None = None,
    ) -> None:
        """Write all rows again in another layout; the table's contents stay, its feed is empty.

        A merged table stays bucketed, in ``buckets`` buckets if given; its layout sees the bucket
        as column ``_bucket`` and keeps the rows of a bucket together.
        """
        started = time.monotonic()
        base = self.snapshot()
        v = base.version + 1
        rows = self.read()
        if base.keys:
            buckets = buckets or base.buckets
            rows = layout(with_key_bucket(rows, base.keys, buckets, BUCKET))
            data = f"{self.path}/data/{COMMIT_VERSION}={v}"
            rows.withColumn(PART, F.lit(STATE)).write.mode("overwrite").partitionBy(
                PART, BUCKET
            ).parquet(data)
            extents = [
                Extent(r[BUCKET], v, v, r["rows"], r["files"], r["bytes"]) for r in self._written(data)
            ]
        else:
            layout(rows).write.mode("overwrite").parquet(self._folder(v, STATE))
            extents = [Extent(None, v, v, base.rows, *self._files(v))] if base.rows else []
        after = self._next(base, "", None, None, buckets=buckets if base.keys else 0)
        outcome = Outcome(target_version=v, appended=base.rows, duration_ms=_since(started))
        self._publish(after, operation, extents, outcome, "none", 0, base.extents)

    def run_log(self) -> DataFrame:
        """One row per commit with its metrics, for ``changeflow.operators.runs``."""
        info = F.from_json(
            F.get_json_object("action", "$.commitInfo"),
            "timestamp bigint, operation string, job string, metrics struct<source_rows: bigint, "
            "inserts: bigint, updates: bigint, deletes: bigint, appended: bigint, "
            "target_version: bigint, duration_ms: bigint>",
        )
        rows = read_log(self.spark, self.log_path).select("version", info.alias("i")).where("i IS NOT NULL")
        return rows.select(
            F.coalesce("i.job", F.lit("default")).alias("job"),
            F.col("version").alias("seq"),
            "i.timestamp",
            "i.operation",
            F.col("i.metrics.source_rows").alias("rows"),
            "i.metrics.inserts",
            "i.metrics.updates",
            "i.metrics.deletes",
            "i.metrics.appended",
            "i.metrics.duration_ms",
        )


def _since(started: float) -> int:
    return int((time.monotonic() - started) * 1000)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def _same_columns(schema: T.StructType, rows: DataFrame) -> None:
    """Appends and overwrites do not evolve the table."""
    have, want = {(f.name, f.dataType) for f in rows.schema.fields}, {(f.name, f.dataType) for f in schema.fields}
    if have != want:
        raise ValueError(f"columns differ from the target's: {sorted(map(str, have ^ want))}")


def _joined(extents: list[Extent]) -> list[Extent]:
    """Runs of append commits as one extent each, so the log stays small."""
    out: list[Extent] = []
    for e in extents:
        if out and e.bucket is None and out[-1].bucket is None and out[-1].last + 1 == e.first:
            p = out[-1]
            out[-1] = Extent(None, p.first, e.last, p.rows + e.rows, p.files + e.files, p.bytes + e.bytes)
        else:
            out.append(e)
    return out
