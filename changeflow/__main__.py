"""``spark-submit``-able commands: ``python -m changeflow {stream,create-table,inspect,...}``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from changeflow import jobs
from changeflow.operators.merge import parse_mode
from changeflow.session import configure
from changeflow.sinks.table import VersionedTable
from changeflow.sources.events import stream_event_files
from changeflow.streaming.transfer import EventSpec, EventTransfer, Transfer, TransferSpec, log_signature


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="changeflow")
    commands = p.add_subparsers(dest="command", required=True)

    s = commands.add_parser("stream", help="move a table's changes into a target")
    s.add_argument("--source", required=True)
    s.add_argument("--source-format", default="changeflow", choices=["changeflow", "delta"])
    s.add_argument("--target", required=True)
    s.add_argument("--checkpoint", help="streaming checkpoint folder; not needed with --once")
    s.add_argument("--sink-mode", default="append")
    s.add_argument("--merge-keys", default="")
    s.add_argument("--merge-update-columns", default="")
    s.add_argument("--when-matched-update")
    s.add_argument("--when-matched-delete")
    s.add_argument("--when-not-matched-insert")
    s.add_argument("--dedupe-order-by")
    s.add_argument("--transform-sql")
    s.add_argument("--start-version", type=int)
    s.add_argument("--end-version", type=int)
    s.add_argument("--max-versions-per-batch", type=int, default=10)
    s.add_argument("--max-input-rows-per-batch", type=int, default=0)
    s.add_argument("--adaptive", action="store_true", help="group and split commits by row count")
    s.add_argument("--once", action="store_true", help="apply one group and end")
    s.add_argument("--buckets", type=int, default=64, help="key buckets of a merge target made here")
    s.add_argument("--interval", help="keep running, e.g. '5 seconds'; else drain and end")

    n = commands.add_parser("stream-events", help="move an event log, as parquet files, into a table")
    n.add_argument("events", help="folder of normalised events")
    n.add_argument("--log", required=True, help="namespace|name[|consumer group] that stored offsets belong to")
    n.add_argument("--target", required=True)
    n.add_argument("--sink-mode", default="append")
    n.add_argument("--merge-keys", default="")
    n.add_argument("--merge-update-columns", default="")
    n.add_argument("--transform-sql")
    n.add_argument("--partitions", default="", help="only these log partitions")
    n.add_argument("--initial-position", default="earliest")
    n.add_argument("--max-files-per-batch", type=int, default=100)
    n.add_argument("--checkpoint", required=True)
    n.add_argument("--once", action="store_true", help="take what is there as one batch and end")
    n.add_argument("--interval", help="keep running, e.g. '5 seconds'; else drain and end")
    n.add_argument("--buckets", type=int, default=64, help="key buckets of a merge target made here")

    c = commands.add_parser("create-table", help="make a wide test table")
    c.add_argument("table")
    c.add_argument("--rows", type=int, default=200_000)
    c.add_argument("--commits", type=int, default=1)
    c.add_argument("--columns", type=int, default=30)
    c.add_argument("--zorder-by", default="")
    c.add_argument("--overwrite", action="store_true")

    e = commands.add_parser("produce", help="append batches of sample transactions")
    e.add_argument("table")
    e.add_argument("--batches", type=int, default=1)
    e.add_argument("--rows", type=int, default=100_000)
    e.add_argument("--update-fraction", type=float, default=0.3)

    commands.add_parser("inspect", help="version, size, schema, commits").add_argument("table")

    v = commands.add_parser("preview", help="some rows as text")
    v.add_argument("table")
    v.add_argument("--limit", type=int, default=100)
    v.add_argument("--where")

    o = commands.add_parser("optimize", help="compact or z-order")
    o.add_argument("table")
    o.add_argument("--zorder-by", default="")
    o.add_argument("--target-bytes", type=int, default=256 * 1024 * 1024)

    w = commands.add_parser("stale-files", help="report files no live commit needs")
    w.add_argument("table")
    w.add_argument("--retention-hours", type=int, default=168)
    w.add_argument("--accept-short-retention", action="store_true")

    t = commands.add_parser("track-snapshot", help="derive changes from a parquet snapshot")
    t.add_argument("table")
    t.add_argument("--snapshot", required=True)
    t.add_argument("--keys", required=True)
    return p


def _names(text: str) -> list[str]:
    return [s.strip() for s in text.split(",") if s.strip()]


def stream(spark: SparkSession, a: argparse.Namespace) -> None:
    options = {
        "when_matched_update": a.when_matched_update,
        "when_matched_delete": a.when_matched_delete,
        "when_not_matched_insert": a.when_not_matched_insert,
        "dedupe_order_by": a.dedupe_order_by,
        "transform_sql": a.transform_sql,
    }
    mode, merge = parse_mode(a.sink_mode, a.merge_keys, a.merge_update_columns, **options)
    spec = TransferSpec(
        a.source,
        a.target,
        mode,
        merge,
        start_version=a.start_version,
        end_version=a.end_version,
        max_versions=a.max_versions_per_batch,
        max_rows=a.max_input_rows_per_batch,
        adaptive=a.adaptive,
        source_format=a.source_format,
        buckets=a.buckets,
    )
    transfer = Transfer(spark, spec)
    if a.once:
        for outcome in transfer.run(once=True):
            print(outcome)
        return
    if not a.checkpoint:
        raise SystemExit("stream needs --checkpoint, or --once")
    transfer.follow(a.checkpoint, a.interval)


def stream_events(spark: SparkSession, a: argparse.Namespace) -> None:
    mode, merge = parse_mode(a.sink_mode, a.merge_keys, a.merge_update_columns, transform_sql=a.transform_sql)
    signature = log_signature(*(part.strip() for part in a.log.split("|", 2)))
    spec = EventSpec(
        signature,
        a.target,
        mode,
        merge,
        partitions=a.partitions or None,
        initial_position=a.initial_position,
        buckets=a.buckets,
    )
    events = stream_event_files(spark, a.events, max_files=a.max_files_per_batch)
    EventTransfer(spark, spec).start(events, a.checkpoint, a.interval, once=a.once).awaitTermination()


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = configure(SparkSession.builder.appName("changeflow").getOrCreate())
    if a.command == "stream":
        stream(spark, a)
        return
    if a.command == "stream-events":
        stream_events(spark, a)
        return
    if a.command == "create-table":
        table = jobs.create_table(
            spark, a.table, a.rows, a.commits, a.columns, _names(a.zorder_by), a.overwrite
        )
        table.describe().show(truncate=False)
        return
    table = VersionedTable(spark, a.table)
    if a.command == "inspect":
        for part in jobs.inspect(table).values():
            part.show(1_000, truncate=False)
    elif a.command == "preview":
        found = jobs.show_preview(table.read(), a.limit, a.where)
        print("\t".join(found.columns))
        for row in found.rows:
            print("\t".join(row))
    elif a.command == "produce":
        jobs.produce_events(table, a.batches, a.rows, a.update_fraction)
    elif a.command == "optimize":
        print(jobs.optimize(table, _names(a.zorder_by), a.target_bytes))
    elif a.command == "stale-files":
        stale = jobs.stale_table_files(table, a.retention_hours, not a.accept_short_retention)
        print(f"{stale.count()} stale file(s)")
        stale.orderBy("path").show(100, truncate=False)
    else:
        print(jobs.track_snapshot(table, spark.read.parquet(a.snapshot), _names(a.keys)))


if __name__ == "__main__":
    main(sys.argv[1:])
