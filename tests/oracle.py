"""Runs a registered query and its SQL twin and compares rows, names and types."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


_SAME = {"string": "varchar", "timestamp_ntz": "timestamp", "timestamp": "timestamp with time zone", "int": "integer"}


def rows(cursor_rows, order):
    return sorted((tuple(r[i] for i in order) for r in cursor_rows), key=repr)


def compare(spark, con, fn, sql, sf) -> tuple[int, str | None]:
    """Row count, and None if equal, else what differs."""
    df = fn(spark, sf)
    names = df.columns
    rel = con.sql(sql)
    if sorted(names) != sorted(rel.columns):
        return 0, f"columns {sorted(names)} vs {sorted(rel.columns)}"
    types = dict(zip(rel.columns, (str(t).lower() for t in rel.types), strict=True))
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        if not t.startswith(("array", "map", "struct")) and _SAME.get(t, t) != types[f.name]:
            return 0, f"type of {f.name}: {t} vs {types[f.name]}"
    order = sorted(names)
    left = rows((tuple(r) for r in df.collect()), [names.index(c) for c in order])
    right = rows(rel.fetchall(), [rel.columns.index(c) for c in order])
    if len(left) != len(right):
        return len(left), f"{len(left)} rows vs {len(right)}"
    bad = [(a, b) for a, b in zip(left, right, strict=True) if repr(a) != repr(b)]
    return len(left), f"{len(bad)} rows differ, e.g. {bad[0]}" if bad else None
