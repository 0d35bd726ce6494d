"""Test tables generated in parallel: every value is a hash of the row id (a bigint column ``id``)."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the sample table.
EVENT_TYPES = ["create", "update", "delete", "refund", "credit"]
CATEGORIES = ["compute", "storage", "network", "database", "analytics", "ml"]
PRODUCTS = ["service-a", "service-b", "service-c", "service-d", "service-e"]
CURRENCIES = ["USD", "EUR", "GBP", "JPY", "CAD"]
REGIONS = ["us-east", "us-west", "eu-west", "ap-south", "ap-east"]
STATUSES = ["active", "completed", "pending", "processing"]

# How far back an update may reach for the id it reuses.
REUSE_WINDOW = 100_000


def row_ids(spark: SparkSession, rows: int) -> DataFrame:
    if rows < 1:
        raise ValueError("a table without rows can not be made")
    return spark.range(rows)


# A hash in plain integer arithmetic: no product leaves 63 bits, and any SQL engine can repeat it.
PRIME = 2_147_483_647
FACTORS = (48_271, 69_621, 39_373)


def salt_number(salt: str) -> int:
    return zlib.crc32(salt.encode()) % PRIME


def _hash(salt: str) -> Column:
    """A number in ``0 .. PRIME - 1`` from id and salt."""
    a, b, c = FACTORS
    n = salt_number(salt)
    i = F.col("id")
    x = ((i % PRIME + F.floor(i / PRIME).cast("bigint") * 7_919 + n) % PRIME * a + n) % PRIME
    x = (x.bitwiseXOR(F.shiftright(x, 15)) * b + 1) % PRIME
    return x.bitwiseXOR(F.shiftright(x, 13)) * c % PRIME


def _below(salt: str, n: int) -> Column:
    return _hash(salt) % n


def _pick(values: list[str], salt: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (_below(salt, len(values)) + 1).cast("int"))


def _uuid(id_column: Column, salt: str) -> Column:
    return F.regexp_replace(
        F.md5(F.concat(id_column.cast("string"), F.lit(f"/{salt}"))),
        "^(.{8})(.{4})(.{4})(.{4})(.{12})$",
        "$1-$2-$3-$4-$5",
    )


def _before(now: str, salt: str, seconds: int) -> Column:
    moment = F.lit(now).cast("timestamp_ntz")
    return moment - F.make_dt_interval(secs=_below(salt, seconds).cast("decimal(18,6)"))


def sample_events(
    ids: DataFrame, update_fraction: float = 0.3, batch_id: int = 0, now: str = "2024-06-01 00:00:00"
) -> DataFrame:
    """Transactions, one per ``id``; some reuse the event id of an earlier row, status ``updated``.

    The first row of each block of ids is always new. An update takes the event id of the first row
    of its own or an earlier block at most ``REUSE_WINDOW`` rows back.
    """
    block = 10
    back = _below("back", REUSE_WINDOW // block) * block
    first = F.col("id") - F.col("id") % block
    fresh_id = F.greatest(first - back, F.lit(0))
    share = min(max(update_fraction, 0.0), 1.0)
    reuse = (F.col("id") % block != 0) & (_below("reuse", 1_000_000) < round(share * 1_000_000))
    return ids.select(
        _uuid(F.when(reuse, fresh_id).otherwise(F.col("id")), "event").alias("event_id"),
        F.format_string("acct-%08d", _below("account", 99_999_999)).alias("account_id"),
        _before(now, "time", 3_600).alias("event_timestamp"),
        _pick(EVENT_TYPES, "type").alias("event_type"),
        _pick(CATEGORIES, "category").alias("category"),
        _pick(PRODUCTS, "product").alias("product"),
        ((_below("amount", 50_000_000 - 1_000) + 1_000).cast("decimal(18,0)") / F.lit(10_000).cast("decimal(5,0)"))
        .cast("decimal(18,4)")
        .alias("amount"),
        _pick(CURRENCIES, "currency").alias("currency"),
        (_below("eligible", 100) < 85).alias("is_eligible"),
        _pick(REGIONS, "region").alias("region"),
        F.when(reuse, "updated").otherwise(_pick(STATUSES, "status")).alias("status"),
        F.lit(batch_id).cast("int").alias("batch_id"),
    )


def wide_table(
    ids: DataFrame, columns: int = 30, now: str = "2024-06-01 00:00:00", version: Column | None = None
) -> DataFrame:
    """A wide table, one row per ``id``; column types repeat every five columns."""
    if columns < 2:
        raise ValueError("a table has an id and a time, so two columns or more")
    made = [
        _uuid(F.col("id"), "event").alias("event_id"),
        _before(now, "time", 30 * 24 * 3_600).alias("event_timestamp"),
    ]
    for i in range(columns - 2):
        salt = f"c{i}"
        name, value = [
            ("str", F.md5(F.concat(F.col("id").cast("string"), F.lit(f"/{salt}")))),
            ("int64", _hash(salt) * 2**32 + _hash(salt + "+") * 2 - (2**62 - 2**32)),
            ("dbl", _hash(salt) / F.lit(float(PRIME)) * 1_000_000.0),
            ("bool", _below(salt, 2) == 0),
            ("int32", (_hash(salt) * 2 - (PRIME - 1)).cast("int")),
        ][i % 5]
        made.append(value.alias(f"{name}_{i:02d}"))
    if version is not None:
        made.append(version.alias("_commit_version"))
    return ids.select(*made)


def commit_of(rows: int, commits: int) -> Column:
    """The commit a row id belongs to when ``rows`` are spread over ``commits``."""
    if commits < 1:
        raise ValueError("all rows belong to a commit, so there is one or more")
    return F.floor(F.col("id") / -(-rows // commits)).cast("bigint")
