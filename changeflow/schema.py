"""Column names, change types and schemas shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHANGE_TYPE = "_change_type"
COMMIT_VERSION = "_commit_version"
COMMIT_TIMESTAMP = "_commit_timestamp"
META = (CHANGE_TYPE, COMMIT_VERSION, COMMIT_TIMESTAMP)

INSERT = "insert"
PREIMAGE = "update_preimage"
POSTIMAGE = "update_postimage"
DELETE = "delete"

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("partition_id", T.StringType(), False),
        T.StructField("offset", T.StringType(), True),
        T.StructField("sequence_number", T.LongType(), False),
        T.StructField("enqueued_time", T.TimestampType(), True),
        T.StructField("body", T.StringType(), True),
        T.StructField("properties", T.StringType(), True),
    ]
)


def quoted(name: str) -> str:
    """Backtick a column name so dots, spaces and case survive."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str, side: str | None = None) -> Column:
    return F.col(f"{side}.{quoted(name)}" if side else quoted(name))


def data_columns(df: DataFrame) -> list[str]:
    """All columns but the three feed columns, in order."""
    return [c for c in df.columns if c not in META]


def _holds_map(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.MapType | T.VariantType):
        return True
    if isinstance(data_type, T.ArrayType):
        return _holds_map(data_type.elementType)
    if isinstance(data_type, T.StructType):
        return any(_holds_map(f.dataType) for f in data_type.fields)
    return False


def hashable_columns(df: DataFrame) -> list[str]:
    """Columns Spark can hash: all but maps and variants, also inside other types."""
    return [f.name for f in df.schema.fields if not _holds_map(f.dataType)]


def is_not_type(change_type: str, side: str | None = None) -> Column:
    """True for rows of any other type; a missing type counts as another type."""
    c = column(CHANGE_TYPE, side)
    return c.isNull() | (c != change_type)


def require_columns(df: DataFrame, names, what: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing column(s) {missing}; available: {df.columns}")
