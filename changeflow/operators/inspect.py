"""Look at a table: preview, schema, summary."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.schema import column

MAX_PREVIEW = 1_000


def preview(
    df: DataFrame,
    limit: int = 100,
    where: str | None = None,
    order_by: Sequence[Column | str] = (),
) -> DataFrame:
    """Up to ``limit`` rows (1 to 1,000), all values as text, NULL as ``NULL``.

    ``where`` is the condition, with or without the word WHERE. An order makes the choice of rows
    repeatable.
    """
    condition = re.sub(r"^\s*where\b", "", where or "", flags=re.IGNORECASE).strip()
    if condition:
        df = df.where(F.expr(condition))
    if order_by:
        df = df.orderBy(*order_by)
    shown = df.limit(min(max(limit, 1), MAX_PREVIEW))
    return shown.select(
        *[F.coalesce(column(c).cast("string"), F.lit("NULL")).alias(c) for c in df.columns]
    )


def schema_rows(df: DataFrame) -> DataFrame:
    """``name, data_type, nullable`` of each column, in order."""
    rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "name string, data_type string, nullable boolean")
