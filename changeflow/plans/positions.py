"""Row positions and running totals without a window over all rows.

Both cut the order into slices of a fixed number of values, work inside the slices in parallel, and add
what lies before a slice. Slices are summed the same way, in slices of slices, so that no window takes
more than ``FAN`` rows, however far apart the values lie.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeflow.schema import column


#: Values in a slice of slices. Three levels above a slice of as many rows reach all 64-bit numbers.
FAN, LEVELS = 65_536, 2


def _before(counts: DataFrame, keys: Sequence[str], levels: int) -> DataFrame:
    """``counts`` (``keys``, ``n``, ``v``) with ``before``: the sum of ``v`` over smaller ``n`` of the same keys.

    Keys are never NULL.
    """
    up = [f"{k}_up" for k in keys]
    parent = F.floor(F.col("n") / FAN).cast("bigint")
    within = [*keys, "parent"] if levels else list(keys)
    earlier = Window.partitionBy(*within).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("parent", parent) if levels else counts
    placed = placed.withColumn("before", F.coalesce(F.sum("v").over(earlier), F.lit(0)))
    if not levels:
        return placed
    sums = counts.groupBy(*keys, parent.alias("n")).agg(F.sum("v").alias("v"))
    above = _before(sums, keys, levels - 1).select(
        *[F.col(k).alias(u) for k, u in zip(keys, up, strict=True)], F.col("n").alias("n_up"), F.col("before").alias("above")
    )
    on = (F.col("parent") == F.col("n_up")) & reduce(and_, [F.col(k) == F.col(u) for k, u in zip(keys, up, strict=True)], F.lit(True))
    return placed.join(above, on).select(*keys, "n", "v", (F.col("before") + F.col("above")).alias("before"))


def row_positions(
    df: DataFrame,
    groups: Sequence[str],
    order: str,
    width: int = 65_536,
    name: str = "position",
    size: str | None = None,
) -> DataFrame:
    """Number the rows of each group from 0 in ``order``; ``size`` names a column for the group's rows.

    ``order`` is an integer column without NULLs, unique within its group, so a slice of ``width``
    values holds at most ``width`` rows however large the group is. NULL is a group like any other:
    slices are told apart by a struct, whose NULL fields compare as equal.
    """
    group = F.struct(*[column(c).alias(f"g{i}") for i, c in enumerate(groups)], F.lit(0).alias("g"))
    sliced = df.withColumn("__slice", F.struct(group.alias("g"), F.floor(column(order) / width).cast("bigint").alias("n")))
    counts = sliced.groupBy("__slice").agg(F.count(F.lit(1)).alias("v"))
    counts = counts.select(F.col("__slice.g").alias("__g"), F.col("__slice.n").alias("n"), "v")
    before = _before(counts, ["__g"], LEVELS)
    if size:
        whole = counts.groupBy("__g").agg(F.sum("v").alias("__size")).withColumnRenamed("__g", "__h")
        before = before.join(whole, F.col("__g") == F.col("__h"))
    before = before.select(
        F.struct(F.col("__g").alias("g"), F.col("n").alias("n")).alias("__slice"),
        F.col("before").alias("__before"),
        *([F.col("__size").alias(size)] if size else []),
    )
    inside = Window.partitionBy("__slice").orderBy(column(order))
    return (
        sliced.withColumn("__inside", F.row_number().over(inside))
        .join(before, "__slice")
        .withColumn(name, F.col("__before") + F.col("__inside") - 1)
        .drop("__slice", "__before", "__inside")
    )


def running_sum(
    df: DataFrame, order: str, value: Column, width: int = FAN, name: str = "total"
) -> DataFrame:
    """Sum of ``value`` over all rows up to this one; ``order`` is a unique integer column."""
    sliced = df.withColumn("__slice", F.floor(column(order) / width).cast("bigint"))
    sliced = sliced.withColumn("__value", value)
    counts = sliced.groupBy(F.col("__slice").alias("n")).agg(F.sum("__value").alias("v"))
    before = _before(counts, [], LEVELS).select(F.col("n").alias("__slice"), F.col("before").alias("__before"))
    inside = Window.partitionBy("__slice").orderBy(column(order))
    inside = inside.rowsBetween(Window.unboundedPreceding, 0)
    return (
        sliced.withColumn("__inside", F.sum("__value").over(inside))
        .join(before, "__slice")
        .withColumn(name, F.col("__before") + F.col("__inside"))
        .drop("__slice", "__before", "__inside", "__value")
    )
