"""What lies before each block of an ordered list, for values that can be put together.

Blocks are put together in runs of ``FAN``, runs of blocks in runs again, until one is left; then what lies
before a run is handed down to its members. So no task takes more than ``FAN`` values, however many blocks
there are, and only as many levels are built as the range of block numbers needs.

A value may be a sum, a bounded tail of rows, or a map from a state to the next one. ``join`` puts two
values together, the earlier one first; ``step`` applies a value to a state. Both are SQL text over the names
of their two arguments.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN = 64


@dataclass(frozen=True)
class Scan:
    join: str  # of the values ``a`` and ``b``
    step: str  # of the state ``s`` and the value ``b``
    state: str  # the SQL type of a state


def span(df: DataFrame, number: str) -> tuple[int, int]:
    """The smallest block number and how many numbers there are from it to the largest."""
    low, high = df.agg(F.min(number), F.max(number)).first()
    return (0, 0) if low is None else (low, high - low + 1)


def before_blocks(blocks: DataFrame, scan: Scan, initial: str, first: int, numbers: int) -> DataFrame:
    """``g``, ``n`` and ``before``: the state that each block of ``blocks`` (``g``, ``n``, ``v``) is entered with.

    ``g`` is a struct that names the list a block belongs to, ``n`` the block's number, unique in its list and
    from ``first`` to ``first + numbers - 1``. Every list begins with the state ``initial``.
    """
    values = blocks.select("g", (F.col("n") - first).alias("n"), "v")
    return _entered(values, scan, initial, numbers).select("g", (F.col("n") + first).alias("n"), "before")


def _entered(values: DataFrame, scan: Scan, initial: str, numbers: int) -> DataFrame:
    if numbers <= 1:
        return values.select("g", "n", F.expr(initial).alias("before"))
    runs = values.groupBy("g", F.floor(F.col("n") / FAN).cast("bigint").alias("r"))
    runs = runs.agg(F.array_sort(F.collect_list(F.struct("n", "v"))).alias("c"))
    above = -(-numbers // FAN)
    if above <= 1:
        entered = runs.withColumn("before", F.expr(initial))
    else:
        whole = runs.select("g", F.col("r").alias("n"), F.expr(f"aggregate(slice(c, 2, {FAN}), c[0].v, (a, x) -> {_bound(scan.join, 'b', 'x.v')})").alias("v"))
        up = _entered(whole, scan, initial, above).select(F.col("g").alias("h"), F.col("n").alias("m"), "before")
        entered = runs.join(up, (F.col("g") == F.col("h")) & (F.col("r") == F.col("m")))
    walked = f"""aggregate(c, named_struct('s', before, 'out', cast(array() AS array<struct<n: bigint, before: {scan.state}>>)),
      (t, x) -> named_struct('s', {_bound(_bound(scan.step, 's', 't.s'), 'b', 'x.v')},
        'out', array_append(t.out, named_struct('n', x.n, 'before', t.s))), t -> t.out)"""
    return entered.select("g", F.inline(F.expr(walked)))


def _bound(expression: str, name: str, value: str) -> str:
    """``expression`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"transform(array({value}), {name} -> {expression})[0]"
