"""Z-order keys: interleaved bits of several columns' ranks.

Ranks come from bounds that cut a column into parts of about equally many rows. The bounds rest on all rows:
on mergeable quantile sketches of numbers and times, and of texts on a tree of prefixes with the number of
texts below each. Rows are ranked by a binary search among the bounds, in the JVM.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow.schema import column

BITS = 8
#: Bounds are sent to tasks, so a column has at most so many bits.
MOST_BITS = 12
#: Size of a sketch: up to so many rows its quantiles are exact, beyond them they are off by 0.01 % of the rows.
SKETCH = 65_535
#: Bytes of a text that count, and levels of the tree of prefixes.
COUNTED, LEVELS = 4_096, 32
#: Texts of one prefix that are sorted rather than looked further into, and the share of a cell (one in so many)
#: that a prefix may hold to count as one value where it has more texts.
FEW, FINE = 1_024, 64


def interleave(ranks: Sequence[Column], bits: int = BITS) -> Column:
    """Bit ``i`` of rank ``j`` becomes bit ``i * len(ranks) + j`` of the key."""
    if bits * len(ranks) > 63:
        raise ValueError(f"{len(ranks)} columns of {bits} bits do not fit into one key")
    key = F.lit(0).cast("bigint")
    for j, rank in enumerate(ranks):
        for i in range(bits):
            bit = F.shiftright(rank.cast("bigint"), i).bitwiseAND(F.lit(1).cast("bigint"))
            key = key.bitwiseOR(F.shiftleft(bit, i * len(ranks) + j))
    return key


def bits_for(files: int, columns: int) -> int:
    """Bits a column so that the curve has some sixteen cells for each file."""
    cells = max(files, 1) * 16
    return min(max(BITS, -(-(cells - 1).bit_length() // columns)), MOST_BITS, 63 // columns)


def _sortable(df: DataFrame, name: str) -> Column:
    """A column as bytes of text, or as a number that keeps its order; NULL for NaN."""
    kind = df.schema[name].dataType
    c = column(name)
    if isinstance(kind, T.StringType):
        return F.substring(c.cast("binary"), 1, COUNTED)
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, T.BooleanType):
        return c.cast("int").cast("double")
    value = c.cast("double")
    return F.when(~F.isnan(value), value)


def _positions(n: int, bits: int) -> list[int]:
    """The rows, counted from 1 in the column's order, whose values are the bounds."""
    return [-(-k * n // 2**bits) for k in range(1, 2**bits)]


def _number_bounds(df: DataFrame, columns: Sequence[str], bits: int) -> dict[str, list[float]]:
    """Bounds of all number columns, in one pass."""
    if not columns:
        return {}
    values = df.select(*[_sortable(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    made = values.agg(*[F.kll_sketch_agg_double(f"c{i}", F.lit(SKETCH)).alias(f"s{i}") for i in range(len(columns))])
    shares = F.lit([k / 2**bits for k in range(1, 2**bits)])

    def bounds(i: int) -> Column:
        return F.when(F.kll_sketch_get_n_double(f"s{i}") > 0, F.kll_sketch_get_quantile_double(f"s{i}", shares)).alias(f"b{i}")

    row = made.select(*[bounds(i) for i in range(len(columns))]).first()
    return {c: row[i] or [] for i, c in enumerate(columns)}


@dataclass(frozen=True)
class _Node:
    """Texts that begin with ``prefix``: ``n`` of them, among which the rows ``positions`` are wanted."""

    prefix: bytes
    n: int
    positions: tuple[int, ...]


def _within(texts: DataFrame, nodes: Sequence[_Node]) -> DataFrame:
    """The texts below a node, with its ``number``. No node lies below another."""
    known = [(k, bytearray(node.prefix), len(node.prefix), [float(p) for p in node.positions]) for k, node in enumerate(nodes)]
    known = texts.sparkSession.createDataFrame(known, "number int, prefix binary, length int, at array<double>")
    lengths = sorted({len(node.prefix) for node in nodes})
    cut = texts.select("t", F.explode(F.lit(lengths).cast("array<int>")).alias("length"))
    cut = cut.withColumn("prefix", F.expr("substring(t, 1, length)"))
    return cut.join(F.broadcast(known), ["length", "prefix"])


def _look(texts: DataFrame, nodes: Sequence[_Node]) -> list:
    """For each node those next bytes (-1: the text ends) that hold wanted texts, with how many lie before."""
    byte = F.conv(F.hex(F.substring("t", F.col("length") + 1, F.lit(1))), 16, 10).cast("int")
    counts = _within(texts, nodes).groupBy("number", "at", F.coalesce(byte, F.lit(-1)).alias("byte"))
    counts = counts.agg(F.count("*").alias("n"), F.min("t").alias("low"), F.max("t").alias("high"))
    earlier = Window.partitionBy("number").orderBy("byte").rowsBetween(Window.unboundedPreceding, -1)  # 257 rows at most
    placed = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    wanted = F.filter("at", lambda p: (p > F.col("before")) & (p <= F.col("before") + F.col("n")))
    return placed.withColumn("at", wanted).where(F.size("at") > 0).collect()  # no more rows than bounds


def _child(node: _Node, row) -> _Node | bytes:
    """The text that a row of ``_look`` stands for, or the node of what all its texts begin with."""
    if row.byte < 0:
        return node.prefix
    low, high = bytes(row.low), bytes(row.high)
    return low if low == high else _Node(os.path.commonprefix([low, high]), row.n, tuple(int(p) - row.before for p in row.at))


def _text_bounds(df: DataFrame, name: str, bits: int) -> list[bytes]:
    """Bounds of a text column, in the order of its bytes: one pass a level of the tree of prefixes."""
    texts = df.select(_sortable(df, name).alias("t")).where("t IS NOT NULL")
    total = texts.count()
    if not total:
        return []
    done: list[bytes] = []
    nodes, few = [_Node(b"", total, tuple(_positions(total, bits)))], []
    for _ in range(LEVELS):
        children: list[_Node] = []
        for row in _look(texts, nodes) if nodes else ():
            child = _child(nodes[row.number], row)
            if isinstance(child, bytes):
                done += [child] * len(row.at)
            else:
                children.append(child)
        few += [c for c in children if c.n <= FEW]
        large = [c for c in children if c.n > FEW]
        done += [c.prefix for c in large if c.n * FINE <= total >> bits for _ in c.positions]
        nodes = [c for c in large if c.n * FINE > total >> bits]
    done += [n.prefix for n in nodes for _ in n.positions]
    if few:
        sorted_texts = _within(texts, few).groupBy("number", "at").agg(F.array_sort(F.collect_list("t")).alias("ts"))
        at = F.transform("at", lambda p: F.get(F.col("ts"), F.least(p.cast("int"), F.size("ts")) - 1))
        done += [bytes(b) for r in sorted_texts.select(at.alias("b")).collect() for b in r.b]
    return sorted(done)


def _rank(value: Column, bounds: list, bits: int) -> Column:
    """How many of the sorted bounds are not above the value; 0 for NULL."""
    if not bounds:
        return F.lit(0).cast("bigint")
    if isinstance(bounds[0], bytes):
        known = F.array(*[F.lit(bytearray(b)) for b in bounds])
    else:
        known = F.array(*[F.lit(float(b)) for b in bounds])
    steps = F.lit([2**i for i in reversed(range(bits))]).cast("array<int>")
    found = F.aggregate(
        steps, F.lit(0), lambda r, step: F.when(F.get(known, r + step - 1) <= value, r + step).otherwise(r)
    )
    return found.cast("bigint")


def quantile_ranks(df: DataFrame, columns: Sequence[str], bits: int = BITS) -> list[Column]:
    """A rank of ``0 .. 2**bits - 1`` per column, about the same number of rows in each.

    Ranks keep the column's order, text by its first ``COUNTED`` bytes. NULLs and NaN get rank 0. Bounds of
    texts are the exact quantiles, but where many texts begin alike, up to one in ``FINE`` of a cell. Those of
    numbers are exact up to ``SKETCH`` rows, and beyond that a rank differs from the exact one by one at most.
    The driver gets the bounds, and of texts the smallest and largest below each node of the tree that holds a
    bound.
    """
    text = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    bounds: dict = _number_bounds(df, [c for c in columns if c not in text], bits)
    bounds |= {c: _text_bounds(df, c, bits) for c in text}
    return [_rank(_sortable(df, c), bounds[c], bits) for c in columns]
