"""Connected components of a graph by alternating large-star and small-star steps.

Each step is a minimum for each node, combined before the shuffle, and a join back to the edges that splits
hot nodes, so a node with a third of all edges is many tasks' work. Few edges are one task's work, which
shuffles nothing. Every round is written to the shared folder, which cuts the lineage and survives lost
executors; only two numbers a round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` and read it again."""
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Edges up to which a step is one task of 16 MB: shuffling so few costs many tasks each time.
ONE_TASK = 1_000_000


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of so many rows, in one partition if they are few; what is grouped or joined then isn't shuffled."""
    return df.coalesce(1) if rows <= ONE_TASK else df


def _joined(edges: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """The join with ``least``; of few edges inside the task, neither broadcast nor shuffled."""
    return edges.join(least.hint("shuffle_hash") if n <= ONE_TASK else least, "u")


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    ways = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    both = gathered(edges, n).select(F.inline(ways))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = _joined(both, least, n).where(F.col("v") > F.col("u"))
    return met.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = _joined(edges, least, n).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return gathered(others.unionByName(least.select("u", F.col("m").alias("v"))), n).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, folder: str, most: int | None = None) -> DataFrame:
    """``u`` and ``v``: each node of ``edges`` but the smallest of its component, and that smallest.

    ``edges`` has the columns ``u`` and ``v`` of one ordered type; loops, repeats and directions don't matter,
    edges with a null end are left out. ``most`` is a bound on the number of edges, if one is known.
    """
    edges = edges if most is None else gathered(edges, most)
    tidy = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), F.isnull("u").alias("n"), F.isnull("v").alias("o"))
    now = stored(tidy.where(~F.col("n") & ~F.col("o") & (F.col("u") != F.col("v"))).select("u", "v").distinct(), f"{folder}/0")
    before, turn = _state(now), 0
    while n := before[0]:
        turn += 1
        now = stored(_small_star(_large_star(now, n), n), f"{folder}/{turn}")
        state = _state(now)
        if state == before:
            break
        before = state
    return now
