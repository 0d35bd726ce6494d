"""Approximate nearest neighbours by learned partitions.

On a bounded sample: the neighbour graph of its vectors is cut into partitions of nearly equal size, by
moving vectors to the partition of most of their neighbours while it has room; a small network then learns
from vector to partition. Every row of the table is filed under its most probable partition. A query visits
the most probable partitions until they hold enough probability, and rows enough to answer it; all rows met
there are ranked by the exact measure.

Partitions are stored in blocks of bounded size, so a partition that holds a third of all rows is many
tasks' work. Queries are sent to all blocks of the partitions they visit, themselves in blocks of bounded
size; each pair of blocks gives back only the nearest few for each query.

Defined results: vectors that are null, zero, of another length than most of the sample, or hold null or
non-finite components take no part, neither as queries nor as candidates. Repeated rows and equal vectors
are candidates each, ties go to the smaller id; a query's own id is no candidate, nor are repeats of it.
With fewer candidates than asked for, a query gets all there are. An empty table gives no rows. Other
columns than the id and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changeflow.session import work_dir

#: Vectors the partitions are learned from, and neighbours in their graph.
SAMPLE, NEIGHBOURS = 8_000, 10
#: Partitions: one for so many rows, within limits that the sample can support.
ROWS_PER_PARTITION, FEWEST, MOST = 2_000, 4, 256
#: Probability that the visited partitions hold together.
MASS = 0.98
#: Rows in a block and queries beside them.
BLOCK = 20_000
HIDDEN, STEPS, BATCH = 64, 600, 256


@dataclass
class Router:
    """From a vector of length 1 to the probability of each partition."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest others of each vector by cosine."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), max(k, 0)), np.int64)
    for a in range(0, len(x), 1000):
        s = x[a : a + 1000] @ x.T
        s[np.arange(len(s)), a + np.arange(len(s))] = -np.inf
        if k > 0:
            out[a : a + 1000] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 20, seed: int = 5) -> np.ndarray:
    """A partition for each vector: few cut edges, none more than a twentieth above its share."""
    rng = np.random.default_rng(seed)
    n, room = len(x), int(np.ceil(1.05 * len(x) / parts))
    # Begin from cuts along directions between far vectors, each into shares of equal size.
    label = np.zeros(n, np.int64)
    groups = [(np.arange(n), 0, parts)]
    while groups:
        g, begin, share = groups.pop()
        if share == 1 or not len(g):
            label[g] = begin
            continue
        pair = x[rng.choice(g, 2, replace=len(g) < 2)]
        order = g[np.argsort(x[g] @ (pair[0] - pair[1]), kind="stable")]
        half = share // 2
        at = round(len(g) * half / share)
        groups += [(order[:at], begin, half), (order[at:], begin + half, share - half)]
    size = np.bincount(label, minlength=parts)
    rows = np.repeat(np.arange(n), graph.shape[1])
    ends = graph.ravel()
    for _ in range(rounds):
        # Neighbours of each vector in each partition, edges counted from both ends.
        count = np.bincount(rows * parts + label[ends], minlength=n * parts)
        count += np.bincount(ends * parts + label[rows], minlength=n * parts)
        count = count.reshape(n, parts)
        best = count.argmax(axis=1)
        gain = count[np.arange(n), best] - count[np.arange(n), label]
        moved = 0
        for i in np.argsort(-gain, kind="stable")[: int((gain > 0).sum())]:
            if size[best[i]] < room:
                size[label[i]] -= 1
                size[best[i]] += 1
                label[i] = best[i]
                moved += 1
        if moved < n // 200:
            break
    return label


def learn_router(x: np.ndarray, label: np.ndarray, graph: np.ndarray, parts: int, seed: int = 5) -> Router:
    """Cross-entropy against where a vector and its neighbours are, by Adam."""
    rng = np.random.default_rng(seed)
    dim = x.shape[1]
    w = [
        rng.standard_normal((dim, HIDDEN)) * np.sqrt(2 / dim) * 2,
        np.zeros(HIDDEN),
        rng.standard_normal((HIDDEN, parts)) / np.sqrt(HIDDEN),
        np.zeros(parts),
    ]
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.arange(len(x)), label), 1.0)
    for k in range(graph.shape[1]):
        np.add.at(target, (np.arange(len(x)), label[graph[:, k]]), 1.0)
    target /= target.sum(axis=1, keepdims=True)
    mean, square = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w]
    for t in range(1, STEPS + 1):
        some = rng.integers(0, len(x), min(BATCH, len(x)))
        h = np.maximum(x[some] @ w[0] + w[1], 0)
        z = h @ w[2] + w[3]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        d = (z / z.sum(axis=1, keepdims=True) - target[some]) / len(some)
        dh = (d @ w[2].T) * (h > 0)
        grads = [x[some].T @ dh, dh.sum(axis=0), h.T @ d, d.sum(axis=0)]
        rate = 0.01 * (1 - t / (STEPS + 1))
        for v, g, m, s in zip(w, grads, mean, square, strict=True):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    return Router(*w)


def _valid(vector: Column, dim: int | None = None) -> Column:
    """Not null, not zero, no null or non-finite component."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    ok = vector.isNotNull() & ~bad & F.exists(vector, lambda v: v != 0)
    return ok if dim is None else ok & (F.size(vector) == dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that tiny and huge vectors have a length
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in vectors])


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that no square overflows or vanishes; no digit changes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0))[1])


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; equal rows give equal values wherever they stand."""
    q, x = _scaled(q), _scaled(x)
    return (q * x).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1)))


def fit(vectors: DataFrame, *, seed: int = 5) -> tuple[Router, int] | None:
    """The router and the length of vectors, from at most ``SAMPLE`` rows; None without vectors.

    ``vectors`` has ``vec_id`` and ``vec`` (array of double) of valid rows. The sample is the rows with the
    smallest hashed ids.
    """
    n = vectors.count()
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    if not rows:
        return None
    sizes = [len(r.vec) for r in rows]
    dim = max(set(sizes), key=lambda s: (sizes.count(s), s))
    x = _unit(np.array([r.vec for r in rows if len(r.vec) == dim], np.float64))
    parts = min(max(FEWEST, n // ROWS_PER_PARTITION), MOST, max(1, len(x) // 20))
    graph = neighbour_graph(x.astype(np.float32), NEIGHBOURS)
    label = balanced_parts(x, graph, parts, seed=seed)
    return learn_router(x, label, graph, parts, seed), dim


def _visits(p: np.ndarray, mass: float, size: np.ndarray, enough: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and partition for the most probable partitions of each row, until they hold ``mass`` and ``enough`` rows."""
    order = np.argsort(-p, axis=1, kind="stable")
    own, rows = np.take_along_axis(p, order, 1), size[order]
    before, met = np.cumsum(own, axis=1) - own, np.cumsum(rows, axis=1) - rows
    row, rank = np.nonzero((before < mass) | (met < enough))
    return row, order[row, rank]


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _sizes(filed: DataFrame) -> dict[int, int]:
    """Rows of each partition: at most ``MOST`` entries."""
    return {r.part: r["count"] for r in filed.groupBy("part").count().collect()}


def _blocks(sizes: dict[int, int]) -> Column:
    """Into how many blocks each partition is dealt."""
    return F.create_map(*[F.lit(x) for part, n in sorted(sizes.items()) for x in (part, -(-n // BLOCK))])[F.col("part")]


def _dealt(df: DataFrame, own: str, own_blocks: Column, other: str, other_blocks: Column) -> DataFrame:
    """Each row in one of its side's blocks, once for every block of the other side."""
    df = df.where(other_blocks.isNotNull()).withColumn(own, F.pmod(F.xxhash64("vec_id"), own_blocks).cast("int"))
    return df.withColumn(other, F.explode(F.sequence(F.lit(0), other_blocks.cast("int") - 1)))


def search(
    vectors: DataFrame,
    is_query: Column,
    *,
    top: int = 5,
    mass: float = MASS,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id`` and ``score`` (cosine) of each query's nearest found.

    ``is_query`` is a condition on ``vec_id``. Rows are filed in a stored table; queries are sent to blocks.
    """
    spark: SparkSession = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    v = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))
    v = v.where(F.col("vec_id").isNotNull() & _valid(F.col("vec")))
    learned = fit(v)
    if learned is None:
        return spark.createDataFrame([], schema)
    router, dim = learned
    v = v.where(F.size("vec") == dim)

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(part=router.probabilities(_unit(_matrix(b.vec))).argmax(axis=1).astype(np.int32))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                row, part = _visits(router.probabilities(_unit(_matrix(b.vec))), mass, size, top + 1)
                yield b.iloc[row].assign(part=part.astype(np.int32))

    base = work_dir(spark, "partitions")
    filed = _stored(v.mapInPandas(file, "vec_id long, vec array<double>, part int"), f"{base}/rows")
    sizes = _sizes(filed)
    size = np.array([sizes.get(k, 0) for k in range(router.w2.shape[1])])
    routed = _stored(v.where(is_query).mapInPandas(route, "vec_id long, vec array<double>, part int"), f"{base}/queries")
    asked = _sizes(routed)
    if not sizes or not asked:
        return spark.createDataFrame([], schema)
    row_blocks, query_blocks = _blocks(sizes), _blocks(asked)
    rows = _dealt(filed, "block", row_blocks, "turn", query_blocks)
    routed = _dealt(routed, "turn", query_blocks, "block", row_blocks)

    def nearest(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(block):
            queries = queries.drop_duplicates("vec_id")
            x, ids = _matrix(block.vec), block.vec_id.to_numpy()
            unit = _unit(x)
            for a in range(0, len(queries), 200):
                some = queries.iloc[a : a + 200]
                q = _matrix(some.vec)
                rough = _unit(q) @ unit.T
                for i, query_id in enumerate(some.vec_id):
                    other = np.flatnonzero(ids != query_id)
                    if len(other) > top:
                        r = rough[i, other]
                        least = np.partition(r, len(r) - top)[len(r) - top]
                        other = other[r >= least - 1e-9]  # whatever the exact measure may rank first
                    score = cosine(np.broadcast_to(q[i], (len(other), dim)), x[other])
                    best = np.lexsort((ids[other], -score))[:top]
                    out += [(query_id, ids[other[b]], score[b]) for b in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype(
            {"query_id": "int64", "vec_id": "int64", "score": "float64"}
        )

    found = (
        routed.groupBy("part", "block", "turn")
        .cogroup(rows.groupBy("part", "block", "turn"))
        .applyInPandas(nearest, "query_id long, vec_id long, score double")
    )
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")
