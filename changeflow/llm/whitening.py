"""Whitening of embeddings from a covariance that is exact until its last rounding.

Each entry c becomes the integer x = floor(64 c) + 1000000. One pass counts the n vectors and sums every
dimension. A second pass shifts each dimension by its rounded mean and sums exact squares: of every
dimension, and of the sum of every two dimensions. Both sums are moved to the exact mean in integers. By
polarisation, var(a + b) - var(a) - var(b) = 2 cov(a, b), these variances hold every covariance, which is
rounded once, when the matrix goes to ``eigh``. A third pass measures the covariance of what comes out.

All sums are integers of any size: tasks send digits to the base 2 ** 40, Spark adds them, the driver puts
them together. It receives one row for each pair of dimensions, and never a vector.

Defined results: rows whose vector is null, empty or holds a null, NaN or infinity take no part; nor do those of
another length than most (of the longer ones, if two lengths are equally frequent), as a covariance needs
one length. Entries beyond 2 ** 60 / 64 count as that bound. Repeated rows and rows without an id count
like others. Components of no variance (below 1e-10 of the largest) can't be scaled to one and are left out,
so a table without any variance, and an empty one, gives no rows. Columns other than the two are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64.0, 1_000_000
LARGEST = 2.0**60
#: Rows that are added as 64-bit integers, and the largest entry that may take part in that.
ROWS, SMALL = 4096, 1 << 24
DIGIT = 40
#: Smallest share of the largest eigenvalue that counts as variance.
FLOOR = 1e-10


def _finite(vector: Column) -> Column:
    return vector.isNotNull() & ~F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))


def entries(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """The integers x of a batch, one row a vector."""
    c = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return np.clip(np.floor(SCALE * c), -LARGEST, LARGEST).astype(np.int64) + SHIFT


def digits(values: dict) -> pa.RecordBatch:
    """Integers by (i, j) as rows of base 2 ** 40 digits; a negative one has negative digits."""
    rows = []
    for (i, j), v in values.items():
        sign, v, k = (-1 if v < 0 else 1), abs(v), 0
        while v:
            rows.append((i, j, k, sign * (v & ((1 << DIGIT) - 1))))
            v, k = v >> DIGIT, k + 1
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    types = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["i", "j", "k", "digit"])


def added(df: DataFrame, fn) -> dict:
    """The integers that ``fn`` gives for each task, added up by (i, j): one row a number reaches the driver."""
    parts = df.select("vec").mapInArrow(fn, "i int, j int, k int, digit long")
    out: dict = {}
    for r in parts.groupBy("i", "j", "k").agg(F.sum(F.col("digit").cast("decimal(38,0)")).alias("v")).collect():
        out[r.i, r.j] = out.get((r.i, r.j), 0) + (int(r.v) << (DIGIT * r.k))
    return out


def _sums(dim: int):
    """(-1, 0): rows; (i, 0): the sum of dimension i."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {(i, 0): 0 for i in range(-1, dim)}
        for batch in batches:
            x = entries(batch, dim)
            total[-1, 0] += len(x)
            low = (x & 0xFFFFFFFF).sum(axis=0).tolist()
            high = (x >> 32).sum(axis=0).tolist()
            for i in range(dim):
                total[i, 0] += (high[i] << 32) + low[i]
        yield digits(total)

    return run


def squares(u: np.ndarray, total: dict) -> None:
    """Add the squares of each column to (i, i) and those of each two columns' sum to (i, j)."""
    dim = u.shape[1]
    large = (np.abs(u) > SMALL).any(axis=1)
    parts = [u[~large][a : a + ROWS] for a in range(0, int((~large).sum()), ROWS)] + ([u[large].astype(object)] if large.any() else [])
    for part in parts:
        t = np.ascontiguousarray(part.T)
        for i in range(dim):
            pair = t[i + 1 :] + t[i]
            total[i, i] += int((t[i] * t[i]).sum())
            found = np.einsum("ij,ij->i", pair, pair) if part.dtype != object else (pair * pair).sum(axis=1)
            for j, v in enumerate(found.tolist(), i + 1):
                total[i, j] += int(v)


def _squares(dim: int, centre: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {(i, j): 0 for i in range(dim) for j in range(i, dim)}
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(entries(batch, dim) - centre)
            if sum(map(len, held)) >= ROWS:
                squares(np.concatenate(held), total)
                held = []
        if held:
            squares(np.concatenate(held), total)
        yield digits(total)

    return run


@dataclass(frozen=True)
class Whitening:
    """What was fitted: x = centre + u, where the u of dimension i add up to ``rest[i]``, 0 <= rest < n."""

    n: int
    centre: np.ndarray
    rest: list[int]
    covariance: np.ndarray
    eigenvalues: np.ndarray
    components: np.ndarray  # one a column

    @property
    def explained(self) -> list[float]:
        return (self.eigenvalues / np.trace(self.covariance)).tolist()

    def whitened(self, u: np.ndarray) -> np.ndarray:
        mean = np.array([r / self.n for r in self.rest])
        return (u - mean) @ (self.components / np.sqrt(self.eigenvalues))

    def deviation(self, u: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S) ** 2 for each row, exact."""
        n, rest = self.n, np.array(self.rest, object if self.n >= 1 << 40 else np.int64)
        most = n * (int(np.abs(u).max(initial=0)) + 1)
        if most * most * max(1, u.shape[1]) < 1 << 63:
            y = n * u - rest
            return (y * y).sum(axis=1).tolist()
        y = n * u.astype(object) - rest.astype(object)
        return (y * y).sum(axis=1).tolist()


def covariance(n: int, rest: list[int], square: dict) -> np.ndarray:
    """Covariances, divisor n, from squares around the rounded mean, each rounded once."""
    dim = len(rest)
    # n times the sum of squares around the exact mean, of dimensions and of sums of two.
    own = [n * square[i, i] - rest[i] ** 2 for i in range(dim)]
    v = np.empty((dim, dim))
    for i in range(dim):
        v[i, i] = own[i] / n**2
        for j in range(i + 1, dim):
            both = n * square[i, j] - (rest[i] + rest[j]) ** 2
            v[i, j] = v[j, i] = (both - own[i] - own[j]) / (2 * n**2)
    return v


def vectors_of(df: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """``vec_id`` and ``vec`` (array of double) of the rows that take part, and the length of ``vec``."""
    v = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))
    v = v.where(_finite(F.col("vec")) & (F.size("vec") > 0))
    size = v.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = size.dim if size else 0
    return v.where(F.size("vec") == dim), dim


def fit(v: DataFrame, dim: int, components: int) -> Whitening | None:
    """Fit on all rows of ``vectors_of``; None where nothing varies."""
    sums = added(v, _sums(dim)) if dim else {}
    n = sums.pop((-1, 0), 0)
    if not n:
        return None
    pairs = [divmod(sums.get((i, 0), 0), n) for i in range(dim)]
    centre, rest = np.array([c for c, _ in pairs], np.int64), [r for _, r in pairs]
    found = added(v, _squares(dim, centre))
    square = {(i, j): found.get((i, j), 0) for i in range(dim) for j in range(i, dim)}
    cov = covariance(n, rest, square)
    values, q = np.linalg.eigh(cov)
    values, q = values[::-1], q[:, ::-1]
    keep = min(components, int((values > FLOOR * max(values[0], 0)).sum()))
    return Whitening(n, centre, rest, cov, values[:keep], q[:, :keep]) if keep else None


def identity_error(v: DataFrame, dim: int, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    k = model.components.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = model.whitened(entries(batch, dim) - model.centre)
            first += w.sum(axis=0)
            second += w.T @ w
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate((np.full(k, -1), i)), pa.int32()),
                pa.array(np.concatenate((np.arange(k), j)), pa.int32()),
                pa.array(np.concatenate((first, second[i, j])), pa.float64()),
            ],
            ["i", "j", "v"],
        )

    parts = v.select("vec").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    mean, cov = np.zeros(k), np.zeros((k, k))
    for r in parts.collect():  # one row a pair of components
        if r.i < 0:
            mean[r.j] = r.v / model.n
        else:
            cov[r.i, r.j] = cov[r.j, r.i] = r.v / model.n
    return float(np.abs(cov - np.outer(mean, mean) - np.eye(k)).max())


def whiten(
    df: DataFrame, *, components: int = 32, key: str = "vec_id", vector: str = "embedding"
) -> tuple[DataFrame, Whitening | None]:
    """``vec_id``, ``deviation`` (decimal) and ``whitened`` (array, by falling variance) of each row, and the fit."""
    v, dim = vectors_of(df, key, vector)
    model = fit(v, dim, components)
    schema = "vec_id long, deviation string, whitened array<double>"
    if model is None:
        return df.sparkSession.createDataFrame([], schema.replace("string", "decimal(38,0)")), None
    k = model.components.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = entries(batch, dim) - model.centre
            w = pa.ListArray.from_arrays(np.arange(len(u) + 1, dtype=np.int32) * k, model.whitened(u).ravel())
            exact = pa.array(map(str, model.deviation(u)), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), exact, w], ["vec_id", "deviation", "whitened"])

    return v.mapInArrow(run, schema).withColumn("deviation", F.expr("try_cast(deviation AS decimal(38,0))")), model


def whitened_components(df: DataFrame, *, components: int = 32, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row for each vector and component: the whitened value, with the fit's figures beside it.

    ``deviation`` is null where it needs more than 64 bits; ``whiten`` has it as a decimal.
    """
    rows, model = whiten(df, components=components, key=key, vector=vector)
    if model is None:
        empty = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return df.sparkSession.createDataFrame([], empty)
    v, dim = vectors_of(df, key, vector)
    error = identity_error(v, dim, model)
    each = rows.select("vec_id", F.expr("try_cast(deviation AS bigint)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    explained = F.array(*[F.lit(e) for e in model.explained])
    return each.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        explained[F.col("at")].alias("explained"),
        F.lit(error).alias("identity_error"),
    )
