"""Metrics of past runs: totals, rates, recent and rolling values.

A run log has one row per applied batch: ``job``, ``seq`` (batch number, unique in its job) and
measures such as ``duration_ms`` and row counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeflow.plans.scan import Scan, before_blocks, span

#: Batch numbers in a block of a job's runs.
BLOCK = 16_384
COUNTERS = ("inserts", "updates", "deletes", "appended")


def run_totals(runs: DataFrame) -> DataFrame:
    """Batches and row counters, added up per job."""
    return runs.groupBy("job").agg(
        F.count(F.lit(1)).alias("batches"), *[F.sum(c).alias(c) for c in COUNTERS]
    )


def rows_per_sec(runs: DataFrame) -> DataFrame:
    """Rows per second of each job, over at least a millisecond."""
    return runs.groupBy("job").agg(
        (F.sum("rows") / F.greatest(F.sum("duration_ms") / F.lit(1000.0), F.lit(0.001))).alias(
            "rows_per_sec"
        )
    )


def rolling_means(runs: DataFrame, **means: tuple[str, int]) -> DataFrame:
    """Per name, the mean of a measure's newest values up to each run, rounded down.

    ``means`` maps a name to ``(measure, how many)``. Each job is cut into blocks of ``BLOCK`` batch numbers.
    A block hands its last measures on, as many as the longest mean looks back, and is entered with those
    that lie before it, whether one block holds them or many. So no task needs a whole job, and besides the
    runs only these tails are spread out.
    """
    back = max(n for _, n in means.values()) - 1
    measures = sorted({measure for measure, _ in means.values()})
    row = F.struct(F.col("seq").cast("bigint").alias("seq"), *[F.col(m).alias(m) for m in measures])
    own = F.floor(F.col("seq") / BLOCK).cast("bigint")
    placed = runs.withColumn("__n", own).withColumn("__own", F.lit(True))
    first, numbers = span(placed.select("__n"), "__n")
    if back and numbers > 1:
        tails = placed.groupBy(F.struct("job").alias("g"), F.col("__n").alias("n"))
        tails = tails.agg(_newest(F.array_sort(F.collect_list(row)), back).alias("v"))
        kind = tails.schema["v"].dataType.simpleString()
        newest = "slice({0}, greatest(size({0}) - %d, 0) + 1, %d)" % (back, back)
        later = "concat({}, b)"
        scan = Scan(newest.format(later.format("a")), newest.format(later.format("s")), kind)
        entered = before_blocks(tails, scan, f"cast(array() AS {kind})", first, numbers)
        context = entered.select("g.job", F.col("n").alias("__n"), F.explode("before").alias("r"))
        seq = F.col("r.seq").cast(runs.schema["seq"].dataType).alias("seq")
        context = context.select("job", "__n", seq, *[F.col("r")[m].alias(m) for m in measures], F.lit(False).alias("__own"))
        placed = placed.unionByName(context, allowMissingColumns=True)
    newest_runs = Window.partitionBy("job", "__n").orderBy("seq")
    for name, (measure, n) in means.items():
        w = newest_runs.rowsBetween(1 - n, 0)
        placed = placed.withColumn(name, F.floor(F.sum(measure).over(w) / F.count(measure).over(w)).cast("bigint"))
    return placed.where("__own").drop("__n", "__own")


def _newest(rows: Column, n: int) -> Column:
    return F.slice(rows, F.greatest(F.size(rows) - n, F.lit(0)) + 1, n)


def recent_runs(runs: DataFrame, newest: int = 50) -> DataFrame:
    """The newest runs of each job; Spark cuts each job down before the shuffle."""
    w = Window.partitionBy("job").orderBy(F.col("seq").desc())
    return runs.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= newest).drop("__rank")
