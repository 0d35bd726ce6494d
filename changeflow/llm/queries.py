"""The registered query of each operator, with production parameters, and its SQL where there is one."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from changeflow.session import configure

Query = Callable[[SparkSession, str], DataFrame]

#: Rows in one Arrow batch: a few MB of ordinary documents, and bounded with very long ones.
BATCH_ROWS = 512

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

MODULES = ("text_queries", "search_queries", "corpus_queries", "pipeline_query")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the settings that the operators rely on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return configure(spark)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepared(spark), sf_dir)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def load() -> tuple[dict[str, Query], dict[str, str]]:
    for module in MODULES:
        importlib.import_module(f"changeflow.llm.{module}")
    return QUERIES, ORACLE
