"""User transformations of a change batch: SQL over ``__src`` or an Arrow-batch function."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.udtf import UserDefinedTableFunction

from changeflow.functions.json import register_json_functions
from changeflow.functions.json_operators import rewrite_json_operators
from changeflow.functions.sql_text import Node, solid, text_of, tree

SOURCE_VIEW = "__src"


def _renamed(nodes: list[Node], names: Mapping[str, str]) -> None:
    """Calls of the functions in ``names`` by their private names."""
    for i, n in enumerate(nodes):
        after, before = solid(nodes, i + 1, 1), solid(nodes, i - 1, -1)
        called = after < len(nodes) and nodes[after].kind == "group" and nodes[after].text == "("
        member = before >= 0 and nodes[before].is_other(".")
        if n.kind == "word" and called and not member and n.text.lower() in names:
            n.text = names[n.text.lower()]
        _renamed(n.inside, names)


def with_private_names(sql: str, names: Mapping[str, str]) -> str:
    """``sql`` with other names for the functions it calls; strings, comments and columns stay."""
    nodes = tree(sql)
    if nodes is None or not names:
        return sql
    _renamed(nodes, {name.lower(): private for name, private in names.items()})
    return text_of(nodes)


def sql_transform(df: DataFrame, sql: str, functions: Mapping[str, Any] | None = None) -> DataFrame:
    """Run a SELECT over the batch, visible as ``__src``; feed and event columns are exposed.

    The JSON functions of ``changeflow.functions.json`` can be called by name, and by the operators
    ``->``, ``->>`` and ``?`` (see ``changeflow.functions.json_operators``). The view behind ``__src``
    has a name of its own for each call, so jobs that share a session do not meet.

    ``functions`` are the user's own, by the names the text calls them: what ``F.udf`` and ``F.pandas_udf``
    return, grouped aggregates among them, and table functions made by ``F.udtf``. They, too, are known under
    private names and to this call only, and go before functions of the session of the same name.
    """
    spark = df.sparkSession
    register_json_functions(spark)
    mark = uuid.uuid4().hex
    view, own = f"{SOURCE_VIEW}_{mark}", {name: f"{name}_{mark}" for name in functions or {}}
    text = rewrite_json_operators(with_private_names(sql, own)).strip().rstrip(";")
    df.createOrReplaceTempView(view)
    try:
        for name, private in own.items():
            fn = functions[name]
            (spark.udtf if isinstance(fn, UserDefinedTableFunction) else spark.udf).register(private, fn)
        return spark.sql(f"WITH {SOURCE_VIEW} AS (SELECT * FROM {view}) SELECT * FROM (\n{text}\n)")
    finally:
        spark.catalog.dropTempView(view)
        for private in own.values():
            spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {private}")


def arrow_transform(
    df: DataFrame,
    fn: Callable[[pa.RecordBatch], pa.RecordBatch],
    schema: T.StructType | str,
) -> DataFrame:
    """Apply ``fn`` to each Arrow batch on the executors; an exception ends the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield fn(batch)

    return df.mapInArrow(run, schema)
