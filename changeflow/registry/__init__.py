"""All queries this package can run by name."""

import importlib

MODULES = (
    "feed_queries",
    "merge_queries",
    "plan_queries",
    "event_queries",
    "table_queries",
    "stream_queries",
)


def load():
    """Import every query module; returns ``(queries, oracle SQL)``."""
    from changeflow.registry import base

    for module in MODULES:
        importlib.import_module(f"changeflow.registry.{module}")
    return base.QUERIES, base.ORACLE
