"""The corpus pipeline as a query."""

from __future__ import annotations

import corpus_pipeline
from changeflow.llm.queries import query


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    """Quality rules, toxicity, near-dedup and packing, one after the other."""
    return corpus_pipeline.run(spark, sf_dir)
