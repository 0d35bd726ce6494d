"""Token counts of whole texts with a shortcut for whole tokens.

Offline, once for a vocabulary: which of its strings, as a pre-token, encode as exactly one token is
proved by merging each of them. While counting, a pre-token among those counts 1 without any work; only
the others are merged, each distinct one once for a batch and for as long as a worker remembers it.

Defined results: a null or empty text has 0 bytes and 0 tokens. Repeated rows are counted each. Very
long texts and pre-tokens are counted whole. Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.llm.piece_bpe import MEMORY, MEMORY_CHARS, vocabulary
from changeflow.llm.textbytes import slices


def whole_tokens(path: str) -> list[str]:
    """The vocabulary's strings proved to encode alone as one token: at most its size."""
    return vocabulary(path).whole_tokens()


class TokenCounter:
    """Counts tokens; one for each worker."""

    def __init__(self, path: str, whole: list[str]):
        self.vocabulary = vocabulary(path)
        self.whole = dict.fromkeys(whole, 1)
        self.counts = dict(self.whole)

    def count(self, texts: list[str]) -> list[int]:
        v = self.vocabulary
        cut = [v.pre_tokens(v.prepare(t)) for t in texts]
        if len(self.counts) > MEMORY:
            self.counts = dict(self.whole)
        rest = list(set().union(*cut).difference(self.counts))
        self.counts.update(zip(rest, (len(ids) // 4 for ids in v.merge_all(rest)), strict=True))
        out = [sum(map(self.counts.__getitem__, c)) for c in cut]
        for p in rest:
            if len(p) > MEMORY_CHARS:
                del self.counts[p]
        return out


@lru_cache(maxsize=1)
def _counter(path: str, whole: tuple[str, ...]) -> TokenCounter:
    return TokenCounter(path, list(whole))


def n_tokens(text: Column, path: str, whole: list[str]) -> Column:
    """Tokens of each text, without begin and end."""
    known = tuple(whole)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(path, known)
        for texts in batches:
            parts = slices([t or "" for t in texts])
            yield pd.Series([n for part in parts for n in counter.count(part)], dtype="int64")

    return count(text)


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of each document."""
    counted = docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        n_tokens(F.col("text"), path, whole_tokens(path)).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
