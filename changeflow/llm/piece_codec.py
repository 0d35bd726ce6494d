"""Encoding and decoding of whole texts with a merge-type SentencePiece vocabulary.

The operator merges by itself (see ``piece_bpe``) and checks every Arrow batch against the sentencepiece
library: the ids of each whole text, and what they decode to where that isn't the text itself, with spaces
for U+2581. Should they ever differ the batch fails with ``ValueError``, so whatever is returned is both the
operator's own and the library's result; ``agrees`` is true in every row.

Defined results: a null or empty text has only the begin and the end id and decodes to an empty text.
Repeated rows are encoded each, very long texts whole. Only the id and the text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.llm.piece_bpe import SPACE, encoder, library
from changeflow.llm.textbytes import slices

#: Characters encoded together, so that a batch of very long texts stays small.
TOGETHER = 500_000


def _both(path: str, texts: list[str]) -> Iterator[tuple[np.ndarray, str, bool]]:
    own, lib = encoder(path), library(path)
    ids = own.encode_batch(texts)
    theirs = lib.encode(texts, add_bos=True, add_eos=True, num_threads=1)
    for source, mine, other in zip(texts, ids, theirs, strict=True):
        text, other = own.decode(mine), np.array(other, "<u4")
        if not np.array_equal(mine, other):
            raise ValueError(f"other ids than the library's for a text of {len(source)} characters: {source[:80]!r}")
        if text != source.replace(SPACE, " ") and text != lib.decode(mine.tolist()):
            raise ValueError(f"decoded to another text than the library's: {text[:80]!r}")
        yield mine, text, True


def encoded(text: Column, path: str) -> Column:
    """A struct of the ids and the text they decode to."""

    @F.pandas_udf("ids array<int>, decoded string, agrees boolean")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            whole = [t or "" for t in texts]
            rows = [r for part in slices(whole, TOGETHER) for r in _both(path, part)]
            yield pd.DataFrame(
                {
                    "ids": pd.Series([r[0].astype(np.int32) for r in rows], dtype=object),
                    "decoded": pd.Series([r[1] for r in rows], dtype=object),
                    "agrees": pd.Series([r[2] for r in rows], dtype=bool),
                }
            )

    return encode(text)


def digests(text: Column, path: str) -> Column:
    """A struct of the number of ids and the digests of ids and decoded text."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            whole = [t or "" for t in texts]
            rows = [
                (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(out.encode()).hexdigest(), ok)
                for part in slices(whole, TOGETHER)
                for ids, out, ok in _both(path, part)
            ]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "agrees"])

    return digest(text)


def sentencepiece_codec(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``ids``, ``decoded`` and ``agrees`` of each document."""
    return docs.select("doc_id", encoded(F.col("text"), path).alias("e")).select("doc_id", "e.*")


def sentencepiece_digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and ``agrees`` of each document."""
    return docs.select("doc_id", digests(F.col("text"), path).alias("e")).select("doc_id", "e.*")
