"""Rows that every operator on documents must take: nulls, blanks, long texts, repeats, clashing names."""

from __future__ import annotations

SMALL = "/root/testdata/sf0.001"

WORDS = [f"w{i}" for i in range(400)]
LONG = " ".join(WORDS[i % 397] + str(i // 397) for i in range(60_000))

ROWS = [
    (1, None),
    (2, ""),
    (3, " \t\n \r\n"),
    (4, "one"),
    (5, "one two three four"),
    (6, "ONE two  three\nfour"),
    (7, "é日本 𝒳\x00 ▁x <s> <|endoftext|> don't"),
    (8, "same words again and again\nsame words again and again\n" * 20),
    (9, "same words again and again\nsame words again and again\n" * 20),
    (9, "same words again and again\nsame words again and again\n" * 20),
    (None, "a row without an id"),
    (10, LONG),
    (11, "Licensed under the Apache License, Version 2.0.\nAll rights reserved."),
]
SCHEMA = "doc_id long, text string"


def documents(spark):
    """The rows above with extra columns whose names the operators use themselves."""
    df = spark.createDataFrame(ROWS, SCHEMA)
    for name in ("score", "kept", "_text", "n_words", "component", "sequence_id", "_row", "matches", "DOC_ID", "rep"):
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same_ids(df, column="doc_id"):
    """Whether the result has a row for each of the rows above."""
    key = lambda v: (v is None, v or 0)
    return sorted((r[column] for r in df.select(column).collect()), key=key) == sorted((r[0] for r in ROWS), key=key)
