"""Quality rules by repetition coverage.

For every whole text: rolling hashes of several n-gram lengths over its words, and the share of the
word characters that lie inside n-grams met earlier in the same text, or on lines equal to an earlier
line (first occurrences are not counted, so a text that quotes one of its lines once stays). A text is rejected if one of those shares is above its threshold, or if the base
rules fail (fewer than 50 words, or more than half of its words inside repeated 3-word windows).

Defined results: a null or empty text, or one of white space only, has no words and all counts 0,
so its base rules fail. Rows are judged one by one: repeated rows get the same verdict each, and no
other column is looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.llm import textbytes as tb

#: Largest share, in hundredths, of word characters inside n-grams of so many words met before.
NGRAM_LIMITS = {5: 20, 6: 19, 7: 18, 8: 17, 9: 16, 10: 15}
#: Largest share, in hundredths, of word characters on lines equal to an earlier line.
LINE_LIMIT = 20
MIN_WORDS = 50
REPEAT_LIMIT = 50

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars")
NGRAM_FIELDS = tuple(f"dup_{n}gram_chars" for n in NGRAM_LIMITS)
SCHEMA = ", ".join(f"{f} long" for f in FIELDS + NGRAM_FIELDS) + ", base_failed boolean, kept boolean"


def measure(texts) -> pd.DataFrame:
    """The counts and verdicts of a batch of texts."""
    b = tb.Batch(texts)
    n_texts = len(b)
    word = ~tb.SPACE[b.data]
    begin, end = b.runs(word)
    text = b.text_of(begin)
    lead = ~tb.CONTINUES[b.data]
    chars_before = np.concatenate(([0], np.cumsum(word & lead)))
    chars = chars_before[end] - chars_before[begin]
    h = b.hashes(b.data, begin, end)
    out = {
        "n_words": np.bincount(text, minlength=n_texts),
        "word_chars": np.bincount(text, chars, n_texts),
        "n_symbols": b.per_text(SYMBOL[b.data]),
    }

    # Lines: runs without \n; those with a word count. The newline behind a text ends its last line.
    line_begin, line_end = b.runs(b.data != 10)
    line_chars = chars_before[line_end] - chars_before[line_begin]
    has = line_chars > 0
    line_begin, line_end, line_chars = line_begin[has], line_end[has], line_chars[has]
    line_text = b.text_of(line_begin)
    key = tb.mix(b.hashes(b.data, line_begin, line_end) + line_text.astype(np.uint64))
    again = tb.repeats_earlier(key)
    out["n_dup_lines"] = np.bincount(line_text[again], minlength=n_texts)
    out["dup_line_chars"] = np.bincount(line_text[again], line_chars[again], n_texts)

    salt = tb.mix(text.astype(np.uint64) + np.uint64(1))
    window = h
    for n in range(2, max(NGRAM_LIMITS) + 1):
        if len(h) < n:
            window = h[:0]
        else:
            window = window[:-1] * tb.WINDOW + h[n - 1 :]
        if n != 3 and n not in NGRAM_LIMITS:
            continue
        starts = np.flatnonzero(text[: len(window)] == text[n - 1 :]) if len(window) else np.empty(0, np.int64)
        key = tb.mix(window[starts]) ^ salt[starts]
        if n == 3:
            inside = tb.covered(len(h), starts[tb.repeated(key)], n)
            out["n_repeat_words"] = np.bincount(text[inside], minlength=n_texts)
        else:
            inside = tb.covered(len(h), starts[tb.repeats_earlier(key)], n)
            out[f"dup_{n}gram_chars"] = np.bincount(text[inside], chars[inside], n_texts)

    out = pd.DataFrame({k: out[k].astype(np.int64) for k in FIELDS + NGRAM_FIELDS})
    out["base_failed"] = (out.n_words < MIN_WORDS) | (100 * out.n_repeat_words > REPEAT_LIMIT * out.n_words)
    bad = out.base_failed | (100 * out.dup_line_chars > LINE_LIMIT * out.word_chars)
    for n, limit in NGRAM_LIMITS.items():
        bad |= 100 * out[f"dup_{n}gram_chars"] > limit * out.word_chars
    out["kept"] = ~bad
    return out


def repetition(text: Column) -> Column:
    """A struct of the counts and verdicts of each text."""

    @F.pandas_udf(SCHEMA)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            parts = [measure(part) for part in tb.slices(texts.tolist())] or [measure([])]
            yield pd.concat(parts, ignore_index=True)

    return judge(text)


def repetition_rules(docs: DataFrame) -> DataFrame:
    """One row a document: ``doc_id``, the counts, ``base_failed`` and ``kept``."""
    judged = docs.select("doc_id", repetition(F.col("text")).alias("r"))
    return judged.select("doc_id", "r.*")


def keep_unrepetitive(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text passes, with all their columns."""
    return docs.where(repetition(docs["text"])["kept"])
