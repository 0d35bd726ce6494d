"""Bounded samples of labelled documents to learn from, and the rows held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def sample(
    docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int, max_bytes: int
) -> tuple[list[str], list[int], float]:
    """Texts and labels to learn from, at most ``per_class`` a class, and the share of label 1.

    ``learn`` is a condition on ``doc_id``. The rows are those whose hashed id comes first, of a text with
    at most ``max_bytes`` bytes: the same at every run, and at most ``2 * per_class * max_bytes`` bytes on
    the driver. The share is counted over all labelled rows that may be learned from. A document
    labelled twice counts with its smaller label; null labels and ids are left out.
    """
    known = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & learn)
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"))
    )
    n, ones = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    order = F.xxhash64("doc_id")
    fits = docs.select("doc_id", F.octet_length("text").alias("_n")).where(F.col("_n") <= max_bytes)
    usable = known.join(fits.select("doc_id"), "doc_id", "left_semi")
    parts = [usable.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    rows = (
        docs.select("doc_id", "text")
        .where(F.octet_length("text") <= max_bytes)
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"), F.min("y").alias("y"))
        .collect()
    )
    rows.sort(key=lambda r: (r.doc_id, r.text))
    return [r.text for r in rows], [r.y for r in rows], (ones / n if n else 0.5)
