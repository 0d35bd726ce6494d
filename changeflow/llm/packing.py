"""Best-fit packing of tokenized documents into sequences, certified by lower bounds.

A document is its ids and an end id. Longer ones are cut into pieces of a whole sequence, of which the
first piece may be shorter. Whole pieces are sequences; the others are dealt at random into groups of a
few thousand. Each group is packed by best-fit decreasing, and dual feasible functions bound from below
how many sequences its pieces need. A group that meets its bound keeps all but its emptiest sequence; one
with a gap gives up one more for each sequence above the bound. The pieces given up are exchanged: dealt
anew into fewer groups, which are packed again, until one group is left. So no task holds more than a
group, and the whole needs about one sequence more than the sum of lengths asks for.

Defined results: a null or empty text is the end id alone. Repeated rows, also under the same id, are
packed each. Very long documents only have more pieces. An empty table gives no rows. Only the id and
the text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.llm.byte_bpe import byte_vocabulary
from changeflow.session import work_dir

#: Pieces packed together, and groups whose given-up pieces meet in one.
GROUP, FAN_IN = 4096, 16

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECE + ", sequence_id long, offset long, loose boolean"


def lower_bound(count: np.ndarray, capacity: int) -> int:
    """Sequences that so many pieces of each length 0 .. capacity need at least, by dual feasible functions."""
    size = np.arange(capacity + 1, dtype=np.int64)
    total = int(count @ size)
    best = -(-total // capacity)
    # Pieces above capacity - t fill a sequence, those below t vanish, the rest stay.
    number = np.concatenate((np.cumsum(count[::-1])[::-1], [0]))
    amount = np.concatenate((np.cumsum((count * size)[::-1])[::-1], [0]))
    t = np.arange(1, capacity // 2 + 1)
    full = number[capacity - t + 1]
    kept = amount[t] - amount[capacity - t + 1]
    best = max(best, int((full + -(-kept // capacity)).max()))
    # Sizes rounded down to k-ths, multiples of 1 / (k + 1) left alone.
    for k in range(1, 33):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, -(-int(count @ value) // (capacity * k)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, and the fill of each sequence; longest pieces first."""
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_spaces = 0  # bit s: some sequence has s tokens left
    n = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        fits = open_spaces >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                open_spaces &= ~(1 << space)
        else:
            b, space, n = n, capacity, n + 1
        bins[i], offsets[i] = b, capacity - space
        left = space - length
        if left:
            by_space[left].append(b)
            open_spaces |= 1 << left
    return bins, offsets, np.bincount(bins, lengths, n).astype(np.int64)


def pack_group(rows: pd.DataFrame, capacity: int, first_id: int, last: bool) -> pd.DataFrame:
    """Place the pieces of one group and mark those it gives up."""
    # Sorted, so that a repeated task packs alike whatever order its rows come in.
    rows = rows.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=False, kind="stable")
    lengths = rows.length.to_numpy(np.int64)
    bins, offsets, fill = best_fit(lengths, capacity)
    gap = len(fill) - lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
    loose = np.zeros(len(fill), bool)
    if not last:
        loose[np.argsort(fill, kind="stable")[: gap + 1]] = True
    return rows.assign(sequence_id=first_id + bins, offset=offsets, loose=loose[bins])


def cut(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """The pieces of every document: id, number, start, length, and the CRC-32 of the piece's ids."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = byte_vocabulary(path)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.doc_id, batch.text, strict=True):
                ids = np.append(vocabulary.ids(text or ""), end_id).astype("<u4")
                ends = range(len(ids) % capacity or capacity, len(ids) + 1, capacity)
                start = 0
                for k, end in enumerate(ends):
                    out.append((doc_id, k, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                    start = end
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield frame.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(pieces, PIECE)


def _deal(pieces: DataFrame, groups: int, turn: int, capacity: int) -> DataFrame:
    """Pack ``pieces``, dealt by a hash of ``_row``, in so many groups."""
    last = groups == 1
    key = F.pmod(F.xxhash64("_row"), F.lit(groups)).cast("int")

    def place(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        placed = pack_group(rows.drop(columns="_group"), capacity, (turn << 56) | (int(group[0]) << 24), last)
        return placed.astype({"doc_id": "Int64"})

    dealt = pieces.withColumn("_group", key).drop("_row")
    return dealt.groupBy("_group").applyInPandas(place, PLACED)


def pack(docs: DataFrame, path: str, *, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row a piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``."""
    spark: SparkSession = docs.sparkSession
    base = work_dir(spark, "packing")
    cut(docs, path, capacity, end_id).write.parquet(f"{base}/pieces")
    # Numbers rows of a stored table, so that a repeated task numbers them alike.
    pieces = spark.read.parquet(f"{base}/pieces").withColumn("_row", F.monotonically_increasing_id())
    whole = (
        pieces.where(F.col("length") == capacity)
        .withColumn("sequence_id", -1 - F.col("_row"))
        .withColumn("offset", F.lit(0).cast("long"))
        .drop("_row")
    )
    parts, rest, turn = [whole], pieces.where(F.col("length") < capacity), 0
    groups = max(1, -(-rest.count() // GROUP))
    while True:
        _deal(rest, groups, turn, capacity).write.parquet(f"{base}/turn-{turn}")
        placed = spark.read.parquet(f"{base}/turn-{turn}")
        parts.append(placed.where(~F.col("loose")).drop("loose"))
        if groups == 1:
            break
        rest = placed.where("loose").withColumn("_row", F.hash("sequence_id", "offset")).drop("loose", "sequence_id", "offset")
        groups, turn = -(-groups // FAN_IN), turn + 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def report(packed: DataFrame, capacity: int = 1024) -> DataFrame:
    """One row: sequences used, and how many the pieces' lengths need at least."""
    used = packed.agg(F.countDistinct("sequence_id").alias("sequences")).first().sequences
    counts = packed.groupBy("length").count().collect()  # at most ``capacity`` rows
    tally = np.zeros(capacity + 1, np.int64)
    for r in counts:
        tally[r["length"]] = r["count"]
    return packed.sparkSession.createDataFrame([(used, lower_bound(tally, capacity))], "sequences long, bound long")
