"""Importance resampling: draw the documents that look most like a target collection.

Features are a text's words (A-Z lower-cased, runs of digits, a-z and bytes above 0x7F) and pairs of
neighbouring words, joined by a space. A feature's bucket is its CRC-32 modulo the number of buckets. How
often the buckets occur in the target and in all documents gives each bucket a gain; a document's weight is
the mean gain of its features, and a fixed pseudo-random Gumbel number of its id turns the weights into a
draw without replacement.

Most features are the same few, so a vocabulary of the head goes to all tasks: of at most ``WORDS`` frequent
words the CRC state after the word and after the space behind it, of at most ``PAIRS`` frequent pairs the
bucket. A feature of the head is looked up; any other takes its CRC directly, a pair by going on from the
state of its first word. So which features are in the head decides the cost and never a result. Words are
counted exactly. Pairs of head words are counted in pieces of ``PIECE`` pairs, and a piece reports those that
it holds twice at least and as one in ``SHARE`` of its pairs: a pair that frequent in the whole corpus is so in
some piece.

What reaches the driver: the head (at most ``WORDS`` words of at most ``LONGEST`` bytes and ``PAIRS`` codes;
where many are equally frequent, fewer), one row a bucket, one row a partition of the ranked table.

Defined results: a null or empty text, or one without words, has no features and weight 0. Rows that repeat
an id are scored each. A row without an id counts in the bucket totals, but has no score and is not drawn.
Very long texts are taken whole, in units of bounded size. An empty table gives no rows; without target
texts all gains follow from the same formula. Only the id and the text are read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.llm.components import stored
from changeflow.session import work_dir

#: Bounds of the head, and the bytes of the longest word in it: 2 MB of words, 3 MB of pairs.
WORDS, PAIRS, LONGEST = 32_768, 262_144, 64
#: Pairs counted together, and one in how many of them a pair must be to be reported.
PIECE, SHARE = 4_000_000, 262_144
#: Distinct words a task holds before it reports them.
HELD = 500_000
#: Bytes of text split at once, and words looked up at once.
UNIT, TOGETHER = 1_000_000, 300_000

# Every byte that belongs to no word becomes a space, A-Z become a-z.
SPLIT = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def units(texts) -> Iterator[tuple[int, list[bytes], bytes | None]]:
    """Number of the text, some of its words in order, and the word before them in the same text."""
    for number, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass").translate(SPLIT)
        begin, before = 0, None
        while begin < len(data):
            end = data.find(b" ", begin + UNIT)
            end = len(data) if end < 0 else end
            words = data[begin:end].split()
            if words:
                yield number, words, before
                before = words[-1]
            begin = end


def gathered(texts) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray]]:
    """``units`` together: the text of each word, the words, and which of them are there only as a first of a pair."""
    numbers, words, lead = [], [], []
    for number, some, before in units(texts):
        if before is not None:
            lead.append(len(words))
            some = [before, *some]
        numbers.append((number, len(some)))
        words += some
        if len(words) >= TOGETHER:
            yield _unit(numbers, words, lead)
            numbers, words, lead = [], [], []
    if words:
        yield _unit(numbers, words, lead)


def _unit(numbers, words, lead):
    carried = np.zeros(len(words), bool)
    carried[lead] = True
    number, length = np.array(numbers, np.int64).T
    return np.repeat(number, length), words, carried


def neighbours(numbers: np.ndarray, carried: np.ndarray) -> np.ndarray:
    """Whether each word but the first forms a pair with the one before it."""
    return (numbers[1:] == numbers[:-1]) & ~carried[1:]


class Head:
    """Frequent words with their CRC states and frequent pairs with their buckets."""

    def __init__(self, words: list[bytes], pairs: np.ndarray, buckets: int):
        self.buckets = buckets
        self.words = words
        self.ids = {w: i for i, w in enumerate(words)}
        self.crc = np.array([zlib.crc32(w) for w in words], np.int64)
        self.after = [zlib.crc32(b" ", int(c)) for c in self.crc]
        self.pairs = np.sort(pairs.astype(np.int64))
        first, second = divmod(self.pairs, max(1, len(words)))
        self.pair_bucket = self._pairs(first, second, self.words, self.after)

    def _pairs(self, first: np.ndarray, second: np.ndarray, words: list[bytes], after: list[int]) -> np.ndarray:
        crc = map(zlib.crc32, map(words.__getitem__, second.tolist()), map(after.__getitem__, first.tolist()))
        return np.fromiter(crc, np.int64, len(first)) % self.buckets

    def codes(self, ids: np.ndarray, numbers: np.ndarray, carried: np.ndarray) -> np.ndarray:
        """The pairs of head words among neighbours of one text."""
        near = neighbours(numbers, carried) & (ids[1:] >= 0) & (ids[:-1] >= 0)
        return ids[:-1][near] * len(self.words) + ids[1:][near]

    def known(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))

    def features(self, texts) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For some words at a time: texts and buckets of their features, and the texts of the words alone."""
        for numbers, words, carried in gathered(texts):
            ids = self.known(words)
            tail = np.flatnonzero(ids < 0)
            new: dict[bytes, int] = {}
            ids[tail] = [new.setdefault(words[i], len(self.words) + len(new)) for i in tail.tolist()]
            names = self.words + list(new)
            crc = np.concatenate((self.crc, np.fromiter(map(zlib.crc32, new), np.int64, len(new))))
            after = self.after + [zlib.crc32(b" ", int(c)) for c in crc[len(self.words) :]]
            near = neighbours(numbers, carried)
            codes, where = np.unique(ids[:-1][near] * len(names) + ids[1:][near], return_inverse=True)
            first, second = divmod(codes, len(names))
            bucket = np.full(len(codes), -1, np.int64)
            if len(self.pairs):
                of_head = np.flatnonzero((first < len(self.words)) & (second < len(self.words)))
                code = first[of_head] * len(self.words) + second[of_head]
                at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
                hit = self.pairs[at] == code
                bucket[of_head[hit]] = self.pair_bucket[at[hit]]
            rest = np.flatnonzero(bucket < 0)
            bucket[rest] = self._pairs(first[rest], second[rest], names, after)
            own = ~carried
            yield (
                np.concatenate((numbers[own], numbers[1:][near])),
                np.concatenate((crc[ids[own]] % self.buckets, bucket[where])),
                numbers[own],
            )


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter = Counter()

    def report() -> pd.DataFrame:
        rows = [(w, n) for w, n in counts.items() if len(w) <= LONGEST]
        counts.clear()
        return pd.DataFrame(rows, columns=["word", "n"])

    for batch in batches:
        for _, words, _ in units(batch.text):
            counts.update(words)
            if len(counts) > HELD:
                yield report()
    yield report()


def _pair_counter(head):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []

        def report() -> pd.DataFrame:
            codes, n = np.unique(np.concatenate(held), return_counts=True)
            often = (n > 1) & (n * SHARE >= n.sum())
            held.clear()
            return pd.DataFrame({"code": codes[often], "n": n[often]})

        for batch in batches:
            for numbers, words, carried in gathered(batch.text):
                held.append(head.value.codes(head.value.known(words), numbers, carried))
                if sum(map(len, held)) >= PIECE:
                    yield report()
        if held:
            yield report()

    return count


def _most(counted: DataFrame, most: int, folder: str) -> DataFrame:
    """The rows of the largest ``n``, at most ``most``: all those from a power of 2 ** 0.125 on.

    A histogram of ``n`` finds the power, so the driver gets no more rows than the head has, however many
    partitions the counts have.
    """
    counted = stored(counted.withColumn("step", F.floor(F.log2("n") * 8).cast("int")), folder)
    steps = counted.groupBy("step").agg(F.count("*").alias("rows")).orderBy(F.desc("step")).collect()  # a few hundred
    least, total = None, 0
    for s in steps:
        total += s["rows"]
        if total > most:
            break
        least = s["step"]
    return counted.where(F.lit(False) if least is None else F.col("step") >= least).drop("step")


def learn_head(texts: DataFrame, buckets: int, folder: str) -> Head:
    """The head of a table's words and pairs, by two passes over its column ``text``; counts are stored in ``folder``."""
    spark = texts.sparkSession
    words = texts.select("text").mapInPandas(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = _most(words, WORDS, f"{folder}/words").collect()
    top = [bytes(r.word) for r in sorted(found, key=lambda r: (-r.n, bytes(r.word)))]
    shared = spark.sparkContext.broadcast(Head(top, np.empty(0, np.int64), buckets))
    pairs = texts.select("text").mapInPandas(_pair_counter(shared), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    codes = [r.code for r in _most(pairs, PAIRS, f"{folder}/pairs").collect()]
    return Head(top, np.array(codes, np.int64), buckets)


def bucket_totals(texts: DataFrame, head) -> np.ndarray:
    """How many features of all texts fall into each bucket; ``head`` is a broadcast ``Head``."""

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h = head.value
        sums = np.zeros(h.buckets, np.int64)
        for batch in batches:
            for _, bucket, _ in h.features(batch.text):
                sums += np.bincount(bucket, minlength=h.buckets)
        used = np.flatnonzero(sums)
        yield pd.DataFrame({"bucket": used, "n": sums[used]})

    rows = texts.select("text").mapInPandas(total, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(head.value.buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousand times the log ratio of smoothed shares, rounded down, of each bucket."""
    k = len(source)
    s_all, t_all = float(source.sum() + k), float(target.sum() + k)
    return np.array(
        [math.floor(1000 * math.log(((t + 1) * s_all) / ((s + 1) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)],
        np.int64,
    )


def weights(docs: DataFrame, head, gain: np.ndarray) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features`` and ``weight``, the floored mean gain, of each document."""

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = len(batch)
            n, total, n_words = np.zeros((3, rows), np.int64)
            for number, bucket, words in head.value.features(batch.text):
                n += np.bincount(number, minlength=rows)
                n_words += np.bincount(words, minlength=rows)
                total += np.bincount(number, gain[bucket], rows).astype(np.int64)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            ids = batch.doc_id.astype("Int64")
            yield pd.DataFrame({"doc_id": ids, "n_words": n_words, "n_features": n, "weight": weight})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(weigh, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """Thousand times a Gumbel number, rounded down, from a digest of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, folder: str, percent: int, min_words: int) -> DataFrame:
    """``scored`` with ``rank`` for the drawn documents: the order of a range-partitioned, stored table."""
    spark = scored.sparkSession
    may = F.coalesce((F.col("n_words") >= min_words) & F.col("doc_id").isNotNull(), F.lit(False))
    order = [F.desc("_may"), F.desc("score"), F.asc("doc_id")]
    placed = scored.withColumn("_may", may).repartitionByRange(*order).sortWithinPartitions(*order)
    placed.withColumn("_at", F.monotonically_increasing_id()).write.parquet(f"{folder}/ranked")
    rows = spark.read.parquet(f"{folder}/ranked")
    part = F.shiftright("_at", 33)
    counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if("_may").alias("may")).orderBy("part").collect()
    before, known = 0, []
    for r in counts:  # one row a partition
        known.append((r.part, before))
        before += r.n
    drawn = percent * sum(r.may for r in counts) // 100
    offsets = spark.createDataFrame(known, "part long, before long")
    rank = F.col("before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    joined = rows.withColumn("part", part).join(F.broadcast(offsets), "part")
    return joined.withColumn("rank", F.when(F.col("_may") & (rank <= drawn), rank)).drop("part", "before", "_at", "_may")


def resample(
    docs: DataFrame, target: DataFrame, *, percent: int = 25, min_words: int = 20, buckets: int = 10_000, seed: int = 7
) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` of each document.

    ``target`` has a column ``text``. Of the documents with ``min_words`` words at least, ``percent`` in a
    hundred are drawn: those of the highest scores, ties to the smaller id. The others' rank is null.
    """
    spark: SparkSession = docs.sparkSession
    folder = work_dir(spark, "importance")
    head = spark.sparkContext.broadcast(learn_head(docs, buckets, folder))
    gain = gains(bucket_totals(docs, head), bucket_totals(target, head))
    scored = weights(docs, head, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    return ranked(stored(scored, f"{folder}/scored"), folder, percent, min_words)
