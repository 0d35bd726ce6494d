"""Quality classifier: a byte-level convolutional network in numpy.

Every byte has a learned vector; learned filters look at 8 bytes at every second byte of the whole text;
their rectified answers are averaged within overlapping chunks of 256 bytes; a learned layer reads each
chunk; its units are max-pooled over all chunks and combined into one probability. The gradient of a
maximum flows through the chunk that attains it, so learning recomputes only those chunks.

Defined results: a null or empty text is one chunk without bytes and gets the score that the network
gives to it. Without any labelled row to learn from, or with one class only, all scores are the share of
label 1 (0.5 without labels). Repeated rows are scored each; very long texts whole, a block of chunks at a
time. Inputs of a score are the bytes of the text and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.llm.labelled import remainder, sample
from changeflow.llm.textbytes import slices

WIDTH, STEP = 8, 2
HALF = 128  # bytes; a chunk is two halves, the next begins one half later
PLACES = HALF // STEP
DIM, FILTERS, UNITS = 6, 24, 16
PAD = 256
#: Halves of a chunk that go through the filters together: about 20 MB.
BLOCK = 1024

#: Learning: documents a class, bytes of the longest, steps, documents a step.
PER_CLASS, MAX_BYTES, STEPS, TOGETHER = 1000, 8_000, 500, 32


@dataclass
class Network:
    embed: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    v: np.ndarray
    c: np.ndarray
    shift: float = 0.0

    @staticmethod
    def fresh(seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)

        def normal(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        embed = (rng.standard_normal((PAD + 1, DIM)) * 0.5).astype(np.float32)
        embed[PAD] = 0
        zero = np.zeros
        return Network(
            embed,
            normal(WIDTH * DIM, FILTERS),
            zero(FILTERS, np.float32),
            normal(FILTERS, UNITS) * 2,
            zero(UNITS, np.float32),
            normal(UNITS),
            zero(1, np.float32),
        )

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.w1, self.b1, self.w2, self.b2, self.v, self.c]


class Layout:
    """Bytes of a batch, each text filled up to whole halves with pads, so that no window of one text reaches the next."""

    def __init__(self, texts):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        n = np.array([len(r) for r in raw], np.int64)
        halves = np.maximum(2, -(-(n + WIDTH) // HALF))
        self.first = np.cumsum(halves) - halves
        self.n_halves = int(halves.sum())
        self.codes = np.full(self.n_halves * HALF + WIDTH, PAD, np.int16)
        for r, at in zip(raw, (self.first * HALF).tolist(), strict=True):
            self.codes[at : at + len(r)] = np.frombuffer(r, np.uint8)
        half = np.arange(self.n_halves)
        text = np.repeat(np.arange(len(raw)), halves)
        left = n[text] - (half - self.first[text]) * HALF
        self.places = np.clip(-(-left // STEP), 0, PLACES)  # windows that begin inside the text
        # Chunk i is half i and the next; the last half of a text begins none.
        self.chunks = np.flatnonzero(np.append(text[1:] == text[:-1], False))
        self.chunk_text = text[self.chunks]
        self.first_chunk = np.searchsorted(self.chunk_text, np.arange(len(raw)))
        self.counts = np.maximum(1, self.places[self.chunks] + self.places[self.chunks + 1]).astype(np.float32)

    def windows(self, halves: np.ndarray) -> np.ndarray:
        """Codes of all windows of some halves."""
        at = (halves[:, None] * HALF + np.arange(0, HALF, STEP)).ravel()
        return self.codes[at[:, None] + np.arange(WIDTH)]

    def features(self, net: Network) -> np.ndarray:
        """Mean rectified answer of each filter in each chunk."""
        sums = np.empty((self.n_halves, FILTERS), np.float32)
        for k in range(0, self.n_halves, BLOCK):
            m = min(BLOCK, self.n_halves - k)
            bytes_ = net.embed[self.codes[k * HALF : (k + m) * HALF + WIDTH - STEP]]
            view = np.lib.stride_tricks.as_strided(
                bytes_, (m * PLACES, WIDTH * DIM), (STEP * DIM * 4, 4), writeable=False
            )
            answers = np.ascontiguousarray(view) @ net.w1
            answers += net.b1
            np.maximum(answers, 0, out=answers)
            answers = answers.reshape(m, PLACES, FILTERS)
            places = self.places[k : k + m]
            part = np.flatnonzero(places < PLACES)  # windows behind the text are no part of it
            answers[part] *= (np.arange(PLACES) < places[part][:, None])[:, :, None]
            sums[k : k + m] = answers.sum(axis=1)
        return (sums[self.chunks] + sums[self.chunks + 1]) / self.counts[:, None]


def _logits(net: Network, lay: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    features = lay.features(net)
    units = np.maximum(features @ net.w2 + net.b2, 0)
    pooled = np.maximum.reduceat(units, lay.first_chunk, axis=0)
    return pooled @ net.v + net.c, pooled, units


def score(net: Network, texts) -> np.ndarray:
    """The probability of label 1 of each text."""
    if len(texts) == 0:
        return np.empty(0)
    logit = _logits(net, Layout(texts))[0].astype(np.float64) + net.shift
    return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def _gradients(net: Network, lay: Layout, y: np.ndarray) -> list[np.ndarray]:
    logit, pooled, units = _logits(net, lay)
    d_logit = ((1 / (1 + np.exp(-np.clip(logit, -60, 60))) - y) / len(y)).astype(np.float32)
    d_pooled = d_logit[:, None] * net.v * (pooled > 0)
    # The chunk that attains each maximum: the first whose unit equals it.
    winners = np.zeros(pooled.shape, np.int64)
    ends = np.append(lay.first_chunk[1:], len(lay.chunks))
    for d, (a, b) in enumerate(zip(lay.first_chunk, ends, strict=True)):
        winners[d] = a + units[a:b].argmax(axis=0)
    chosen, where = np.unique(winners, return_inverse=True)
    where = where.reshape(winners.shape)
    d_units = np.zeros((len(chosen), UNITS), np.float32)
    np.add.at(d_units, (where, np.arange(UNITS)), d_pooled)

    halves = np.stack((lay.chunks[chosen], lay.chunks[chosen] + 1), axis=1).ravel()
    codes = lay.windows(halves)
    x = net.embed[codes].reshape(len(codes), WIDTH * DIM)
    answers = np.maximum(x @ net.w1 + net.b1, 0)
    real = (np.arange(PLACES) < lay.places[halves][:, None]).ravel()
    answers *= real[:, None]
    features = answers.reshape(len(chosen), 2 * PLACES, FILTERS).sum(axis=1) / lay.counts[chosen][:, None]
    d_features = d_units @ net.w2.T / lay.counts[chosen][:, None]
    d_answers = np.repeat(d_features, 2 * PLACES, axis=0) * (answers > 0)
    d_x = (d_answers @ net.w1.T).reshape(-1, DIM)
    flat = codes.ravel()
    d_embed = np.stack([np.bincount(flat, d_x[:, k], PAD + 1) for k in range(DIM)], axis=1).astype(np.float32)
    d_embed[PAD] = 0
    return [
        d_embed,
        x.T @ d_answers,
        d_answers.sum(axis=0),
        features.T @ d_units,
        d_units.sum(axis=0),
        pooled.T @ d_logit,
        d_logit.sum(keepdims=True),
    ]


def fit(texts: list[str], y: list[int], share: float, steps: int = STEPS, seed: int = 11) -> Network:
    """Learn by Adam in small batches; ``share`` of label 1 sets the odds where the sample is balanced."""
    net = Network.fresh(seed)
    labels = np.array(y, np.float32)
    ones = float(labels.sum())
    share = min(max(share, 1e-6), 1 - 1e-6)
    if ones in (0.0, float(len(y))):
        net.v[:] = 0
        net.shift = float(np.log(share / (1 - share)))
        return net
    rng = np.random.default_rng(seed)
    weights = net.weights()
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    order = np.empty(0, np.int64)
    for t in range(1, steps + 1):
        if len(order) < TOGETHER:
            order = np.concatenate((order, rng.permutation(len(y))))
        some, order = order[:TOGETHER], order[TOGETHER:]
        rate = 0.01 * (1 - t / (steps + 1))
        grads = _gradients(net, Layout([texts[i] for i in some]), labels[some])
        for w, g, m, s in zip(weights, grads, mean, square, strict=True):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-7)
    net.shift = float(np.log(share / (1 - share)) - np.log(ones / (len(y) - ones)))
    return net


def quality(text: Column, net: Network) -> Column:
    """The probability of label 1 of each text."""

    @F.pandas_udf("double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            whole = texts.tolist()
            parts = [score(net, part) for part in slices(whole, 200_000)]
            yield pd.Series(np.concatenate(parts) if parts else [], dtype="float64")

    return judge(text)


def learn_quality(docs: DataFrame, labels: DataFrame, *, modulus: int = 5, held_out: int = 0, label: str = "quality") -> Network:
    """The network learned from labelled rows that are not held out."""
    learn = remainder(F.col("doc_id"), modulus) != held_out
    return fit(*sample(docs, labels, label, learn, PER_CLASS, MAX_BYTES))


def score_quality(docs: DataFrame, net: Network, *, modulus: int = 5, held_out: int = 0, threshold: float = 0.3) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of each document."""
    out = F.coalesce(remainder(F.col("doc_id"), modulus) == held_out, F.lit(False))
    scored = docs.select("doc_id", out.alias("held_out"), quality(F.col("text"), net).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
