"""Toxicity by compression distance: three zstandard dictionaries and calibrated thresholds.

One dictionary is trained on ordinary text. The toxic one goes on from it with a second part, trained on
what toxic text has of its own: the spans of toxic documents made of five-byte strings that a likelihood
ratio shows to be frequent there and rare in ordinary ones, and that a second half of the sample bears
out. A word stem that ordinary text of one language holds now and then, and toxic text again and again, is
none of these; so a third dictionary is trained likewise on strings that toxic documents hold repeatedly,
with a little of what surrounds them, where passages that were seen in another document count no more.
Every whole text is cut into overlapping windows; each is compressed with every dictionary, and a
toxic one gains where it makes the window shorter. The first one's gains of a text (the largest, the three
largest, those beyond a cut that one ordinary window in a thousand reaches) and the other one's (by how
much more windows than in ordinary text of this length lie beyond each of several cuts) are put on one
scale by a logistic fit.

Defined results: a null or empty text is one empty window without gain. Without labels of both classes,
every score is the share of label 1 (0.5 without labels). Repeated rows are scored each; very long texts
whole, window by window. Inputs of a score are the bytes of the text and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.llm.labelled import remainder, sample

WINDOW, STEP = 48, 32
LEVEL, MIN_MATCH = 3, 6
GRAM = 5
ORDINARY_BYTES, TOXIC_BYTES = 16_384, 4_096
#: Likelihood ratio of a string that marks toxic text, and how many toxic documents for an ordinary one.
RATIO, PURITY, PURITY_AGAIN = 12.0, 30, 10
#: The same for documents that hold a string so often.
OFTEN, OFTEN_PURITY, OFTEN_PURITY_AGAIN = 2, 8, 5
#: Bytes around a repeated string that are kept, so that matches are longer; bytes of a copied passage.
BEFORE, AFTER = 1, 2
COPIED = 24
#: Shares of ordinary windows beyond each cut.
TAILS = (0.1, 0.03, 0.01, 0.003, 0.001)
FEATURES = 5 + len(TAILS)
#: Learning: documents a class, bytes of the longest.
PER_CLASS, MAX_BYTES = 2_000, 8_000

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER)


def _windows(data: bytes) -> Iterator[bytes]:
    return (data[i : i + WINDOW] for i in range(0, max(1, len(data) - WINDOW + STEP), STEP))


def _grams(data: bytes, size: int = GRAM) -> np.ndarray:
    """A hash of the bytes at each place; equal hashes are equal strings but for one chance in 2 ** 64."""
    a = np.frombuffer(data, np.uint8).astype(np.uint64)
    if len(a) < size:
        return np.empty(0, np.uint64)
    x = a[: len(a) - size + 1].copy()
    for k in range(1, size):
        x = x * _PRIME + a[k : len(a) - size + 1 + k]
    return x


def _uncopied(docs: list[bytes]) -> list[bytes]:
    """The documents without passages of an earlier one, a newline in place of each."""
    each, out = [_grams(d, COPIED) for d in docs], []
    keys = np.concatenate(each)
    owner = np.repeat(np.arange(len(docs)), [len(e) for e in each])
    order = np.lexsort((owner, keys))
    new = np.ones(len(keys), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    first = np.empty(len(keys), np.int64)
    first[order] = owner[order][np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))]
    copied, end = first < owner, 0
    for d, e in zip(docs, each, strict=True):
        inside = _cover(np.flatnonzero(copied[end : end + len(e)]), len(d), 0, COPIED)
        out.append(b"\n".join(d[i:j] for i, j in _runs(~inside)))
        end += len(e)
    return out


def _cover(at: np.ndarray, size: int, before: int, after: int) -> np.ndarray:
    """Which of ``size`` places lie from ``before`` places ahead of one in ``at`` up to ``after`` behind it."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, np.maximum(at - before, 0), 1)
    np.add.at(edge, np.minimum(at + after, size), -1)
    return np.cumsum(edge[:-1]) > 0


def _runs(inside: np.ndarray) -> Iterator[tuple[int, int]]:
    turn = np.diff(np.concatenate(([0], inside.astype(np.int8), [0])))
    return zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist(), strict=True)


def _frequency(docs: list[bytes], least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Strings, and the number of documents that hold each ``least`` times or more."""
    each = [keys[n >= least] for keys, n in (np.unique(_grams(d), return_counts=True) for d in docs)]
    return np.unique(np.concatenate(each) if each else np.empty(0, np.uint64), return_counts=True)


def _look_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    known, counts = table
    if not len(known):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, counts[at], 0)


def _marks(
    toxic: list[bytes], ordinary: list[bytes], least: int = 1, purity: int = PURITY, purity_again: int = PURITY_AGAIN
) -> np.ndarray:
    """Strings of toxic text, by documents that hold them ``least`` times or more, sorted."""
    ta, tb, oa, ob = toxic[::2], toxic[1::2], ordinary[::2], ordinary[1::2]
    keys, a = _frequency(ta, least)
    b = _look_up(_frequency(oa, least), keys)
    expected = (a + b) * len(ta) / (len(ta) + len(oa))
    rest = (a + b) - expected
    ratio = 2 * (a * np.log(a / expected) + np.where(b > 0, b * np.log(np.maximum(b, 1) / rest), 0))
    # Purity compares shares of documents, for the two samples may differ in size.
    scale = len(oa) / max(1, len(ta))
    keys = keys[(ratio > RATIO) & (b * purity <= a * scale)]
    again, other = _look_up(_frequency(tb, least), keys), _look_up(_frequency(ob, least), keys)
    return keys[(again > 0) & (other * purity_again <= again * scale)] if tb else keys


def _spans(data: bytes, marks: np.ndarray, before: int = 0, after: int = 0) -> list[bytes]:
    at = np.flatnonzero(np.isin(_grams(data), marks))
    return [data[i:j] for i, j in _runs(_cover(at, len(data), before, GRAM + after))]


def _train(size: int, samples: list[bytes], k: int) -> bytes:
    samples = [s for s in samples if len(s) >= 8]
    if not samples:
        return b""
    try:
        return zstd.train_dictionary(size, samples, k=k, d=6).as_bytes()
    except zstd.ZstdError:  # too little to choose from: all of it fits
        return b"\n".join(samples)[-size:]


@dataclass
class ToxicModel:
    ordinary: bytes
    toxic: bytes
    often: bytes
    cut: float
    cuts: np.ndarray
    tails: np.ndarray  # shares of ordinary windows beyond each of the cuts
    weights: np.ndarray  # bias first

    def compressors(self):
        return tuple(_compressor(self.ordinary + own) for own in (b"", self.toxic, self.often))


def _compressor(content: bytes):
    options = zstd.ZstdCompressionParameters.from_level(
        LEVEL,
        min_match=MIN_MATCH,
        format=zstd.FORMAT_ZSTD1_MAGICLESS,
        write_content_size=False,
        write_checksum=False,
        write_dict_id=False,
    )
    if not content:
        return zstd.ZstdCompressor(compression_params=options).compress
    dictionary = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=options)
    return zstd.ZstdCompressor(dict_data=dictionary, compression_params=options).compress


def _gains(text: str | None, compressors) -> np.ndarray:
    """By how many bytes each toxic dictionary shortens each window more than the ordinary one."""
    size = np.array([[len(compress(w)) for w in _windows(_bytes(text))] for compress in compressors], np.int64)
    return size[0] - size[1:]


def _features(gains: np.ndarray, model: ToxicModel) -> np.ndarray:
    own, often = gains
    top = -np.sort(-own)[:3]
    beyond = own[own > model.cut]
    # The signed root of a likelihood ratio: windows beyond a cut, against those of ordinary text.
    n, expected = (often[:, None] > model.cuts).sum(axis=0), model.tails * len(often)
    ratio = 2 * (n * np.log(np.maximum(n, 1) / expected) - (n - expected))
    return np.concatenate((
        [
            1.0,
            top[0],
            top.sum() / 3,
            np.log1p(np.maximum(beyond - model.cut, 0).sum()),
            np.sqrt(beyond.sum() / len(own)),
        ],
        np.sign(n - expected) * np.sqrt(np.maximum(ratio, 0)),
    ))


def _logistic(x: np.ndarray, y: np.ndarray, share: float, rounds: int = 30) -> np.ndarray:
    """Newton's method with a little shrinkage; rows weigh as their class does in the whole."""
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 1.0)
    ridge[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = x.T @ (weight * (y - p)) - ridge * w
        bend = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
        w = w + np.linalg.solve(bend, slope)
    return w


def fit(texts: list[str], y: list[int], share: float) -> ToxicModel:
    """Both dictionaries and the calibration, from a sample; ``share`` of label 1 in the whole."""
    toxic = [_bytes(t) for t, label in zip(texts, y, strict=True) if label == 1]
    ordinary = [_bytes(t) for t, label in zip(texts, y, strict=True) if label == 0]
    share = min(max(share, 1e-6), 1 - 1e-6)
    if not toxic or not ordinary:
        weights = np.zeros(FEATURES)
        weights[0] = np.log(share / (1 - share))
        return ToxicModel(b"", b"", b"", 0.0, np.zeros(len(TAILS)), np.array(TAILS), weights)
    marks = _marks(toxic, ordinary)
    own = [b"\n".join(s) for s in (_spans(d, marks) for d in toxic) if s]
    once, usual = _uncopied(toxic), _uncopied(ordinary)
    marks = _marks(once, usual, OFTEN, OFTEN_PURITY, OFTEN_PURITY_AGAIN)
    often = [b"\n".join(s) for s in (_spans(d, marks, BEFORE, AFTER) for d in once) if s]
    pieces = [d[i : i + 64] for d in ordinary[::2] for i in range(0, len(d), 64)]
    model = ToxicModel(
        _train(ORDINARY_BYTES, pieces, 64), _train(TOXIC_BYTES, own, 32), _train(TOXIC_BYTES, often, 32),
        0.0, np.zeros(len(TAILS)), np.array(TAILS), np.zeros(FEATURES),
    )
    compressors = model.compressors()
    gains = [_gains(t, compressors) for t in texts]
    labels = np.array(y, np.float64)
    usual = np.concatenate([g for g, label in zip(gains, y, strict=True) if label == 0], axis=1)
    model.cut = float(np.quantile(usual[0], 0.999))
    model.cuts = np.quantile(usual[1], 1 - np.array(TAILS))
    # Gains are whole bytes, so the share beyond a cut is not that which was asked for.
    model.tails = np.maximum((usual[1][:, None] > model.cuts).mean(axis=0), 1e-6)
    model.weights = _logistic(np.array([_features(g, model) for g in gains]), labels, share)
    return model


def score(model: ToxicModel, texts, compressors=None) -> np.ndarray:
    """The probability of label 1 of each text."""
    compressors = compressors or model.compressors()
    x = np.array([_features(_gains(t, compressors), model) for t in texts]).reshape(-1, FEATURES)
    return 1 / (1 + np.exp(-np.clip(x @ model.weights, -60, 60)))


def toxicity(text: Column, model: ToxicModel) -> Column:
    """The probability of label 1 of each text."""

    @F.pandas_udf("double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compressors = model.compressors()
        for texts in batches:
            yield pd.Series(score(model, texts.tolist(), compressors), dtype="float64")

    return judge(text)


def learn_toxicity(docs: DataFrame, labels: DataFrame, *, modulus: int = 4, held_out: int = 2, label: str = "toxic") -> ToxicModel:
    """The model learned from labelled rows that are not held out."""
    learn = remainder(F.col("doc_id"), modulus) != held_out
    return fit(*sample(docs, labels, label, learn, PER_CLASS, MAX_BYTES))


def score_toxicity(
    docs: DataFrame, model: ToxicModel, *, modulus: int = 4, held_out: int = 2, threshold: float = 0.3
) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of each document."""
    out = F.coalesce(remainder(F.col("doc_id"), modulus) == held_out, F.lit(False))
    scored = docs.select("doc_id", out.alias("held_out"), toxicity(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_ordinary(docs: DataFrame, model: ToxicModel, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""
    return docs.where(toxicity(docs["text"], model) < threshold)
