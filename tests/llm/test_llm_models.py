"""The quality network and the toxicity dictionaries: gradients, held-out accuracy, odd rows."""

import math
import random
import zlib

import numpy as np
import pytest

import edges
from changeflow.llm import byte_cnn, compression_toxicity
from changeflow.llm.labelled import sample
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.1"


def auc(y, p):
    order = np.argsort(p, kind="stable")
    rank = np.empty(len(p))
    rank[order] = np.arange(len(p))
    ones = (y == 1).sum()
    return (rank[y == 1].sum() - ones * (ones - 1) / 2) / (ones * (len(y) - ones))


def labelled(label, modulus, held_out):
    import pyarrow.parquet as pq

    docs = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).to_pandas()
    both = docs.merge(pq.read_table(f"{DATA}/labels.parquet").to_pandas(), on="doc_id")
    out = np.array([zlib.crc32(str(i).encode()) % modulus == held_out for i in both.doc_id])
    return both[~out].text.tolist(), both[~out][label].to_numpy(), both[out].text.tolist(), both[out][label].to_numpy()


def test_network_gradients_are_numeric_ones():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abC !é\n"), n)) for n in (0, 3, 130, 400, 700)]
    y = np.array([0, 1, 0, 1, 1], np.float32)
    net = byte_cnn.Network.fresh(3)
    net.b1[:], net.b2[:] = 0.05, 0.05  # at 0 an empty text is at the kink of the rectifier
    lay = byte_cnn.Layout(texts)

    def loss():
        z = byte_cnn._logits(net, lay)[0].astype(np.float64)
        return float(np.mean(np.log1p(np.exp(-np.where(y == 1, z, -z)))))

    for w, g in zip(net.weights(), byte_cnn._gradients(net, lay, y), strict=True):
        for i in np.argsort(-np.abs(g).ravel())[:3]:
            at = np.unravel_index(i, w.shape)
            before = w[at]
            w[at] = before + 3e-3
            up = loss()
            w[at] = before - 3e-3
            down = loss()
            w[at] = before
            assert (up - down) / 6e-3 == pytest.approx(g[at], rel=0.1, abs=2e-4)


def test_scores_do_not_depend_on_neighbours():
    net = byte_cnn.Network.fresh(3)
    texts = ["", "a", "b" * 127, "c" * 128, "d" * 129, None, "Ee" * 3000]
    alone = [float(byte_cnn.score(net, [t])[0]) for t in texts]
    assert byte_cnn.score(net, texts) == pytest.approx(alone, abs=1e-6)
    assert alone[0] == alone[5]


def plain_quality(net, text):
    """The network's score of one text by loops over chunks, windows and filters."""
    data = (text or "").encode()
    halves = max(2, -(-(len(data) + 8) // 128))
    codes = [*data, *[byte_cnn.PAD] * (halves * 128 + 8 - len(data))]
    pooled = [0.0] * byte_cnn.UNITS
    for chunk in range(halves - 1):
        begins = [p for p in range(chunk * 128, chunk * 128 + 256, 2) if p < len(data)]
        sums = [0.0] * byte_cnn.FILTERS
        for p in begins:
            x = [float(v) for c in codes[p : p + 8] for v in net.embed[c]]
            for f in range(byte_cnn.FILTERS):
                sums[f] += max(0.0, sum(a * float(w) for a, w in zip(x, net.w1[:, f], strict=True)) + float(net.b1[f]))
        mean = [v / max(1, len(begins)) for v in sums]
        for u in range(byte_cnn.UNITS):
            unit = sum(m * float(w) for m, w in zip(mean, net.w2[:, u], strict=True)) + float(net.b2[u])
            pooled[u] = max(pooled[u], unit)
    logit = sum(a * float(b) for a, b in zip(pooled, net.v, strict=True)) + float(net.c[0]) + net.shift
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, logit))))


def test_network_equals_plain_loops():
    net, rng = byte_cnn.Network.fresh(5), random.Random(2)
    for w in net.weights()[1:]:
        w += np.random.default_rng(4).standard_normal(w.shape).astype(np.float32) * 0.1
    net.shift = 0.3
    texts = [None, "", "x", "é" * 61, *("".join(rng.choice("abC é.\n") for _ in range(n)) for n in (119, 120, 121, 128, 247, 256, 257, 640))]
    assert byte_cnn.score(net, texts) == pytest.approx([plain_quality(net, t) for t in texts], abs=2e-5)


def plain_toxicity(model, text):
    """The score of one text by loops over windows; lengths come from zstandard with each dictionary."""
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    starts = [0, *(i for i in range(32, len(data), 32) if i < len(data) - 48 + 32)]
    lengths = [[len(compress(data[i : i + 48])) for i in starts] for compress in model.compressors()]
    own = [a - b for a, b in zip(lengths[0], lengths[1], strict=True)]
    often = [a - b for a, b in zip(lengths[0], lengths[2], strict=True)]
    top, beyond = sorted(own, reverse=True)[:3], [g for g in own if g > model.cut]
    x = [1.0, top[0], sum(top) / 3, math.log1p(sum(g - model.cut for g in beyond)), math.sqrt(sum(beyond) / len(own))]
    for cut, tail in zip(model.cuts, model.tails, strict=True):
        n, expected = sum(g > cut for g in often), tail * len(often)
        ratio = 2 * ((n * math.log(n / expected) if n else 0.0) - (n - expected))
        x.append(math.copysign(math.sqrt(max(ratio, 0.0)), n - expected) if n != expected else 0.0)
    z = sum(a * float(w) for a, w in zip(x, model.weights, strict=True))
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def test_toxicity_equals_plain_loops():
    train, y, test, _ = labelled("toxic", 4, 2)
    rows = [i for label in (0, 1) for i in np.flatnonzero(y == label)[:150] if len(train[i]) < 4000]
    model = compression_toxicity.fit([train[i] for i in rows], y[rows].tolist(), y.mean())
    texts = [None, "", "x", "a" * 47, "a" * 48, "a" * 49, "B" * 80, "c" * 81, *test[:200]]
    got = compression_toxicity.score(model, texts)
    assert got == pytest.approx([plain_toxicity(model, t) for t in texts], abs=1e-9) and got.std() > 0.01


def test_quality_is_learned():
    train, y, test, expected = labelled("quality", 5, 0)
    rows = [i for label in (0, 1) for i in np.flatnonzero(y == label)[:1000] if len(train[i]) < 8000]
    net = byte_cnn.fit([train[i] for i in rows], y[rows].tolist(), y.mean())
    p = byte_cnn.score(net, test)
    assert auc(expected, p) > 0.98 and ((p >= 0.3) == expected).mean() > 0.95


def test_toxicity_is_learned():
    train, y, test, expected = labelled("toxic", 4, 2)
    english = [i for i, t in enumerate(test) if " the " in t.lower()]
    rows = [i for label in (0, 1) for i in np.flatnonzero(y == label)[:1500] if len(train[i]) < 8000]
    model = compression_toxicity.fit([train[i] for i in rows], y[rows].tolist(), y.mean())
    p = compression_toxicity.score(model, [test[i] for i in english])
    expected = expected[english]
    assert auc(expected, p) > 0.93 and (p[expected == 0] < 0.3).mean() > 0.97 and (p[expected == 1] >= 0.3).mean() > 0.7


def test_toxicity_is_learned_in_every_language():
    import pyarrow.parquet as pq

    docs = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text", "lang"]).to_pandas()
    rows = docs.merge(pq.read_table(f"{DATA}/labels.parquet").to_pandas(), on="doc_id")
    out = np.array([zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id])
    learn, test = rows[~out], rows[out]

    def runs(text):
        words = text.lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    seen = set().union(*map(runs, learn.text))
    test = test[[len(r & seen) < 0.2 * len(r) for r in map(runs, test.text)]]
    some = learn[learn.text.str.len() < 8000]
    model = compression_toxicity.fit(some.text.tolist(), some.toxic.tolist(), learn.toxic.mean())
    p = compression_toxicity.score(model, test.text.tolist())
    for lang in ("de", "en", "es", "fr"):
        own, y = p[test.lang == lang], test.toxic[test.lang == lang].to_numpy()
        assert auc(y, own) > 0.9 and (own[y == 1] >= 0.3).mean() > 0.65 and (own[y == 0] < 0.3).mean() > 0.94, lang


def test_copied_passages_count_once():
    a, b = b"x" * 10 + bytes(range(97, 123)) + b"one", b"two" + bytes(range(97, 123)) + b"y" * 10
    assert compression_toxicity._uncopied([a, b, a, b"", b"short"]) == [a, b"two\n" + b"y" * 10, b"", b"", b"short"]


@pytest.mark.parametrize("y", [[], [0, 0], [1, 1]])
def test_models_of_too_few_labels_are_constant(y):
    texts = ["some text"] * len(y)
    share = sum(y) / len(y) if y else 0.5
    for p in (
        byte_cnn.score(byte_cnn.fit(texts, y, share), ["", "x", "x" * 5000]),
        compression_toxicity.score(compression_toxicity.fit(texts, y, share), ["", "x", "x" * 5000]),
    ):
        assert p == pytest.approx([share] * 3, abs=1e-5)


def test_scores_on_odd_rows(spark):
    docs, labels = edges.documents(spark), spark.createDataFrame(
        [(4, 1, 0), (5, 0, 1), (8, 0, 1), (8, 1, 1), (None, 1, 1), (10, None, None), (77, 1, 1)],
        "doc_id long, quality int, toxic int",
    ).selectExpr("*", "'x' AS text")
    for learn, score in (
        (byte_cnn.learn_quality, byte_cnn.score_quality),
        (compression_toxicity.learn_toxicity, compression_toxicity.score_toxicity),
    ):
        for some in (labels, labels.limit(0)):
            got = score(docs, learn(docs, some))
            assert edges.same_ids(got) and got.columns == ["doc_id", "held_out", "score", "predicted"]
            assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.collect())
            assert score(edges.empty(spark), learn(edges.empty(spark), some)).count() == 0
    held = {r.doc_id: r.held_out for r in got.collect()}
    assert all(held[i] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in held if i is not None) and held[None] is False
    texts, y, share = sample(docs, labels, "quality", F.lit(True), 10, 10_000)
    # Document 8 counts with its smaller label, 10 has none, 77 has no text; the share counts 77 as well.
    assert (sorted(y), share) == ([0, 0, 1], 0.5) and len(texts) == 3
