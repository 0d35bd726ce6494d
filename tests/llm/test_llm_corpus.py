"""Resampling, token files and whitening against plain versions of their definitions."""

import hashlib
import io
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import zstandard

import edges
from changeflow.llm import importance, token_frames, whitening
from changeflow.llm.byte_bpe import byte_vocabulary
from changeflow.llm.importance import resample
from changeflow.llm.queries import load
from changeflow.llm.token_frames import FrameReader, FrameWriter, open_tokens, read_documents, read_tokens, token_digests, write_tokens
from changeflow.llm.whitening import whiten, whitened_components
from edges import SMALL

BYTES = public_tokenizers.path("byte_bpe_50k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Resampling


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    features = words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    return len(words), [zlib.crc32(f.encode()) % 10_000 for f in features]


def plain_resample(rows, target, percent=25, min_words=20):
    docs = [(i, *plain_features(t)) for i, t in rows]
    s, t = np.zeros(10_000, int), np.zeros(10_000, int)
    for _, _, f in docs:
        np.add.at(s, f, 1)
    for text in target:
        np.add.at(t, plain_features(text)[1], 1)
    gain = [
        math.floor(1000 * math.log(((b + 1) * float(s.sum() + 10_000)) / ((a + 1) * float(t.sum() + 10_000))))
        for a, b in zip(s.tolist(), t.tolist(), strict=True)
    ]
    out = []
    for i, n_words, f in docs:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, n_words, len(f), weight, score, None])
    may = sorted((r for r in out if r[1] >= min_words and r[0] is not None), key=lambda r: (-r[4], r[0]))
    for k, r in enumerate(may[: percent * len(may) // 100], 1):
        r[5] = k
    return sorted((tuple(r) for r in out), key=repr)


def resampled(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("bounds", [{}, {"WORDS": 3, "PAIRS": 2, "LONGEST": 4, "UNIT": 50, "TOGETHER": 30, "PIECE": 40, "HELD": 5}])
def test_resampling_on_odd_rows(spark, monkeypatch, bounds):
    """Also with a head, units and pieces so small that all paths and all cuts are met."""
    for name, value in bounds.items():
        monkeypatch.setattr(importance, name, value)
    rows = [r for r in edges.ROWS if r[0] != 10] + [(100 + i, " ".join(edges.WORDS[i : i + 30 - i % 9])) for i in range(40)]
    target = [None, "", "Same words again, and AGAIN", "w1 w2 w3 w4 w4", "é日本"]
    docs = spark.createDataFrame(rows, edges.SCHEMA).selectExpr("*", "'x' AS score", "'y' AS weight", "'z' AS DOC_ID")
    like = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resample(docs, like)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert resampled(got) == plain_resample(rows, target)


def test_resampling_of_long_and_no_texts(spark):
    assert edges.same_ids(resample(edges.documents(spark), edges.empty(spark)))
    got = resampled(resample(spark.createDataFrame([(1, edges.LONG), (2, edges.LONG)], edges.SCHEMA), edges.empty(spark), percent=50))
    assert got == plain_resample([(1, edges.LONG), (2, edges.LONG)], [], percent=50)
    assert sum(r[5] is not None for r in got) == 1
    assert resample(edges.empty(spark), edges.documents(spark)).count() == 0


def test_frequent_pairs_are_in_the_head(spark, folder, monkeypatch):
    rows = [(i, "of the " * 50 + f"x{i} y{i}") for i in range(200)]
    texts = spark.createDataFrame(rows, edges.SCHEMA).repartition(7)
    head = importance.learn_head(texts, 10_000, folder)
    assert head.words[:2] == [b"of", b"the"] and {1, len(head.words)} <= set(head.pairs.tolist())
    for code, bucket in zip(head.pairs.tolist(), head.pair_bucket.tolist(), strict=True):
        a, b = divmod(code, len(head.words))
        assert bucket == zlib.crc32(head.words[a] + b" " + head.words[b]) % 10_000
    monkeypatch.setattr(importance, "WORDS", 50)
    monkeypatch.setattr(importance, "PAIRS", 2)
    small = importance.learn_head(texts, 10_000, f"{folder}-small")  # 400 words are equally rare: none of them
    assert small.words == [b"of", b"the"] and small.pairs.tolist() == [1, 2]


# Token files


def test_frames_round_trip_and_stand_alone():
    rng, out = np.random.default_rng(1), io.BytesIO()
    writer = FrameWriter(out, 4)
    docs = [(None, 3), (1, 0), (2, 70_000), (5, 1), (5, 16_384), (9, 16_385), (12, 40)]
    ids = [rng.integers(0, 1 << 32, n, dtype=np.uint32) for _, n in docs]
    for (doc_id, _), x in zip(docs, ids, strict=True):
        writer.add(doc_id, x)
    assert writer.finish() == len(out.getvalue())
    reader = FrameReader(out, len(out.getvalue()))
    assert [reader.doc_id(r) for r in range(len(docs))] == [d for d, _ in docs]
    parts = {}
    for row, x, _ in reader.pieces(range(len(docs))):
        parts.setdefault(row, []).append(x)
    assert all((np.concatenate(parts[r]) == x).all() for r, x in enumerate(ids))
    assert list(reader.rows_of(5)) == [3, 4] and list(reader.rows_of(6)) == []
    # One document costs its own frames.
    alone = FrameReader(out, len(out.getvalue()))
    assert (next(iter(alone.pieces([6])))[1] == ids[6]).all() and alone.frames_read == 1
    # Each frame decompresses by itself, and all together are the ids.
    plain = b"".join(
        zstandard.ZstdDecompressor().decompress(out.getvalue()[a:b])
        for a, b in zip(reader.begin[:-2].tolist(), reader.begin[1:-1].tolist(), strict=True)
    )
    assert plain == np.concatenate(ids).astype("<u4").tobytes()
    assert (np.diff(reader.data_begin) <= token_frames.FRAME).all()


def test_a_damaged_frame_is_noticed():
    out = io.BytesIO()
    writer = FrameWriter(out, 2)
    for i in range(50):
        writer.add(i, np.random.default_rng(i).integers(0, 50_000, 3000))
    size = writer.finish()
    for at in (40, 60_000):
        data = bytearray(out.getvalue())
        data[at] ^= 1
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(FrameReader(io.BytesIO(bytes(data)), size).pieces(range(50)))
    with pytest.raises(ValueError):
        FrameReader(io.BytesIO(out.getvalue()[:-1] + b"x"), size)


@pytest.mark.parametrize("bounds", [(1 << 16, 1 << 25, 1 << 20), (64, 500, 3)])
def test_token_files_on_odd_rows(spark, folder, monkeypatch, bounds):
    for name, value in zip(("FRAME", "FILE_TOKENS", "FILE_DOCUMENTS"), bounds, strict=True):
        monkeypatch.setattr(token_frames, name, value)
    rows = [r for r in edges.ROWS if r[0] != 10] + [(1000 - i, f"number {i} of many " * (i % 7)) for i in range(60)] + [(None, None)]
    docs = spark.createDataFrame(rows, edges.SCHEMA).selectExpr("*", "'x' AS start", "'y' AS name", "'z' AS DOC_ID")
    write_tokens(docs, BYTES, folder)
    tokens = open_tokens(spark, folder)
    v = byte_vocabulary(BYTES)
    want = {}
    for i, t in rows:
        ids = [*v.library.encode(t or "", add_special_tokens=False).ids, 0]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), tuple(ids)))
    got = sorted(token_digests(spark, tokens).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got[:-1]]]).tolist()
    for i, some in want.items():
        assert sorted((r.n_tokens, r.ids_crc32) for r in got if r.doc_id == i) == sorted(x[:2] for x in some)
    whole = sorted(read_tokens(spark, tokens).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start) for r in whole] == [(r.doc_id, r.start) for r in got]
    assert all(sorted(tuple(r.ids) for r in whole if r.doc_id == i) == sorted(x[2] for x in some) for i, some in want.items())
    wanted = [9, 950, 11, 950, None, 77_777, 941]
    some = read_documents(spark.createDataFrame([(i,) for i in wanted], "doc_id long"), tokens).collect()
    assert sorted(r.doc_id for r in some) == [9, 9, 11, 941, 950]
    assert {(r.doc_id, r.start, tuple(r.ids)) for r in some} <= {(r.doc_id, r.start, tuple(r.ids)) for r in whole}
    if bounds[0] == 64:
        assert len(tokens.files) > 20


def test_long_texts_and_no_rows(spark, folder):
    write_tokens(spark.createDataFrame([(2, "b"), (1, edges.LONG)], edges.SCHEMA), BYTES, f"{folder}/long")
    first, second = sorted(token_digests(spark, open_tokens(spark, f"{folder}/long")).collect(), key=lambda r: r.start)
    ids = np.append(byte_vocabulary(BYTES).ids(edges.LONG), 0).astype("<u4")
    assert (first.doc_id, first.n_tokens, first.ids_crc32) == (1, len(ids), zlib.crc32(ids.tobytes()))
    assert (second.doc_id, second.start) == (2, len(ids))
    write_tokens(edges.empty(spark), BYTES, f"{folder}/none")
    none = open_tokens(spark, f"{folder}/none")
    assert token_digests(spark, none).count() == read_tokens(spark, none).count() == 0
    assert read_documents(spark.createDataFrame([(1,)], "doc_id long"), none).count() == 0


def test_query_equals_the_library(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    library, start, want = byte_vocabulary(BYTES).library, 0, []
    for doc_id, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = load()[0]["op12_token_frames"](spark, SMALL).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(tuple(r) for r in got.collect()) == want


# Whitening


def integers(vectors):
    return [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]


def exact_covariance(x):
    n, dim = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(dim)]
    y = [[n * r[i] - s[i] for i in range(dim)] for r in x]
    cov = [[Fraction(sum(r[i] * r[j] for r in y), n**3) for j in range(dim)] for i in range(dim)]
    return s, y, np.array([[float(c) for c in row] for row in cov])


def check_whitening(rows, x, ids, components=32):
    s, y, cov = exact_covariance(x)
    n, values = len(x), np.linalg.eigvalsh(cov)[::-1]
    keep = min(components, int((values > 1e-10 * values[0]).sum()))
    by = {}
    for r in rows:
        by.setdefault(r.component, {})[r.vec_id] = r
    assert sorted(by) == list(range(1, keep + 1)) and all(sorted(b) == sorted(ids) for b in by.values())
    w = np.array([[by[k][i].whitened for k in range(1, keep + 1)] for i in ids])
    centred = np.array([[float(Fraction(v, n)) for v in r] for r in y])
    # Each column is the centred rows times an eigenvector over the root of its eigenvalue.
    q = np.linalg.lstsq(centred, w, rcond=None)[0] * np.sqrt(values[:keep])
    assert np.allclose(centred @ (q / np.sqrt(values[:keep])), w, atol=1e-8)
    assert np.allclose(cov @ q, q * values[:keep], atol=1e-8 * values[0])
    assert np.allclose(w.T @ w / n, np.eye(keep), atol=1e-6)
    for k, b in by.items():
        for i, row in zip(ids, y, strict=True):
            r = b[i]
            assert (r.n, r.deviation) == (n, sum(v * v for v in row))
            assert r.explained == pytest.approx(values[k - 1] / values.sum(), rel=1e-9) and r.identity_error < 1e-4


def test_whitening_is_its_definition(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = sorted(df.collect(), key=lambda r: r.vec_id)
    check_whitening(load()[0]["op13_polar_whitening"](spark, SMALL).collect(), integers([r.embedding for r in rows]), [r.vec_id for r in rows])


def test_covariance_is_exact(spark):
    rng = random.Random(5)
    x = [[rng.choice([0, 1, 10**6, -(10**9)]) / 64 for _ in range(5)] for _ in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    _, model = whiten(df)
    assert (model.covariance == exact_covariance(integers(x))[2]).all()
    assert (whiten(df.repartition(2))[1].covariance == model.covariance).all()


def test_whitening_on_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [math.sin(i * k) * 3 for k in range(1, 5)]) for i in range(30)]
    rows = [*good, (3, good[3][1]), (None, [0.0, 1.0, 2.0, 3.0]), (40, None), (41, []), (42, [1.0, 2.0])]
    rows += [(43, [nan, 1.0, 1.0, 1.0]), (44, [1.0, -inf, 1.0, 1.0]), (45, [1.0, None, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS n", "'y' AS whitened", "1 AS VEC_ID")
    got = whitened_components(df).collect()
    assert len(got) == 32 * 4 and sum(r.vec_id == 3 for r in got) == 8 and sum(r.vec_id is None for r in got) == 4
    assert {r.vec_id for r in got} == {*range(30), None} and {r.n for r in got} == {32}
    assert whitened_components(df.where("vec_id = 42")).count() == 0  # one row has no variance
    assert whitened_components(df.limit(0)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0, float(i % 2)]) for i in range(9)], "vec_id long, embedding array<float>")
    assert {r.component for r in whitened_components(same).collect()} == {1}


def test_huge_entries(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [5.0, 1e6]), (4, [1e15, 2e6]), (5, [0.0, -1e6])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    wide, model = whiten(df)
    cut = [[max(-whitening.LARGEST, min(whitening.LARGEST, 64 * c)) / 64 for c in v] for _, v in rows]
    x = integers(cut)
    _, y, cov = exact_covariance(x)
    assert (model.covariance == cov).all()
    got = {r.vec_id: r for r in wide.collect()}
    assert got[3].deviation is None or int(got[3].deviation) == sum(v * v for v in y[2])
    assert all(math.isfinite(w) for r in got.values() for w in r.whitened)
    assert len(whitened_components(df).collect()) == 5 * len(got[1].whitened)
