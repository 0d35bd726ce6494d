"""Piece encoding, token counts and packing against the libraries and by their definitions."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import edges
from changeflow.llm import packing
from changeflow.llm.byte_bpe import byte_vocabulary
from changeflow.llm.packing import best_fit, lower_bound
from changeflow.llm.piece_bpe import encoder, library, vocabulary
from changeflow.llm.piece_codec import sentencepiece_codec, sentencepiece_digests
from changeflow.llm.token_counts import TokenCounter, token_counts, whole_tokens

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = [*"abcdefgh .,é日本𝒳́ﬁ<>0x41s/▁\n\t\r\x00'", "the ", "  ", "ing", "▁▁", "<s>", "</s>", "<0x41>", "      "]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join) | st.text(max_size=30))
def test_pieces_are_the_librarys(text):
    own, lib = encoder(PIECES), library(PIECES)
    ids = own.encode(text)
    assert ids.tolist() == lib.encode(text, add_bos=True, add_eos=True)
    assert own.decode(ids) == lib.decode(ids.tolist())


def test_any_ids_decode_as_in_the_library():
    rng = random.Random(2)
    for _ in range(2000):
        ids = [rng.randrange(32000) for _ in range(rng.randrange(10))]
        assert encoder(PIECES).decode(np.array(ids, np.uint32)) == library(PIECES).decode(ids)


def test_rows_and_agendas_of_their_own_merge_alike():
    v, rng = vocabulary(PIECES), random.Random(4)
    words = ["".join(rng.choice("▁etaoinshrdlu.é日") for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    assert [np.frombuffer(b, "<u4").tolist() for b in v.merge_all(words)] == [v.merge(w) for w in words]


def test_whole_tokens_are_proved_by_the_library():
    v, lib, whole = vocabulary(PIECES), library(PIECES), whole_tokens(PIECES)
    assert len(whole) > 30_000
    for piece in random.Random(1).sample(whole, 3000):
        if piece.startswith("▁"):
            assert lib.encode(piece[1:].replace("▁", " ")) == [v.ids[piece]]
    counter = TokenCounter(PIECES, whole)
    assert counter.count(["", "the", "a  b\n"]) == [0, 1, 4]


def test_counts_and_codes_on_odd_rows(spark):
    docs, lib = edges.documents(spark), library(PIECES)
    counted, coded = token_counts(docs, PIECES), sentencepiece_digests(docs, PIECES)
    assert edges.same_ids(counted) and edges.same_ids(coded)
    texts = dict(edges.ROWS)
    for r in counted.collect():
        text = texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(lib.encode(text)))
        assert r.over_limit == (r.n_tokens > 4096)
    for r in sentencepiece_codec(docs, PIECES).collect():
        text = texts[r.doc_id] or ""
        assert r.ids == lib.encode(text, add_bos=True, add_eos=True) and r.agrees
        assert r.decoded == lib.decode(r.ids)
    assert token_counts(edges.empty(spark), PIECES).count() == sentencepiece_codec(edges.empty(spark), PIECES).count() == 0


def test_byte_ids_are_the_librarys_for_all_characters():
    v = byte_vocabulary(BYTES)
    assert v.quick is not None
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 997):
        some = points[k : k + 997 : 13]
        text = "".join(f"a{chr(c)}b 1{chr(c)} {chr(c)}{chr(c)}\n" for c in some)
        assert v.ids(text).tolist() == v.library.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*ALPHABET, "<|endoftext|>", "don't", "   x"]), max_size=40).map("".join) | st.text(max_size=30))
def test_byte_ids_are_the_librarys(text):
    v = byte_vocabulary(BYTES)
    assert v.ids(text).tolist() == v.library.encode(text, add_special_tokens=False).ids


def test_every_token_is_the_product_of_its_own_merge():
    """Merging a token's bytes by rank, short of the last step, leaves the two parts of the file's merge."""
    import json

    with open(BYTES, encoding="utf-8") as f:
        model = json.load(f)["model"]
    rank, merges = model["vocab"], [tuple(m) for m in model["merges"]]
    for a, b in merges:
        parts, last = list(a + b), rank[a + b]
        while len(parts) > 2:
            r, i = min((rank.get(x + y, 1 << 30), i) for i, (x, y) in enumerate(itertools.pairwise(parts)))
            assert r < last
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert parts == [a, b]


def test_bounds_and_best_fit():
    rng = np.random.default_rng(3)
    for _ in range(300):
        capacity = int(rng.integers(4, 40))
        lengths = rng.integers(1, capacity + 1, rng.integers(1, 60))
        bins, offsets, fill = best_fit(lengths, capacity)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        assert -(-lengths.sum() // capacity) <= bound <= len(fill) and fill.max() <= capacity
        for b in range(len(fill)):
            at = np.flatnonzero(bins == b)
            at = at[np.argsort(offsets[at])]
            assert (offsets[at] == np.cumsum(lengths[at]) - lengths[at]).all() and lengths[at].sum() == fill[b]
    # Three pieces above a half each need their own sequence, which the sum of lengths doesn't show.
    assert lower_bound(np.bincount([6, 6, 6], minlength=11), 10) == 3


def check_packed(rows, texts, capacity):
    """Every document's ids are there once, in order, and sequences have no gaps."""
    v, by_doc, by_sequence = byte_vocabulary(BYTES), {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    want = {}
    for doc_id, text in texts:
        ids = np.append(v.ids(text or ""), 2).astype("<u4")
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want.setdefault(doc_id, []).extend(
            (k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(itertools.pairwise(cuts))
        )
    got = {d: sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rs) for d, rs in by_doc.items()}
    assert got == {d: sorted(w) for d, w in want.items()}
    for rs in by_sequence.values():
        rs.sort(key=lambda r: r.offset)
        assert [r.offset for r in rs] == [sum(x.length for x in rs[:i]) for i in range(len(rs))]
        assert sum(r.length for r in rs) <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("group", [4096, 7])
def test_packing_on_odd_rows(spark, monkeypatch, group):
    monkeypatch.setattr(packing, "GROUP", group)
    monkeypatch.setattr(packing, "FAN_IN", 3)
    packed = packing.pack(edges.documents(spark), BYTES, capacity=64)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    check_packed(packed.collect(), edges.ROWS, 64)
    assert packing.pack(edges.empty(spark), BYTES).count() == 0


def test_packing_is_near_its_bound(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 100)
    monkeypatch.setattr(packing, "FAN_IN", 4)
    rng = random.Random(6)
    rows = [(i, "word " * rng.choice([3, 30, 200, 600, rng.randrange(1, 900)])) for i in range(1500)]
    packed = packing.pack(spark.createDataFrame(rows, edges.SCHEMA), BYTES)
    r = packing.report(packed).first()
    assert check_packed(packed.collect(), rows, 1024) == r.sequences
    assert r.bound <= r.sequences <= 1.02 * r.bound + 2


def test_words_are_told_from_the_marks_behind_them(monkeypatch):
    v = vocabulary(PIECES)
    assert v.pre_tokens(v.prepare("one, two!!9 drei%% д.é")) == ["▁one", ",", "▁two", "!!9", "▁drei", "%%", "▁д", ".é"]
    own, lib, r = encoder.__wrapped__(PIECES), library(PIECES), random.Random(4)
    words = ["the", "Wort", "été", "слово", "日本", "x1", ",", "...", "%&", "\n", "  ", "́", "’s", "'s", "»", "0", "▁", "a" * 70]
    monkeypatch.setattr("changeflow.llm.piece_bpe.MEMORY", 50)  # it forgets between batches
    for _ in range(60):
        texts = ["".join(r.choices(words, k=r.randrange(30))) for _ in range(r.randrange(6))]
        for text, ids in zip(texts, own.encode_batch(texts), strict=True):
            assert ids.tolist() == lib.encode(text, add_bos=True, add_eos=True)
