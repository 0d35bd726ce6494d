"""SentencePiece vocabularies of the merge type: encoding by a score-ordered agenda, and decoding.

A text is a row of characters, spaces written as U+2581. All adjacent pairs that form a piece wait in
an agenda ordered by score, then by place; the best is merged and its new neighbours join the agenda,
until none is left. Characters without a piece become their bytes.

Merging needs no look beyond places that no piece spans. Loading the vocabulary proves such places:
between a character and a following U+2581 (if no piece holds the two in a row), around characters
that no longer piece holds, behind a word of letters before an ASCII mark (if no piece holds a letter
and such a mark in a row), and between any two characters that stand side by side in no piece. So a
text is cut into pre-tokens, and each distinct pre-token is merged once and remembered.

New pre-tokens of a batch are merged together: each has its agenda as a row of a matrix, the ranks of
its adjacent pairs, and in every step each row gives up its best pair. Long pre-tokens, and those with
characters outside the vocabulary, go through an agenda of their own, a heap.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np

SPACE = "▁"
#: Pre-tokens remembered by one worker (about 150 MB); beyond that it forgets all and begins anew.
MEMORY = 1_000_000
#: Longer pre-tokens are not remembered, whatever their number.
MEMORY_CHARS = 64
#: Longest pre-token that is merged as a row, and rows merged together.
ROW_CHARS, ROWS = 40, 8192
NONE = np.int32(-1)
#: Letters of words, and the marks and digits that may follow them, as regular expressions have them.
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ɏЀ-ӿ", "!-@\\[-`{-~"


class PieceVocabulary:
    """What encoding and decoding need of a ``.model`` file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kind, norm = model.trainer_spec, model.normalizer_spec
        kinds = {p.type for p in model.pieces}
        if kind.model_type != 2 or not kind.byte_fallback or kinds - {1, 2, 3, 6}:
            raise ValueError("only merge-type vocabularies with byte fallback and no user-defined pieces")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only vocabularies that leave texts as they are")
        if kind.treat_whitespace_as_suffix:
            raise ValueError("only vocabularies with spaces before words")
        self.dummy_prefix = norm.add_dummy_prefix
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        self.rank = {p.piece: -p.score for p in model.pieces if p.type == 1}
        self.byte_ids = [0] * 256
        surface = []
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                surface.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == 1:
                surface.append(p.piece.encode())
            else:
                surface.append(b" \xe2\x81\x87 " if p.type == 2 else b"")
        self.begin_id = next(i for i, p in enumerate(model.pieces) if p.piece == "<s>")
        self.end_id = next(i for i, p in enumerate(model.pieces) if p.piece == "</s>")
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_size = np.array([len(s) for s in surface], np.int64)
        self.surface_at = np.cumsum(self.surface_size) - self.surface_size
        self.inner = {a + b for p in self.ids for a, b in zip(p, p[1:], strict=False)}
        self.pre_tokens = re.compile(self._pattern()).findall
        self._tables()

    def _tables(self) -> None:
        """Numbers for symbols, and for pairs of symbols the piece that they form."""
        symbol = dict(self.ids)
        chars = sorted(set().union(*self.ids))
        for c in chars:
            symbol.setdefault(c, len(self.surface_size) + len(symbol))
        self.char_symbol = np.full(0x110000, NONE, np.int32)
        self.char_symbol[[ord(c) for c in chars]] = [symbol[c] for c in chars]
        order = {r: i for i, r in enumerate(sorted(set(self.rank.values())))}
        self.symbol_rank = np.full(len(self.surface_size) + 1, len(order), np.int32)
        self.symbol_rank[list(self.ids.values())] = [order[self.rank[piece]] for piece in self.ids]
        pairs = {}
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                a, b = symbol.get(piece[:k]), symbol.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = i
        keys = np.array(list(pairs), np.uint64)
        bits = max(12, int(len(pairs)).bit_length() + 3)
        self._shift = np.uint64(64 - bits)
        self._keys = np.full((1 << bits) + 64, 2**64 - 1, np.uint64)
        self._pieces = np.full(len(self._keys), NONE, np.int32)
        self._probes = 1
        for key, at, piece in zip(keys, self._slot(keys).tolist(), pairs.values(), strict=True):
            probe = 0
            while self._pieces[at + probe] != NONE:
                probe += 1
            self._keys[at + probe], self._pieces[at + probe] = key, piece
            self._probes = max(self._probes, probe + 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def _joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols forms, or NONE."""
        keys = (a.astype(np.int64) << 20 | b.astype(np.int64)).view(np.uint64)
        at = self._slot(keys)
        held, out = self._keys[at], self._pieces[at]
        other = (held != keys) | (a < 0) | (b < 0)
        # Few pairs lie behind another one, and none behind an empty slot.
        rest = np.nonzero(other & (out != NONE) & (a >= 0) & (b >= 0))
        out[other] = NONE
        keys, at = keys[rest], at[rest]
        for probe in range(1, self._probes):
            if not len(keys):
                break
            found = self._keys[at + probe] == keys
            out[tuple(r[found] for r in rest)] = self._pieces[at + probe][found]
            left = ~found & (self._pieces[at + probe] != NONE)
            keys, at, rest = keys[left], at[left], tuple(r[left] for r in rest)
        return out

    def merge_all(self, pre_tokens: list[str]) -> list[bytes]:
        """Ids of each pre-token as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pre_tokens)
        size = np.fromiter(map(len, pre_tokens), np.int64, len(pre_tokens))
        order = np.argsort(size, kind="stable")
        short = order[size[order] <= ROW_CHARS]
        alone = order[len(short) :].tolist()
        for k in range(0, len(short), ROWS):
            some = short[k : k + ROWS]
            alone += self._merge_rows([pre_tokens[i] for i in some], size[some], some, out)
        for i in alone:
            out[i] = np.array(self.merge(pre_tokens[i]), "<u4").tobytes()
        return out

    def _merge_rows(self, words: list[str], size: np.ndarray, places: np.ndarray, out: list[bytes]) -> list[int]:
        """Fills in ``out`` for these words; returns the places of those it can't merge."""
        width = int(size.max())
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = np.full((len(words), width + 1), NONE, np.int32)
        symbols[np.arange(width + 1) < size[:, None]] = self.char_symbol[points]
        strange = (symbols[:, :width] == NONE).sum(axis=1) != width - size
        done = np.full(symbols.shape, NONE, np.int32)
        row = np.arange(len(words))
        joined = self._joined(symbols[:, :-1], symbols[:, 1:])
        joined = np.concatenate((joined, np.full((len(words), 1), NONE, np.int32)), axis=1)
        columns = np.arange(width + 1)
        while len(row):
            rank = self.symbol_rank[joined]
            j = rank.argmin(axis=1)
            every = np.arange(len(row))
            over = joined[every, j] == NONE
            if over.any():
                done[row[over]] = symbols[over]
                left = ~over
                row, symbols, joined, j = row[left], symbols[left], joined[left], j[left]
                every = every[: len(row)]
                if not len(row):
                    break
            piece = joined[every, j]
            moved = np.minimum(columns + (columns > j[:, None]), width)
            symbols = np.take_along_axis(symbols, moved, 1)
            joined = np.take_along_axis(joined, moved, 1)
            symbols[:, -1] = joined[:, -1] = NONE
            symbols[every, j] = piece
            joined[every, j] = self._joined(piece, symbols[every, np.minimum(j + 1, width)])
            lead = j > 0
            joined[every[lead], j[lead] - 1] = self._joined(symbols[every[lead], j[lead] - 1], piece[lead])
        strange |= (done >= len(self.surface_size)).any(axis=1)
        used = done != NONE
        ids = done[used].astype("<u4").tobytes()
        ends = np.cumsum(used.sum(axis=1)) * 4
        begin = 0
        for place, end in zip(places.tolist(), ends.tolist(), strict=True):
            out[place] = ids[begin:end]
            begin = end
        return places[strange].tolist()

    def _pattern(self) -> str:
        alone = "".join(c for c in "\n\t\r" if not any(c in pair for pair in self.inner))
        if any(pair[1] == SPACE and pair[0] != SPACE for pair in self.inner):
            return f"[^{alone}]+|[{alone}]" if alone else "(?s:.+)"
        rest = f"[^{SPACE}{alone}]+"
        letter, mark = re.compile(f"[{LETTERS}]").match, re.compile(f"[{MARKS}]").match
        if not any(letter(first) and mark(second) for first, second in self.inner):
            rest = f"(?:[{LETTERS}]++(?![^{MARKS}{SPACE}{alone}])|{rest})"
        return f"{SPACE}*{rest}|{SPACE}+" + (f"|[{alone}]" if alone else "")

    def prepare(self, text: str) -> str:
        """The text as merging sees it."""
        text = text.replace(" ", SPACE)
        return SPACE + text if text and self.dummy_prefix else text

    def merge(self, pre_token: str) -> list[int]:
        """Ids of a pre-token."""
        out: list[int] = []
        begin = 0
        inner = self.inner
        for i in range(1, len(pre_token)):
            if pre_token[i - 1 : i + 1] not in inner:
                out += self._agenda(pre_token[begin:i])
                begin = i
        return out + self._agenda(pre_token[begin:])

    def _agenda(self, part: str) -> list[int]:
        if len(part) > 1:
            symbols = self._merged(part)
        else:
            symbols = [part] if part else []
        out = []
        for s in symbols:
            i = self.ids.get(s)
            if i is None:
                out += [self.byte_ids[b] for b in s.encode("utf-8", "surrogatepass")]
            else:
                out.append(i)
        return out

    def _merged(self, part: str) -> list[str]:
        rank = self.rank
        symbols: list[str | None] = list(part)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            r = rank.get(pair := part[i : i + 2])
            if r is not None:
                agenda.append((r, i, i + 1, pair))
        heapq.heapify(agenda)
        while agenda:
            _, left, right, piece = heapq.heappop(agenda)
            # A symbol only grows or vanishes, so equal lengths mean that both are as they were.
            a, b = symbols[left], symbols[right]
            if a is None or b is None or len(a) + len(b) != len(piece):
                continue
            symbols[left], symbols[right] = piece, None
            follow = after[left] = after[right]
            if follow < n:
                before[follow] = left
                r = rank.get(pair := piece + symbols[follow])
                if r is not None:
                    heapq.heappush(agenda, (r, left, follow, pair))
            lead = before[left]
            if lead >= 0:
                r = rank.get(pair := symbols[lead] + piece)
                if r is not None:
                    heapq.heappush(agenda, (r, lead, left, pair))
        return [s for s in symbols if s is not None]

    def whole_tokens(self) -> list[str]:
        """The pieces that, as a pre-token of their own, encode as one token: themselves."""
        return [p for p, i in self.ids.items() if self.pre_tokens(p) == [p] and self.merge(p) == [i]]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> PieceVocabulary:
    return PieceVocabulary(path)


def _room(values: np.ndarray, size: int) -> np.ndarray:
    """``values`` with room for ``size``, doubled if need be."""
    return values if size <= len(values) else np.concatenate((values, np.zeros(max(size, 2 * len(values)) - len(values), values.dtype)))


class _Numbers(dict):
    """Numbers for pre-tokens, given as they are first asked for; ``new`` lists those without ids yet."""

    def __init__(self):
        self.given, self.new = 0, []

    def __missing__(self, pre_token: str) -> int:
        n = self[pre_token] = self.given
        self.given += 1
        self.new.append(pre_token)
        return n


class PieceEncoder:
    """Encodes and decodes whole texts; one for each worker."""

    def __init__(self, path: str):
        self.vocabulary = vocabulary(path)
        self._forget()

    def _forget(self) -> None:
        self.known, self.ids = _Numbers(), np.zeros(1 << 16, "<u4")
        self.at = np.zeros(1 << 16, np.int64)  # where each number's ids begin, and where the last ends

    def _learn(self) -> None:
        """Ids of the new pre-tokens."""
        known, new = self.known, self.known.new
        merged = self.vocabulary.merge_all(new)
        first, last = known.given - len(new), known.given
        ids = np.frombuffer(b"".join(merged), "<u4")
        begin = self.at[first]
        self.at = _room(self.at, last + 1)
        self.ids = _room(self.ids, begin + len(ids))
        self.at[first + 1 : last + 1] = begin + np.cumsum(np.fromiter(map(len, merged), np.int64, len(new)) // 4)
        self.ids[begin : begin + len(ids)] = ids
        for p in new:
            if len(p) > MEMORY_CHARS:
                del known[p]
        known.new = []

    def encode_batch(self, texts: list[str], ends: bool = True) -> list[np.ndarray]:
        """Ids of each text, with begin and end ids if ``ends``."""
        v = self.vocabulary
        if len(self.known) > MEMORY or len(self.ids) > 16 * MEMORY:
            self._forget()
        cut = [v.pre_tokens(v.prepare(t)) for t in texts]
        number = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, sum(map(len, cut)))
        self._learn()
        begin, end = self.at[number], self.at[number + 1]
        to = np.cumsum(end - begin)
        ids = self.ids[np.arange(to[-1] if len(to) else 0) + np.repeat(end - to, end - begin)]
        stops = np.concatenate((np.zeros(1, np.int64), to))[np.cumsum([0, *map(len, cut)])].tolist()
        lead, tail = (np.array([i] if ends else [], "<u4") for i in (v.begin_id, v.end_id))
        return [np.concatenate((lead, ids[a:b], tail)) for a, b in pairwise(stops)]

    def encode(self, text: str, ends: bool = True) -> np.ndarray:
        return self.encode_batch([text], ends)[0]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that form no character become U+FFFD."""
        v = self.vocabulary
        size = v.surface_size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(v.surface_at[ids] - (ends - size), size)
        text = v.surface[at].tobytes().decode("utf-8", "replace")
        if v.dummy_prefix and text.startswith(SPACE):
            text = text[1:]
        return text.replace(SPACE, " ")


@lru_cache(maxsize=1)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


@lru_cache(maxsize=1)
def library(path: str):
    """The library that defines the format."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)
