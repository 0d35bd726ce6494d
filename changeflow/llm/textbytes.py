"""Vectorised views of a batch of texts as UTF-8 bytes: words, lines, rolling hashes.

A word is a run of bytes other than space and ``\\t`` to ``\\r``; those bytes never occur inside a
longer UTF-8 character, so words of bytes are words of characters. All hashes are 64-bit, seeded
and the same on every machine.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240611)
BYTE_HASH = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
WINDOW = np.uint64(0xC2B2AE3D27D4EB4F)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CONTINUES = np.zeros(256, bool)
CONTINUES[0x80:0xC0] = True


def slices(texts, limit: int = 2_000_000):
    """Parts of a batch with at most so many characters together, or one longer text."""
    begin, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > begin and total + n > limit:
            yield texts[begin:i]
            begin, total = i, 0
        total += n
    if len(texts):
        yield texts[begin:]


def frames(batch):
    """Parts of a pandas batch with a ``text`` column, as ``slices`` cuts it."""
    begin = 0
    for part in slices(batch.text.tolist()):
        yield batch.iloc[begin : begin + len(part)]
        begin += len(part)


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values; a bijection."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def powers(n: int) -> np.ndarray:
    """BASE ** 0 .. n - 1 modulo 2 ** 64."""
    out = np.full(n, BASE, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Batch:
    """The bytes of several texts, each followed by a newline that belongs to none of them.

    ``bounds[d]`` is where text ``d`` begins; it ends one before ``bounds[d + 1]``.
    """

    def __init__(self, texts):
        raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        self.sizes = np.array([len(b) for b in raw], np.int64)
        self.bounds = np.concatenate(([0], np.cumsum(self.sizes + 1)))
        self.data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8) if raw else np.empty(0, np.uint8)

    def __len__(self) -> int:
        return len(self.sizes)

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sum of a value a byte for each text."""
        total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
        return total[self.bounds[1:]] - total[self.bounds[:-1]]

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each run of bytes for which ``inside`` holds."""
        edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
        return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)

    def hashes(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash for each run; runs neither overlap nor are empty."""
        if not len(begin):
            return np.empty(0, np.uint64)
        length = end - begin
        first = np.cumsum(length) - length
        within = np.arange(int(length.sum())) - np.repeat(first, length)
        at = within + np.repeat(begin, length)
        values = BYTE_HASH[data[at]] * powers(int(length.max()))[within]
        return mix(np.add.reduceat(values, first) + length.astype(np.uint64))

    def text_of(self, at: np.ndarray) -> np.ndarray:
        """Number of the text that holds each byte position."""
        return np.searchsorted(self.bounds, at, side="right") - 1


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs more than once."""
    order = np.argsort(keys)
    s = keys[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:]] = same
    out[order[:-1]] |= same
    return out


def repeats_earlier(keys: np.ndarray) -> np.ndarray:
    """True where a key has occurred before."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    out = np.zeros(len(keys), bool)
    out[order[1:]] = s[1:] == s[:-1]
    return out


def covered(size: int, starts: np.ndarray, length: int) -> np.ndarray:
    """True for the positions inside windows of one length that begin at ``starts``."""
    edge = np.zeros(size + 1, np.int64)
    edge[starts] += 1
    edge[starts + length] -= 1
    return np.cumsum(edge[:-1]) > 0
