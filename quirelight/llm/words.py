"""Vectorised word hashing: whole blocks of texts become arrays of word boundaries and hashes, without a Python object per word."""

from __future__ import annotations

import numpy as np

M64 = np.uint64
#: Words of more bytes are hashed one by one.
LONG = 1 << 10


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, n, dtype=np.uint64) | M64(1)


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, other bytes unchanged.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: What tells apart the two hash functions, and a step between the places of a word's lanes.
_SEED = {0: 0x9E3779B97F4A7C15, 1: 0xD1342543DE82EF95}
_LANE = M64(0xA0761D6478BD642F)
#: What keeps the first bytes of a lane of 8, by their number.
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Multipliers of the places in a window, by hash function.
_PLACE = {0: _odd(21, 64), 1: _odd(22, 64)}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> M64(33))) * M64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> M64(33))) * M64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> M64(33))


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of each word [^ \\t-\\r]+ of a byte array."""
    space = np.concatenate([[True], IS_SPACE[buf], [True]])
    turn = np.flatnonzero(space[1:] != space[:-1])
    return turn[0::2], turn[1::2]


def _lanes(lanes: np.ndarray, first: int, which: int) -> np.ndarray:
    """Lanes of 8 bytes, each mixed with its place in its word: equal lanes at other places have nothing in common."""
    with np.errstate(over="ignore"):
        return mix(lanes + mix((np.arange(len(lanes), dtype=np.uint64) + M64(first)) * _LANE + M64(_SEED[which])))


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; which selects one of two independent functions.

    A word is the sum of its mixed lanes, mixed again with its length. A word of up to 8 bytes is one lane, so of one length no two clash.
    """
    size = end - start
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    at = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))
    out = np.zeros(len(start), np.uint64)
    with np.errstate(over="ignore"):
        todo, k = np.arange(len(start)), 0
        while len(todo):
            lane = at[start[todo] + 8 * k] & _HEAD[np.minimum(size[todo] - 8 * k, 8)]
            out[todo] += mix(lane + mix(M64(k) * _LANE + M64(_SEED[which])))
            k += 1
            todo = todo[(size[todo] > 8 * k) & (size[todo] <= LONG)]
        for i in np.flatnonzero(size > LONG).tolist():
            lanes = np.concatenate([buf[start[i] : end[i]], np.zeros(-size[i] % 8, np.uint8)]).view("<u8")
            out[i] = _lanes(lanes, 0, which).sum(dtype=np.uint64)
        return mix(out + size.astype(np.uint64) * _LANE)


def windows(h: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Hash of each run of width consecutive word hashes (across documents too: the caller masks those)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = h[:n] * _PLACE[which][0]
        for k in range(1, width):
            out += h[k : n + k] * _PLACE[which][k]
    return mix(out)


class Words:
    """The words of a block of texts: byte bounds, document of each, first word and number of words of each document."""

    def __init__(self, texts: list[bytes], fold: bool = False):
        lens = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.raw = buf
        self.buf = FOLD[buf] if fold else buf
        self.start, self.end = word_bounds(self.buf)
        stops = np.cumsum(lens)
        first = np.searchsorted(self.start, np.concatenate([[0], stops]))
        self.first, self.count = first[:-1], np.diff(first)
        self.doc = np.repeat(np.arange(len(texts)), self.count)

    def hashes(self, which: int = 0) -> np.ndarray:
        return word_hashes(self.buf, self.start, self.end, which)

    def places(self) -> np.ndarray:
        """Place of each word in its document, from 0."""
        return np.arange(len(self.doc)) - self.first[self.doc]

    def whole(self, width: int) -> np.ndarray:
        """For each start of windows(): whether the window stays in one document."""
        n = max(0, len(self.doc) - width + 1)
        return self.doc[:n] == self.doc[width - 1 : width - 1 + n]
