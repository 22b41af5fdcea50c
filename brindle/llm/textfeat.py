"""Vectorised word and n-gram hashing over Arrow text buffers.

A piece is a run of texts laid end to end, one separator byte after each.
Every array below is indexed by byte or by word of the piece, so the cost
per text is a few numpy passes and no Python loop over words.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np

#: The white space of every contract: space and the bytes 0x09 to 0x0D.
WS = np.zeros(256, bool)
WS[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
RAND = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64)


@functools.cache
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    b, inv = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
    with np.errstate(over="ignore"):
        up, down = np.full(size, b, np.uint64), np.full(size, inv, np.uint64)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, int(n).bit_length())
    up, down = _powers(int(base), size)
    return up[:n], down[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Murmur's 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Rolling:
    """Hashes of any slices of a sequence of 64-bit values, by prefix sums."""

    def __init__(self, values: np.ndarray, base: np.uint64 = _P):
        n = len(values)
        up, self.down = powers(base, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def windows(self, n: int) -> np.ndarray:
        """Of every window of n values, by its first."""
        if len(self.sums) <= n:
            return np.zeros(0, np.uint64)
        return mix((self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n])


#: Bytes hashed at once: bounds the scratch arrays of eight bytes a byte.
HASH_BYTES = 1 << 20


def hash_slices(data: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64 = _P) -> np.ndarray:
    """``Rolling(RAND[data]).of(start, end)`` with prefix sums kept only where slices begin or end."""
    if len(data) <= HASH_BYTES:
        return Rolling(RAND[data], base).of(start, end)
    places = {"start": start, "end": end}
    picked = {k: np.zeros(len(v), np.uint64) for k, v in places.items()}
    scale = np.zeros(len(start), np.uint64)
    order = {k: np.argsort(v, kind="stable") for k, v in places.items()}
    up, inverse = powers(base, HASH_BYTES + 1)
    total, lift, drop = np.uint64(0), 1, 1
    for a in range(0, len(data) + 1, HASH_BYTES):
        part = RAND[data[a : a + HASH_BYTES]] * up[: min(HASH_BYTES, len(data) - a)]
        run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part, dtype=np.uint64))) * np.uint64(lift) + total
        for k, v in places.items():
            lo, hi = np.searchsorted(v, [a, a + HASH_BYTES], sorter=order[k])
            who = order[k][lo:hi]
            picked[k][who] = run[v[who] - a]
            if k == "start":
                scale[who] = inverse[v[who] - a] * np.uint64(drop)
        total = run[-1]
        lift = lift * pow(int(base), HASH_BYTES, 1 << 64) % (1 << 64)
        drop = drop * pow(pow(int(base), -1, 1 << 64), HASH_BYTES, 1 << 64) % (1 << 64)
    return mix((picked["end"] - picked["start"]) * scale)


def long_parts(raw: np.ndarray, start: int, stop: int, size: int, back: int = 0) -> Iterator[tuple[int, int]]:
    """Ranges of a long text of about ``size`` bytes that end before white space; each takes along the last ``back``
    words before it, so windows of back + 1 words lie in one range each.
    """
    at = lead = start
    while True:
        end = stop
        for p in range(at + size, stop, 1 << 16):
            found = np.flatnonzero(WS[raw[p : min(p + (1 << 16), stop)]])
            if len(found):
                end = p + int(found[0])
                break
        yield lead, end
        if end >= stop:
            return
        at = lead = end
        reach = 1 << 12
        while back:
            a = max(start, end - reach)
            space = WS[raw[a:end]]
            begins = np.flatnonzero(space[:-1] & ~space[1:]) + 1
            if len(begins) >= back or a == start:
                lead = a + int(begins[-back]) if len(begins) >= back else start
                break
            reach *= 4


class Piece:
    """Texts laid end to end; ``start`` and ``end`` are those of the texts, ``ws``/``we`` those of the words."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, lower: bool = False):
        self.n = len(off) - 1
        self.data = np.insert(raw[off[0] : off[-1]], off[1:] - off[0], 10)
        if lower:
            self.data = lowered(self.data)
        self.start = off[:-1] - off[0] + np.arange(self.n)
        self.end = off[1:] - off[0] + np.arange(self.n)
        space = WS[self.data]
        self.space = space
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            edge = np.concatenate(([0], edge))
        self.ws, self.we = edge[0::2], edge[1::2]
        first = np.searchsorted(self.ws, self.start)
        self.first = np.append(first, len(self.ws))
        self.words = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n), self.words)

    @functools.cached_property
    def bytes_hash(self) -> Rolling:
        """Of a piece of ordinary size; what is longer is hashed in parts."""
        return Rolling(RAND[self.data])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges."""
        return hash_slices(self.data, start, end) if len(self.data) > 2 * HASH_BYTES else self.bytes_hash.of(start, end)

    @functools.cached_property
    def word_hash(self) -> np.ndarray:
        return self.slices(self.ws, self.we)

    def char_parts(self, n: int) -> Iterator[np.ndarray]:
        """Hashes of the n-byte windows of a piece that is one text, by parts."""
        size = int(self.end[0] - self.start[0])
        for a in range(0, max(0, size - n + 1), HASH_BYTES):
            yield Rolling(RAND[self.data[a : min(size, a + HASH_BYTES + n - 1)]]).windows(n)

    def char_grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-byte windows inside single texts, and their number by text."""
        sizes = np.maximum(self.end - self.start - n + 1, 0)
        h = self.bytes_hash.windows(n)
        keep = np.ones(len(self.data), bool)
        for k in range(n):
            keep[np.maximum(self.end - k, self.start)] = False
        keep[self.end] = False
        return h[keep[: len(h)]], sizes

    def word_grams(self, n: int, skip: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of n words in a row (with skip: of two words with so many between), their texts, and number by text."""
        span = n + skip
        sizes = np.maximum(self.words - span + 1, 0)
        w = self.word_hash
        if n == 1:
            return w, self.doc, sizes
        if len(w) < span:
            return w[:0], self.doc[:0], sizes
        same = self.doc[span - 1 :] == self.doc[: len(w) - span + 1]
        if skip:
            h = mix(w[: len(w) - span + 1] * _P + w[span - 1 :] * _Q + np.uint64(skip))
        else:
            h = Rolling(w, _Q).windows(n)
        return h[same], self.doc[: len(w) - span + 1][same], sizes

    def total(self, values: np.ndarray) -> np.ndarray:
        """Sum of a value of each byte over each text."""
        c = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values, out=c[1:])
        return c[self.end] - c[self.start]


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the Latin-1 letters in UTF-8."""
    low = LOWER[data]
    at = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) else np.zeros(0, int)
    if len(at):
        b = low[at]
        up = (b >= 0x80) & (b <= 0x9E) & (b != 0x97)
        low[at[up]] = b[up] + 0x20
    return low


def segment_sum(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of the given sizes; 0 for an empty run."""
    out = np.zeros((len(sizes), *values.shape[1:]), np.float64)
    full = np.flatnonzero(sizes)
    if len(full):
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))[full]
        out[full] = np.add.reduceat(values, starts, axis=0, dtype=np.float64)
    return out
