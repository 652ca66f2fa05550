"""Words of many texts as arrays: places, line numbers and 64-bit hashes, without a Python object per word.

A word is a run of bytes other than space and U+0009 to U+000D. Its hash depends on its bytes alone. Words of up to
``SHORT`` bytes are mixed eight bytes at a time, the length first; words of one length of up to eight bytes never
collide. Of longer ones it is a polynomial over a table of random 64-bit numbers, one for each byte, taken from prefix
sums over the buffer and mixed with the length. Two words of one comparison collide with a chance of about one in 2^60.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes whose prefix sums are held at once (nine bytes each); a longer word has its own step.
STEP = 1 << 16
#: Bytes of text that ``slices`` hands out at once; a longer text comes alone.
PART = 1 << 20

#: Words of so many bytes at most are hashed eight bytes at a time.
SHORT = 64

_BASE, _U = 0x9E3779B97F4A7C17, np.uint64
_random = np.random.Generator(np.random.PCG64(42))
_TABLE = _random.integers(0, 1 << 64, 256, dtype=np.uint64)
_FOLDED = _TABLE.copy()
_FOLDED[65:91] = _TABLE[97:123]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The bits of the first bytes of eight, by their number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)
_SIZE = _U(0xC6A4A7935BD1E995)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0 to ``n`` - 1 and their inverses modulo 2^64; tables of up to ``PART`` are remembered."""
    size = next((s for s in (STEP, PART) if n <= s), n)
    if size not in _powers:
        up, down = np.full(size, _BASE, _U), np.full(size, pow(_BASE, -1, 1 << 64), _U)
        up[0] = down[0] = 1
        up, down = np.cumprod(up), np.cumprod(down)
        if size > PART:
            return up, down
        _powers[size] = up, down
    up, down = _powers[size]
    return up[:n], down[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> _U(31))
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> _U(29))


def run_hashes(own: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` consecutive numbers of ``own``; they depend on the run's numbers alone."""
    n = len(own) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    up, _ = powers(width)
    out = np.zeros(n, _U)
    for k in range(width):
        out += own[k : k + n] * up[k]
    return mixed(out + _U(width))


def short_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of the words of up to ``SHORT`` bytes at ``start``; those of longer words mean nothing."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    out = eight[start]
    out &= _FIRST[np.minimum(size, 8)]
    out += size.astype(_U) * _SIZE
    out = mixed(out)
    at, more = 8, np.flatnonzero((size > 8) & (size <= SHORT))
    while len(more):
        out[more] = mixed(out[more] + (eight[start[more] + at] & _FIRST[np.minimum(size[more] - at, 8)]))
        at += 8
        more = more[size[more] > at]
    return out


class Words:
    """The words of consecutive texts in one buffer; ``offsets`` has a bound more than there are texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = False):
        self.data, self.offsets = data, offsets
        table = _FOLDED if fold else _TABLE
        space = (data == 32) | (data - np.uint8(9) < 5)
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(data) and not space[0]:
            edges = np.r_[0, edges]
        if len(data) and not space[-1]:
            edges = np.r_[edges, len(data)]
        self.start, self.stop = edges[::2], edges[1::2]
        inner = np.unique(offsets[(offsets > 0) & (offsets < len(data))])
        inner = inner[~space[inner] & ~space[inner - 1]]
        if len(inner):  # two texts that meet without white space
            self.start, self.stop = (np.insert(x, np.searchsorted(x, inner), inner) for x in (self.start, self.stop))
        size = self.stop - self.start
        self.hash = short_hashes(_LOWER[data] if fold else data, self.start, size)
        long = np.flatnonzero(size > SHORT)
        start, stop = self.start[long], self.stop[long]
        at = 0
        while at < len(long):
            low = int(start[at])
            to = max(at + 1, int(np.searchsorted(stop, low + STEP, side="right")))
            high = int(stop[to - 1])
            up, down = powers(high - low)
            sums = np.zeros(high - low + 1, _U)
            np.cumsum(table[data[low:high]] * up, out=sums[1:])
            a, z = start[at:to] - low, stop[at:to] - low
            self.hash[long[at:to]] = mixed((sums[z] - sums[a]) * down[a] + (z - a).astype(_U))
            at = to
        #: The words of text i are ``bounds[i]`` to ``bounds[i + 1]``.
        self.bounds = np.searchsorted(self.start, offsets)

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """For each word its text, and the number of its line in the text, from 0."""
        breaks = np.flatnonzero(self.data == 10)
        owner = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.bounds))
        before = np.repeat(np.arange(len(breaks) + 1), np.diff(np.r_[0, np.searchsorted(self.start, breaks), len(self.start)]))
        return owner, before - np.searchsorted(breaks, self.offsets[:-1])[owner]

    def joined(self, keep: np.ndarray, text: int) -> bytes:
        """The kept words of a text, joined by one space; ``keep`` has a flag for each of its words."""
        a, z = self.bounds[text], self.bounds[text + 1]
        starts, stops = self.start[a:z][keep], self.stop[a:z][keep]
        if not len(starts):
            return b""
        size = stops - starts
        out = np.full(int(size.sum()) + len(size) - 1, 32, np.uint8)
        to = np.cumsum(size + 1) - (size + 1)
        inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(to, size) + inside] = self.data[np.repeat(starts, size) + inside]
        return out.tobytes()


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary or string array without nulls, and the bounds of its texts in them."""
    if pa.types.is_large_binary(texts.type) or pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(texts: pa.Array, fold: bool = False) -> Iterator[tuple[int, int, Words]]:
    """``(a, z, words)`` for runs of texts of about ``PART`` bytes; a longer text is a run of its own."""
    if not len(texts):
        return
    data, bounds = buffer_of(texts)
    a = 0
    while a < len(texts):
        z = max(a + 1, int(np.searchsorted(bounds, bounds[a] + PART, side="right")) - 1)
        yield a, z, Words(data[bounds[a] : bounds[z]], bounds[a : z + 1] - bounds[a], fold)
        a = z
