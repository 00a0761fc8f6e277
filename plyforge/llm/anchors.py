"""Runs of windows that share an anchor, in numpy: equal windows have equal anchors at equal places.

A window of ``window`` tokens is anchored at the one of its k-token pieces whose hash is the least (the
first of equals). Which one this is depends on the window's own tokens alone, so that equal windows are
anchored alike, wherever they stand. Neighbouring windows mostly share their anchor; a run is a longest
series that does. Repeats can then be sought among runs, of which there are about 2 / (window - k + 2)
per token, instead of among all windows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import xxhash

U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_SEED = 0xC0FFEE
BYTES, OTHER_BYTES = np.random.default_rng(_SEED).integers(0, 2**64, (2, 256), dtype=U)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
INDEX_BITS = 24
BLOCK = 1 << 20  # tokens or bytes hashed at a time
LONG_WORD = 4096

_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers, in place."""
    t = x >> U(30)
    x ^= t
    x *= U(0xBF58476D1CE4E5B9)
    np.right_shift(x, U(27), out=t)
    x ^= t
    x *= U(0x94D049BB133111EB)
    np.right_shift(x, U(31), out=t)
    x ^= t
    return x


def _upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_ODD, pow(_ODD, -1, 2**64))):
            p = np.full(size, base, U)
            p[0] = 1
            _powers[i] = np.cumprod(p)
    return _powers[0], _powers[1]


_counted: list[np.ndarray] = [np.empty(0, U)]


def _numbers(n: int) -> np.ndarray:
    if len(_counted[0]) < n:
        _counted[0] = np.arange(1 << (n - 1).bit_length(), dtype=U)
    return _counted[0][:n]


class Rolling:
    """Hashes of any stretch of an array of token hashes, from one pass over it."""

    def __init__(self, values: np.ndarray) -> None:
        power, self.back = _upto(len(values) + 1)
        self.sums = np.empty(len(values) + 1, U)
        self.sums[0] = 0
        np.multiply(values, power[:len(values)], out=self.sums[1:])
        np.cumsum(self.sums[1:], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = self.sums[end] - self.sums[start]
        out *= self.back[start]
        return mix(out)

    def every(self, k: int) -> np.ndarray:
        """Of each piece of k tokens."""
        n = len(self.sums) - k
        out = self.sums[k:] - self.sums[:n]
        out *= self.back[:n]
        return mix(out)


def least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by doubling, in place."""
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:], out=x[:-size])
        size *= 2
    rest = w - size
    return np.minimum(x[:len(x) - rest], x[rest:]) if rest else x


class Runs(NamedTuple):
    """Per run: its first window, how many windows it has, the place and hash of its anchor, and the
    hash of all its tokens."""

    first: np.ndarray
    windows: np.ndarray
    place: np.ndarray
    anchor: np.ndarray
    whole: np.ndarray


def _runs(values: np.ndarray, window: int, k: int, sizes: np.ndarray) -> Runs:
    rolling = Rolling(values)
    pieces = rolling.every(k)
    mask = U((1 << INDEX_BITS) - 1)
    # The place in the low bits makes the first of equals the least.
    order = pieces & ~mask
    order |= _numbers(len(pieces))
    m = least(order, window - k + 1)
    ends = np.cumsum(sizes)
    valid = np.zeros(len(m) + 1, np.int8)
    whole = sizes >= window
    np.add.at(valid, (ends - sizes)[whole], 1)
    np.add.at(valid, (ends - window + 1)[whole], -1)
    valid = np.cumsum(valid[:-1], dtype=np.int8).astype(bool)
    edge = np.concatenate(([True], m[1:] != m[:-1]))
    edge[1:] |= valid[1:] != valid[:-1]
    edge[(ends - sizes)[whole]] = True
    first = np.flatnonzero(edge)
    windows = np.diff(np.append(first, len(m)))
    first, windows = first[valid[first]], windows[valid[first]]
    place = (m[first] & mask).astype(np.int64)
    tokens = rolling.of(first, first + windows + window - 1)
    # The least hashes have small values: mixed again, anchors are spread evenly.
    return Runs(first, windows, place, mix(pieces[place]), mix(tokens + windows.astype(U)))


def runs(values: np.ndarray, window: int, k: int, sizes: np.ndarray | None = None) -> Runs:
    """The runs of an array of token hashes; none where it is shorter than a window. ``sizes`` divides the
    array into texts whose windows do not reach into the next. A very long text is cut into blocks that
    overlap by a window less one token; a run ends with its block."""
    if sizes is not None and len(sizes) != 1:
        sizes = np.asarray(sizes, np.int64)
        if len(values) < window or not (sizes >= window).any():
            return runs(values[:0], window, k)
        if len(values) > BLOCK + window:
            raise ValueError("several texts of more than a block together")
        return _runs(values, window, k, sizes)
    total = len(values) - window + 1
    parts = []
    for at in range(0, max(total, 0), BLOCK):
        piece = values[at:at + BLOCK + window - 1]
        r = _runs(piece, window, k, np.array([len(piece)]))
        parts.append(r._replace(first=r.first + at, place=r.place + at))
    if not parts:
        none = np.empty(0, np.int64)
        return Runs(none, none, none, np.empty(0, U), np.empty(0, U))
    return parts[0] if len(parts) == 1 else Runs(*(np.concatenate(x) for x in zip(*parts)))


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text, runs of anything but ASCII white space."""
    inside = ~SPACE[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    return edge[::2], edge[1::2]


def word_hashes(data: bytes) -> np.ndarray:
    """A hash for each word of a text."""
    starts, ends = word_bounds(data)
    out = np.empty(len(starts), U)
    raw = np.frombuffer(data, np.uint8)
    short = ends - starts <= LONG_WORD
    for i in np.flatnonzero(~short).tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i]:ends[i]], _SEED)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + BLOCK)))
        here = np.arange(a, b)[short[a:b]]
        if len(here):
            low = int(starts[here[0]])
            rolling = Rolling(BYTES[raw[low:int(ends[here[-1]])]])
            out[here] = rolling.of(starts[here] - low, ends[here] - low)
        a = b
    return out


def byte_hashes(data: bytes, which: int = 0) -> np.ndarray:
    """A number for each byte, from one of two tables that have nothing to do with each other."""
    return (OTHER_BYTES if which else BYTES)[np.frombuffer(data, np.uint8)]
