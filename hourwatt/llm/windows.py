"""Hashes and anchors of fixed-length windows, for whole batches at once.

An anchor is the leftmost least-hashed short piece inside a window. Equal windows have equal anchors at equal
places, so a window can repeat only if its anchor does; anchors are a small share of all positions. Consecutive windows
with one anchor form a context, the stretch of symbols that they cover together.
"""

from __future__ import annotations

import functools
from typing import NamedTuple

import numpy as np

# Odd multipliers of the rolling hashes and the constants of the 64-bit finaliser.
MULTIPLIERS = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
BYTE_CODES = np.random.default_rng(20_11).integers(1, 2**63, 256, dtype=np.uint64)
SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])


class Contexts(NamedTuple):
    """One entry per anchor: first window, number of windows, anchor place, anchor hash, context hash."""

    first: np.ndarray
    count: np.ndarray
    place: np.ndarray
    anchor: np.ndarray
    context: np.ndarray


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=4)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _room(n: int) -> int:
    """Table sizes go up by quarters of a power of two, so that few of them are made."""
    step = max(1024, (1 << max(n - 1, 1).bit_length()) // 4)
    return -(-(n + 1) // step) * step


class Rolling:
    """Prefix sums from which the hash of any stretch of symbols follows."""

    def __init__(self, codes: np.ndarray, multiplier: int):
        room = _room(len(codes) + 1)
        self.back = _powers(pow(multiplier, -1, 2**64), room)
        self.sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(codes * _powers(multiplier, room)[: len(codes)], out=self.sums[1:])

    def of(self, start, stop) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.back[start])

    def every(self, length: int) -> np.ndarray:
        """Hashes of all stretches of one length, by their starts."""
        n = len(self.sums) - length
        if n <= 0:
            return np.empty(0, dtype=np.uint64)
        return mixed((self.sums[length:] - self.sums[:n]) * self.back[:n])


def word_codes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start bytes, hashes) of the words between white-space bytes; data ends with white space."""
    inside = ~SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside)).astype(np.int8)))
    starts, stops = edges[0::2], edges[1::2]
    return starts, Rolling(BYTE_CODES[data], MULTIPLIERS[0]).of(starts, stops)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by the first of them."""
    n = len(values) - width + 1
    padded = np.concatenate([values, np.full(-len(values) % width, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def contexts(rolling: Rolling, bounds: np.ndarray, window: int, piece: int) -> Contexts:
    """Contexts of all windows inside the documents that ``bounds`` (their first symbols, and the end) delimits."""
    sizes = np.diff(bounds)
    pieces, width = rolling.every(piece), window - piece + 1
    if len(pieces) < width or not (sizes >= window).any():
        none = np.empty(0, np.int64)
        return Contexts(none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    least = _least(pieces, width)
    reach = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    top = ~_least(~reach, width)  # the largest of the minima of the windows around each piece
    marks = np.flatnonzero(top == pieces)
    inside = sizes >= window
    starts, counts = bounds[:-1][inside], sizes[inside] - window + 1
    total = np.cumsum(counts)
    windows = np.arange(total[-1]) + np.repeat(starts - (total - counts), counts)
    at = np.searchsorted(marks, windows)
    value, open_to = least[windows], np.arange(len(windows))
    while len(open_to := open_to[pieces[marks[at[open_to]]] != value[open_to]]):
        at[open_to] += 1
    place = marks[at]
    new = np.ones(len(windows), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (windows[1:] != windows[:-1] + 1)
    heads = np.flatnonzero(new)
    count = np.diff(np.concatenate([heads, [len(windows)]]))
    first, anchor_at = windows[heads], place[heads]
    shape = (count.astype(np.uint64) << np.uint64(32)) ^ (anchor_at - first).astype(np.uint64)
    return Contexts(first, count, anchor_at, pieces[anchor_at], mixed(rolling.of(first, first + count - 1 + window) ^ mixed(shape)))


def covered(length: int, starts, counts, window: int) -> np.ndarray:
    """Which of ``length`` symbols lie in a window of the runs (start, number of windows)."""
    change = np.zeros(length + 1, dtype=np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, np.asarray(starts) + np.asarray(counts) - 1 + window, -1)
    return np.cumsum(change[:-1]) > 0


def batches_of(sizes, limit: int):
    """Slices of consecutive items whose sizes add up to about ``limit``."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        total += size
        if total >= limit:
            yield slice(start, i + 1)
            start, total = i + 1, 0
    if start < len(sizes):
        yield slice(start, len(sizes))
