"""Anchors: the few places of a sequence at which equal windows are sure to meet.

Of the k-grams inside a window of `length` units (words or bytes) the one with
the least hash, leftmost among equals, is the window's anchor. Equal windows
have equal anchors at equal offsets, so windows need comparing only where they
share an anchor, and about 2 / (length - k + 2) of all places are anchors. The
windows of an anchor are consecutive; together with what they cover they are its
run.
"""

from __future__ import annotations

import numpy as np

from finscope.llm.shared import mixed

_ODD = 0x9E3779B97F4A7C15 | 1
_PLACE = np.uint64(24)
#: Bytes or words handled at a time; fits the bits that hold a place.
PORTION = 1 << 20

#: A 64-bit value for each byte.
BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


class Powers:
    """Powers of an odd number and of its inverse, modulo 2^64."""

    def __init__(self, n: int):
        with np.errstate(over="ignore"):
            inverse = np.uint64(pow(_ODD, -1, 1 << 64))
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(_ODD))]))
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse)]))

    _held: Powers | None = None

    @classmethod
    def of(cls, n: int) -> Powers:
        """The powers kept by this process reach as far as a portion does; more are made anew, and not kept."""
        if n > PORTION + (PORTION >> 3):
            return cls(n)
        if cls._held is None:
            cls._held = cls(PORTION + (PORTION >> 3))
        return cls._held


def sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values times powers; `span` turns them into hashes of stretches."""
    p = Powers.of(len(values))
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(0)], np.cumsum(values * p.up[: len(values)])])


def span(s: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice, at: np.ndarray | slice) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (s[end] - s[start]) * Powers.of(len(s)).down[at]


def grams(values: np.ndarray, k: int) -> np.ndarray:
    """A mixed hash of each k consecutive values."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    s = sums(values)
    return mixed(span(s, slice(0, n), slice(k, k + n), slice(0, n)))


def runs(h: np.ndarray, ends: np.ndarray, k: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor) of each run.

    h: hashes of the k-grams of one or more sequences set end to end; ends: for
    each place, where its sequence ends.
    """
    w = length - k + 1
    n = len(h) - w + 1  # windows
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    keyed = (h >> _PLACE << _PLACE) | np.arange(len(h), dtype=np.uint64)
    padded = np.full(-(-len(h) // w) * w, np.iinfo(np.uint64).max)
    padded[: len(h)] = keyed
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(back[:n], ahead[w - 1 : w - 1 + n]) & np.uint64((1 << 24) - 1)).astype(np.int64)
    inside = np.arange(length, length + n) <= ends[:n]
    first = inside.copy()
    first[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    last = inside.copy()
    last[:-1] &= (anchor[1:] != anchor[:-1]) | ~inside[1:]
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    return a, b - a + 1, anchor[a]


def covered(starts, counts, length: int, n: int) -> np.ndarray:
    """True for each of n units inside a window; windows start at starts, ..., starts + counts - 1."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(np.asarray(starts) + np.asarray(counts) - 1 + length, n), -1)
    return np.cumsum(change[:n]) > 0
