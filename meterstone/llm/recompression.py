"""Recompression of word sequences: runs and pairs get names, round by round.

A run of one word is named by the word and its length. Then, in each round, a hash
bit sorts the symbols into left and right ones, and a left symbol followed by a
right one becomes one symbol, named by the two. Names are hashes, so the naming is
the same everywhere and needs no table; and as every decision looks at neighbours
only, equal stretches of words get equal symbols inside, away from their ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from meterstone.llm.wordhash import mixed

_U = np.uint64


@dataclass
class Symbols:
    """Symbols of one round: name, the words covered, and the words that decide it."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _runs(words: np.ndarray) -> Symbols:
    n = len(words)
    first = np.ones(n, dtype=bool)
    first[1:] = words[1:] != words[:-1]
    start = np.flatnonzero(first)
    end = np.append(start[1:], n)
    size = end - start
    name = np.where(size > 1, mixed(words[start] + mixed(size.astype(np.uint64))), words[start])
    # The words on either side tell that the run ends there.
    return Symbols(name, start, end, np.maximum(start - 1, 0), np.minimum(end + 1, n))


def _pairs(s: Symbols, turn: int) -> Symbols:
    """One round: left symbols take a right symbol that follows."""
    n = len(s.name)
    right = (mixed(s.name ^ _U(0xC0FFEE * (turn + 1))) & _U(1)).astype(bool)
    joins = np.zeros(n, dtype=bool)
    joins[:-1] = ~right[:-1] & right[1:]
    taken = np.zeros(n, dtype=bool)
    taken[1:] = joins[:-1]
    at = np.flatnonzero(~taken)
    pair = joins[at]
    after = np.minimum(at + 1, n - 1)
    before = np.maximum(at - 1, 0)
    name = np.where(pair, mixed(s.name[at] * _U(3) + mixed(s.name[after] + _U(turn))), s.name[at])
    # What stays alone stays so because of the neighbour that it could have joined.
    alone_right = ~pair & right[at]
    alone_left = ~pair & ~right[at]
    low = np.where(alone_right, np.minimum(s.low[at], s.low[before]), s.low[at])
    high = np.where(pair | alone_left, np.maximum(s.high[at], s.high[after]), s.high[at])
    end = np.where(pair, s.end[after], s.end[at])
    return Symbols(name, s.start[at], end, low, high)


def rounds(words: np.ndarray, n: int) -> Iterator[Symbols]:
    """The words, then their runs, then ``n`` rounds of pairs."""
    at = np.arange(len(words))
    yield Symbols(words, at, at + 1, at, at + 1)
    now = _runs(words)
    yield now
    for turn in range(n):
        now = _pairs(now, turn)
        yield now


def anchors(words: np.ndarray, width: int, n_rounds: int) -> np.ndarray:
    """For every window of ``width`` words, the key of its longest inner symbol.

    A symbol is inner if the window holds all words that decide it; so a window has
    the same key wherever it stands. Ties go to the greater name. The length is the
    first four bits of the key.
    """
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    by_extent = {k: np.zeros(len(words) + 1, dtype=np.uint64) for k in range(1, width + 1)}
    for s in rounds(words, n_rounds):
        extent = s.high - s.low
        fits = extent <= width
        key = (np.minimum(s.end - s.start, 15).astype(np.uint64) << _U(60)) | (s.name >> _U(4))
        for k in np.unique(extent[fits]).tolist():
            of = fits & (extent == k)
            # Low ends may repeat: the greatest key of each is the last after a sort.
            low, keys = s.low[of], key[of]
            order = np.argsort(keys, kind="stable")
            fresh = np.zeros(len(words) + 1, dtype=np.uint64)
            fresh[low[order]] = keys[order]
            np.maximum(by_extent[k], fresh, out=by_extent[k])
    best = np.zeros(n, dtype=np.uint64)
    for k, keys in by_extent.items():
        for shift in range(width - k + 1):
            np.maximum(best, keys[shift : shift + n], out=best)
    return best
