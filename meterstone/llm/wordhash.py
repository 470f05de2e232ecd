"""Words of many texts at once, as 64-bit hashes, with numpy.

A batch of texts is one run of bytes. Word borders come from comparing bytes, word
hashes from running sums of a polynomial, so nothing is done word by word in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text taken together; a longer text is taken alone.
CHUNK_BYTES = 1 << 21

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[0x41:0x5B] += _U(32)
_SAME = np.arange(256, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all others."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Powers:
    """Powers of the base and of its inverse, grown as needed."""

    up = powers(_BASE, 1)
    down = powers(_INVERSE, 1)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = powers(_BASE, n), powers(_INVERSE, n)
        return cls.up, cls.down


@dataclass
class Words:
    """Words of ``n_texts`` texts, in order: text number, byte range, hash."""

    n_texts: int
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    def firsts(self) -> np.ndarray:
        """The first word of each text, and the number of words at the end."""
        return np.searchsorted(self.text, np.arange(self.n_texts + 1))


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool) -> Words:
    """Words of the texts in ``data``, which ``offsets`` delimits; ``lower``: A-Z as a-z."""
    n = len(data)
    solid = np.zeros(n + 2, dtype=bool)
    solid[1:-1] = ~_BLANK[data]
    starts_text = np.zeros(n + 1, dtype=bool)
    starts_text[offsets[:-1]] = True
    start = np.flatnonzero(solid[1:-1] & (~solid[:-2] | starts_text[:-1]))
    end = np.flatnonzero(solid[1:-1] & (~solid[2:] | np.append(starts_text[1:n], True)[:n])) + 1
    up, down = _Powers.get(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(((_LOWER if lower else _SAME)[data] + _U(1)) * up[:n], out=sums[1:])
    h = (sums[end] - sums[start]) * down[start]
    text = np.searchsorted(offsets, start, side="right") - 1
    return Words(len(offsets) - 1, text, start, end, mixed(h ^ (end - start).astype(np.uint64)))


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut a binary array into runs: first row, bytes, offsets. NULL counts as empty."""
    if texts.null_count:
        texts = texts.fill_null(b"")
    wide = pa.types.is_large_binary(texts.type)
    raw = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = raw[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(texts):
        stop = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        stop = min(max(stop, row + 1), len(texts))
        yield row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def rolled(hashes: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of ``width`` consecutive values starting at each; shorter by ``width - 1``."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    step = mixed(np.array([0xD6E8FEB86659FD93 + 2 * seed], dtype=np.uint64))[0] | _U(1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = out * step + hashes[k : k + n]
    return mixed(out)
