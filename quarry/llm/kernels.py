"""Vectorised text kernels over Arrow string buffers.

All of them work on the UTF-8 bytes of a whole batch at once.  ASCII case folding and the word
classes only look at bytes below 0x80, and UTF-8 never uses those inside a longer sequence, so byte
runs are exactly the runs the patterns describe.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)


def _class(pattern: str) -> np.ndarray:
    """256 flags: bytes that belong to a word."""
    flags = np.ones(256, bool)
    if pattern == "space":
        flags[[0x20, *range(0x09, 0x0E)]] = False
    else:
        flags[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False
        flags[0x41:0x5B] = True  # folded to lower case first
    return flags


SPACE_WORDS, ALNUM_WORDS = _class("space"), _class("alnum")

_values = np.random.RandomState(20240607).randint(1, 2**63 - 1, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_folded = _values.copy()
_folded[0x41:0x5B] = _values[0x61:0x7B]

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for key, base in (("up", _BASE), ("down", _INV)):
            steps = np.full(size, base & (2**64 - 1), _U)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, on a copy."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@dataclass
class Words:
    """Words of a batch: byte ranges in ``data``, and for each text the range of its words."""

    data: np.ndarray
    texts: np.ndarray  # byte offsets, one more than texts
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # word offsets, one more than texts

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(column: pa.Array, flags: np.ndarray = SPACE_WORDS) -> Words:
    data, texts = buffers(column)
    inside = flags[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = texts[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, texts, start, end, np.searchsorted(start, texts))


def word_hashes(w: Words, fold: bool = True) -> np.ndarray:
    """64-bit hash of each word's bytes, A-Z folded on request."""
    if not len(w.start):
        return np.zeros(0, _U)
    up, down = _power(len(w.data))
    sums = np.empty(len(w.data) + 1, _U)
    sums[0] = 0
    np.cumsum((_folded if fold else _values)[w.data] * up, out=sums[1:])
    first = np.minimum(w.start, len(w.data) - 1)  # an empty word may stand at the end
    return mix((sums[w.end] - sums[w.start]) * down[first] + (w.end - w.start).astype(_U))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words, document borders not regarded; len(h) - n + 1 of them."""
    count = len(h) - n + 1
    if count <= 0:
        return np.zeros(0, _U)
    x = h[:count].copy()
    for k in range(1, n):
        x *= _U(0xD6E8FEB86659FD93)
        x += h[k : k + count]
        x ^= x >> _U(32)
    return mix(x + _U(n))
