"""Words of whole Arrow batches as numpy arrays: positions and 64-bit hashes, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S29, _S32 = np.uint64(29), np.uint64(32)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S32)) * _A
    h = (h ^ (h >> _S29)) * _B
    return h ^ (h >> _S32)


def raw(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


@dataclass
class Words:
    """Words of the documents first..first+len(offsets)-2 of a batch; offsets: of each document's words. start and end are byte positions in data."""

    first: int
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    data: np.ndarray

    @property
    def docs(self) -> int:
        return len(self.offsets) - 1

    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)


def hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges. data must have 8 bytes more than are used."""
    size = end - start
    out = mixed(size.astype(np.uint64) + _B)
    if not len(start):
        return out
    eight = np.ndarray((len(data) - 7,), np.dtype("<u8"), buffer=data.data, strides=(1,))
    todo, step = np.arange(len(start)), 0
    while len(todo):
        left = size[todo] - 8 * step
        part = eight[start[todo] + 8 * step] & _MASK[np.minimum(left, 8)]
        out[todo] = mixed(out[todo] * _A + part)
        todo, step = todo[left > 8], step + 1
    return out


def words(column, lower: bool = False, most: int = 1 << 22) -> Iterator[Words]:
    """The column's documents in order, some at a time: about `most` bytes, or one longer document."""
    data, at = raw(column)
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        last = min(last, n)
        part = np.concatenate([data[at[first] : at[last]], np.full(8, 32, np.uint8)])
        if lower:
            part = _LOWER[part]
        solid = ~_SPACE[part]
        bounds = at[first : last + 1] - at[first]
        begins, ends = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        ends[:-1] &= ~solid[1:]
        inner = bounds[1:-1]
        inner = inner[(inner > 0) & (inner < len(part))]
        begins[inner] = solid[inner]
        ends[inner - 1] = solid[inner - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        yield Words(first, np.searchsorted(start, bounds), start, end, hashed(part, start, end), part)
        first = last


def shingles(w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of `width` consecutive words, sorted within each document, and their offsets. A document with fewer words has one, of all its words."""
    h = w.hashes
    run = h.copy()
    for k in range(1, width):
        run[:-k] = mixed(run[:-k] * _A + h[k:]) if k < len(h) else run[:-k]
    sets, sizes = [], np.zeros(w.docs, np.int64)
    for d in range(w.docs):
        a, b = w.offsets[d], w.offsets[d + 1]
        if b - a >= width:
            s = np.sort(run[a : b - width + 1])
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif b > a:
            s = mixed(np.array([b - a], np.uint64))
            for k in range(a, b):
                s = mixed(s * _A + h[k])
        else:
            continue
        sets.append(s)
        sizes[d] = len(s)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])
