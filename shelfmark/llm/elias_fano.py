"""Elias-Fano coded monotone sequences in flat arrays, read in place and queried many values at a time."""

from __future__ import annotations

import numpy as np

_EVERY = 64
_ONE = np.uint64(1)
_BYTES, _TOPS, _S3 = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080), np.uint64(3)
#: Position of the k-th one of byte b, at 8 * b + k.
_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [8] * 8)[k] for b in range(256) for k in range(8)], np.int64)


class Bits:
    """A bit vector with select of ones and of zeros."""

    def __init__(self, words: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.words, self.samples = words, (zeros, ones)

    @staticmethod
    def arrays(bits: np.ndarray) -> list[np.ndarray]:
        """words, and the positions of every 64th one and zero."""
        padded = np.concatenate([bits.astype(np.uint8), np.zeros(64 + -len(bits) % 64, np.uint8)])
        return [np.packbits(padded, bitorder="little").view(np.uint64), *(np.flatnonzero(padded == b)[::_EVERY].astype(np.uint32 if len(padded) < 1 << 32 else np.int64) for b in (1, 0))]

    def select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """Position of the k-th (from 0) such bit."""
        start = self.samples[bit][k // _EVERY].astype(np.int64)
        word, left = start >> 6, k % _EVERY
        flip = np.uint64(0 if bit else 2**64 - 1)
        now = (self.words[word] ^ flip) & ~((_ONE << (start & 63).astype(np.uint64)) - _ONE)
        todo = np.arange(len(k))
        while len(todo):
            n = np.bitwise_count(now[todo]).astype(np.int64)
            todo, n = todo[left[todo] >= n], n[left[todo] >= n]
            left[todo] -= n
            word[todo] += 1
            now[todo] = self.words[word[todo]] ^ flip
        upto = np.bitwise_count(now.view(np.uint8)).view(np.uint64) * _BYTES  # byte by byte, the ones up to its end
        want = left.astype(np.uint64)
        shift = np.bitwise_count(((want * _BYTES | _TOPS) - upto) & _TOPS).astype(np.uint64) << _S3  # of the first byte with more
        want -= ((upto << np.uint64(8)) >> shift) & np.uint64(255)
        return (word << 6) + shift.astype(np.int64) + _IN_BYTE[((((now >> shift) & np.uint64(255)) << _S3) | want).astype(np.int64)]

    def run(self, at: np.ndarray, bit: int = 1) -> np.ndarray:
        """Number of such bits from a position up to the next other one, which must be there."""
        word, off = at >> 6, at & 63
        flip = np.uint64(2**64 - 1 if bit else 0)
        out, todo = np.zeros(len(at), np.int64), np.arange(len(at))
        while len(todo):
            rest = (self.words[word] ^ flip) >> off.astype(np.uint64)
            n = np.bitwise_count((rest & (~rest + _ONE)) - _ONE).astype(np.int64)
            out[todo] += np.minimum(n, 64 - off)
            on = rest == 0
            todo, word = todo[on], word[on] + 1
            off = np.zeros(len(todo), np.int64)
        return out


class EliasFano:
    """A sequence of n values below 2**64 that never falls; low bits packed, high parts in unary."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, bits: Bits):
        self.n, self.low_bits, self.low, self.bits = n, low_bits, low, bits

    @staticmethod
    def arrays(values: np.ndarray, more: int = 0) -> list[np.ndarray]:
        """more: low bits beyond what even steps need, so that long steps of uneven ones are no long walks."""
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1 + more)
        high = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros((int(high[-1]) if n else 0) + 2, bool)
        unary[high] = True
        digits = np.zeros(n * low_bits, np.uint8)
        for b in range(low_bits):
            digits[b::low_bits] = (values >> np.uint64(b)).astype(np.uint8) & 1
        packed = np.packbits(np.concatenate([digits, np.zeros(128 + -len(digits) % 64, np.uint8)]), bitorder="little").view(np.uint64)
        return [np.array([n, low_bits], np.int64), packed, *Bits.arrays(unary)]

    @classmethod
    def of(cls, head, low, *bits) -> EliasFano:
        return cls(int(head[0]), int(head[1]), low, Bits(*bits))

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.low_bits
        word, off = at >> 6, (at & 63).astype(np.uint64)
        over = np.where(off > 0, self.low[word + 1] << ((np.uint64(64) - off) & np.uint64(63)), np.uint64(0))
        return ((self.low[word] >> off) | over) & np.uint64((1 << self.low_bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        high = (self.bits.select(i.copy(), 1) - i).astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | self.lows(i)

    def span(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at i and at i + 1, which must be there."""
        at = self.bits.select(i.copy(), 1)
        after = at + 1 + self.bits.run(at + 1, 0)
        low = np.uint64(self.low_bits)
        return tuple(((((p - k).astype(np.uint64)) << low) | self.lows(k)).astype(np.int64) for p, k in ((at, i), (after, i + 1)))

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each value, -1 where it is not there: by its high part's range, then by successor search among the low parts."""
        out = np.full(len(x), -1)
        if not self.n or not len(x):
            return out
        x = x.astype(np.uint64)
        last = int(self.access(np.array([self.n - 1]))[0])
        ok = np.flatnonzero(x <= np.uint64(last))
        high = (x[ok] >> np.uint64(self.low_bits)).astype(np.int64)
        at = np.zeros(len(ok), np.int64)
        some = high > 0
        at[some] = self.bits.select(high[some] - 1, 0) + 1
        lo = at - high
        hi = lo + self.bits.run(at)
        want = x[ok] & np.uint64((1 << self.low_bits) - 1)
        end = hi.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            less = self.lows(mid) < want[open_]
            lo[open_[less]], hi[open_[~less]] = mid[less] + 1, mid[~less]
        there = np.flatnonzero(lo < end)
        there = there[self.lows(lo[there]) == want[there]]
        out[ok[there]] = lo[there]
        return out


def packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays in one flat file: number of arrays, then each one's kind and length, then the data, all in 8-byte words."""
    kinds = {"i8": 0, "u8": 1, "u2": 2, "u1": 3, "u4": 4}
    head, body = [len(arrays)], []
    for a in arrays:
        data = np.ascontiguousarray(a).tobytes()
        head += [kinds[a.dtype.str[1:]], len(a)]
        body.append(data + bytes(-len(data) % 8))
    return np.array(head, np.int64).tobytes() + b"".join(body)


def unpacked(words: np.ndarray) -> list[np.ndarray]:
    """Views of the arrays in a mapped file of 8-byte words."""
    n, at, out = int(words[0]), 1 + 2 * int(words[0]), []
    for k in range(n):
        kind, size = int(words[1 + 2 * k]), int(words[2 + 2 * k])
        dtype = (np.int64, np.uint64, np.uint16, np.uint8, np.uint32)[kind]
        length = -(-size * np.dtype(dtype).itemsize // 8)
        out.append(words[at : at + length].view(dtype)[:size])
        at += length
    return out
