"""64-bit hashes of spans of a byte buffer, by array operations.

A span's hash is its polynomial in a fixed base modulo the prime 2 ** 61 - 1, with its length mixed
in. Modulo a power of two such hashes collide on texts that can be written down (words over two
letters like the Thue-Morse sequence, from 1024 letters on), modulo a prime they don't: two spans of
n bytes agree for n of all 2 ** 61 bases at most.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

ODD = np.uint64(0x9E3779B97F4A7C15)
_P = (1 << 61) - 1
_PRIME, _BITS = np.uint64(_P), np.uint64(61)
_BASE = 0x0A3B1C5D7E9F2468 % _P
_LOW31, _LOW32 = np.uint64((1 << 31) - 1), np.uint64((1 << 32) - 1)
#: Bytes for which powers are kept; longer buffers go in blocks of half as many.
MOST = 1 << 21


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer for 64-bit hashes."""
    with np.errstate(over="ignore"):  # numpy warns of single values
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_HASH = mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * ODD)


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime."""
    x = (x & _PRIME) + (x >> _BITS)
    return np.where(x >= _PRIME, x - _PRIME, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of numbers below the prime, modulo it: in parts of 31 and 30 bits, as 2 ** 61 counts as 1."""
    half = np.uint64(31)
    a0, a1, b0, b1 = a & _LOW31, a >> half, b & _LOW31, b >> half
    middle = a1 * b0 + a0 * b1
    return reduced(((a1 * b1) << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << half) + a0 * b0)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, times(out, np.full(1, pow(base, len(out), _P), np.uint64))])
    return out


@lru_cache(maxsize=1)
def _tables(bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    up = _powers(_BASE, 1 << bits)
    return (up & _LOW32).astype(np.uint32), (up >> np.uint64(32)).astype(np.uint32), _powers(pow(_BASE, -1, _P), 1 << bits)


_bits = 16


def tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base for n bytes or more, lower and upper 32 bits, and of its inverse: a worker keeps its largest tables."""
    global _bits
    _bits = max(_bits, int(n).bit_length())
    return _tables(_bits)


class Spans:
    """Hashes of any spans data[a:b] of a buffer, equal for equal bytes."""

    def __init__(self, data: np.ndarray):
        self.data = data
        if len(data) <= MOST:
            low, high, self.down = tables(len(data))
            x = data.astype(np.uint64) + np.uint64(1)
            self.low, self.high = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * t[: len(data)])]) for t in (low, high))

    def _finished(self, low: np.ndarray, high: np.ndarray, down: np.ndarray, n) -> np.ndarray:
        high = reduced(high)
        high = ((high << np.uint64(32)) & _PRIME) + (high >> np.uint64(29))  # times 2 ** 32
        return mixed(times(reduced(high + reduced(low)), down) + n * ODD)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.data) <= MOST:
            return self._finished(self.low[ends] - self.low[starts], self.high[ends] - self.high[starts], self.down[starts], (ends - starts).astype(np.uint64))
        out, half = np.zeros(len(starts), np.uint64), MOST // 2
        block = starts // half
        for k in np.unique(block).tolist():
            own = np.flatnonzero(block == k)
            a, b = starts[own] - k * half, ends[own] - k * half
            near = b <= MOST
            out[own[near]] = Spans(self.data[k * half : k * half + MOST]).hashes(a[near], b[near])
            for i in own[~near].tolist():
                out[i] = self._long(int(starts[i]), int(ends[i]))
        return out

    def _long(self, a: int, b: int) -> np.uint64:
        """A span of any length, block by block."""
        value, factor = 0, 1
        for k in range(a, b, MOST):
            s = Spans(self.data[k : min(k + MOST, b)])
            value += factor * ((int(s.low[-1]) + (int(s.high[-1]) << 32)) % _P)
            factor = factor * pow(_BASE, MOST, _P) % _P
        n = np.array([b - a], np.uint64)
        return mixed(np.array([value % _P], np.uint64) + n * ODD)[0]

    def rolling(self, n: int) -> np.ndarray:
        """Hashes of all spans of n bytes, from the first on."""
        m = len(self.data) - n + 1
        if len(self.data) > MOST:
            at = np.arange(m)
            return self.hashes(at, at + n)
        return self._finished(self.low[n:] - self.low[:m], self.high[n:] - self.high[:m], self.down[:m], np.full(1, n, np.uint64))


def text_buffer(texts) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string or binary array and its len + 1 bounds in them; null: empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    big = pa.large_binary() if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else pa.large_string()
    texts = pc.fill_null(texts.cast(big), b"" if big == pa.large_binary() else "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def word_hashes(data: np.ndarray, bounds: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of texts data[bounds[i]:bounds[i + 1]], the texts' bounds in them, and the words' bounds in data.

    space: for each byte value, whether it stands between words.
    """
    word = ~space[data]
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Spans(data).hashes(starts, ends), np.searchsorted(starts, bounds), starts, ends
