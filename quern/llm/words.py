"""Words of many texts at once, in numpy: positions, 64-bit hashes, windows.

A text's UTF-8 bytes are cut at ASCII white space, which is the rule of common.WORD.
A word's hash is a polynomial in its bytes mod 2^64 with an odd base, taken for all
words of a buffer in one pass, then mixed; it depends on the word alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)  # odd, so it has an inverse mod 2^64
_INVERSE = _U(pow(int(_BASE), -1, 2**64))
#: Bytes of text handled at once; buffers of this size stay in the processor's cache.
BUFFER = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finalizer of splitmix64)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _codes(lower: bool) -> np.ndarray:
    codes = mix(np.arange(1, 257, dtype=_U) * _BASE)
    codes[_SPACE] = 0
    return codes[_LOWER] if lower else codes


_CODES = {lower: _codes(lower) for lower in (False, True)}
_powers = {_BASE: np.ones(1, _U), _INVERSE: np.ones(1, _U)}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) mod 2^64; kept, as every buffer needs them."""
    if base not in _powers or len(_powers[base]) < n:
        p = np.full(max(n, BUFFER + 1024), base, _U)
        p[0] = 1
        if n > 4 * BUFFER:
            return np.multiply.accumulate(p[:n])
        _powers[base] = np.multiply.accumulate(p)
    return _powers[base][:n]


def inverse(base: np.uint64) -> np.uint64:
    return _U(pow(int(base), -1, 2**64))


class Words:
    """Words of some texts. hash, start, end: of each word; first: each text's first word, and the number of words at the end."""

    __slots__ = ("buffer", "hash", "start", "end", "first", "_end")

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.buffer = buffer = b"\n".join([*texts, b""]) if texts else b""
        data = np.frombuffer(buffer, np.uint8)
        inside = np.concatenate(([False], ~_SPACE[data], [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edges[::2], edges[1::2]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.first = np.searchsorted(self.start, np.concatenate(([0], np.cumsum(lengths))))
        if len(self.start):
            values = _CODES[lower][data] * powers(_BASE, len(data))
            self.hash = mix(np.add.reduceat(values, self.start) * powers(_INVERSE, len(data))[self.start] + (self.end - self.start).astype(_U))
        else:
            self.hash = np.zeros(0, _U)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """Which text each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def windows(hashes: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """Hash of every n consecutive word hashes; len(hashes) - n + 1 of them. Windows over two texts are for the caller to leave out."""
    if len(hashes) < n:
        return np.zeros(0, _U)
    sums = np.concatenate(([_U(0)], np.cumsum(hashes * powers(base, len(hashes)))))
    return mix((sums[n:] - sums[:-n]) * powers(inverse(base), len(hashes))[: len(hashes) - n + 1])


def groups(batches: Iterator[pa.RecordBatch], text: int, size: int = BUFFER) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with their texts as bytes (null: empty), some `size` bytes each, one text at least."""
    for batch in batches:
        column = batch.column(text)
        lo, some, held = 0, [], 0
        for i, value in enumerate(column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()):
            some.append(value or b"")
            held += len(some[-1])
            if held >= size:
                yield batch.slice(lo, len(some)), some
                lo, some, held = i + 1, [], 0
        if some:
            yield batch.slice(lo, len(some)), some
