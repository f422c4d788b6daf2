"""Vectorised tokenising and hashing of Arrow string columns.

Everything here works on the raw UTF-8 buffer of a column, a slice of about a quarter of a megabyte at a time,
so that no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once; a longer document is a slice of its own.
SLICE_BYTES = 1 << 18
_ODD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the splitmix64 one)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _bytes_table(seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, 257, dtype=np.uint64) * U64(_ODD) + U64(seed * 0x51_7C_C1_B7))


#: Byte values of the two independent word hashes.
_BYTES = (_bytes_table(1), _bytes_table(2))
#: Windows of words are polynomials modulo this prime: modulo a power of two, whatever the base, sequences that double
#: themselves with two letters swapped collide from some length on.
PRIME = U64((1 << 61) - 1)
_M30, _M31 = U64((1 << 30) - 1), U64((1 << 31) - 1)


def reduced(x: np.ndarray) -> np.ndarray:
    """64-bit values modulo PRIME."""
    x = (x & PRIME) + (x >> U64(61))
    return x - PRIME * (x >= PRIME)


def _shifted31(x: np.ndarray) -> np.ndarray:
    """x * 2^31 modulo PRIME, not fully reduced (below 2^62 + 2^34), for x below 2^64."""
    return (x >> U64(30)) + ((x & _M30) << U64(31))


def mulmod(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """Products modulo PRIME of values below it."""
    a1, a0, b1, b0 = a >> U64(31), a & _M31, b >> U64(31), b & _M31
    low = a0 * b0
    return reduced(a1 * b1 * U64(2) + _shifted31(a1 * b0 + a0 * b1) + (low >> U64(61)) + (low & PRIME))


class _Powers:
    """Powers of a base modulo PRIME and of its inverse, made once for each worker."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base, pow(base, -1, int(PRIME)), 0
        self.up = self.down = np.empty(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, SLICE_BYTES)
            self.up, self.down = (self._of(b) for b in (self.base, self.inverse))
        return self.up, self.down

    def _of(self, base: int) -> np.ndarray:
        out = np.ones(self.n, np.uint64)
        done = 1
        while done < self.n:
            more = min(done, self.n - done)
            out[done : done + more] = mulmod(out[:more], U64(pow(base, done, int(PRIME))))
            done += more
        return out


_POWERS = (_Powers(0x11B54A32D192ED03), _Powers(0x0BC98388FB8FAC03))

#: Separators of words are the ASCII blanks x20 and x09-x0D.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of normalised words: every ASCII byte but letters and digits.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Words:
    """The words of some documents: first byte, end, document (index in the slice) and 64-bit hash of each."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    h: np.ndarray
    #: For document d its words are first[d]:first[d + 1].
    first: np.ndarray
    #: A second, independent hash of each word, if asked for.
    h2: np.ndarray | None = None

    def grams(self, n: int, other: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words and which of them lie in one document (indexed by first word)."""
        m = len(self.h) - n + 1
        if m <= 0:
            return np.empty(0, np.uint64), np.empty(0, bool)
        return window_hash(self.h, n, other), self.doc[:m] == self.doc[n - 1 :]


def _prefixes(h: np.ndarray, other: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the polynomial of h modulo PRIME, and the powers of the base's inverse."""
    up, down = _POWERS[other].upto(len(h) + 1)
    terms = mulmod(reduced(mix(h + U64(77 + other))), up[: len(h)])
    c = np.zeros(len(h) + 1, np.uint64)
    # in halves, whose sums don't overflow
    c[1:] = reduced(reduced(_shifted31(np.cumsum(terms >> U64(31)))) + reduced(np.cumsum(terms & _M31)))
    return c, down


def window_hash(h: np.ndarray, n: int, other: int = 0) -> np.ndarray:
    """Hash of every run of n values: a polynomial by running sums, finalised; other picks an independent base."""
    start = np.arange(len(h) - n + 1)
    return span_hash(h, start, start + n, other)


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray, other: int = 0) -> np.ndarray:
    """Hash of the values start:end for each pair of bounds."""
    c, down = _prefixes(h, other)
    return mix(mulmod(reduced(c[end] + PRIME - c[start]), down[start]) + (np.asarray(end) - start).astype(np.uint64))


def _word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, place: np.ndarray, which: int) -> np.ndarray:
    """Hash of the bytes start:end of each word: the sum of a random value for each byte at its place in the word. There is
    no algebra between places, so words of any length collide only by chance."""
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(mix(_BYTES[which][data] + place), out=c[1:])
    return mix(c[end] - c[start] + (end - start).astype(np.uint64) * U64(_ODD))


def words_of(data: np.ndarray, bounds: np.ndarray, separators: np.ndarray = BLANK, lower: bool = False, prefix: int = 0, two: bool = False) -> Words:
    """Words of documents that lie one after another in data; document d is bounds[d]:bounds[d + 1].

    prefix: only so many leading bytes of each word enter its hash (0: all). two: also the second hash."""
    n, docs = len(data), len(bounds) - 1
    if not n:
        e = np.empty(0, np.int64)
        none = np.empty(0, np.uint64)
        return Words(data, e, e, e, none, np.zeros(docs + 1, np.int64), none)
    if lower:
        data = LOWER[data]
    inside = ~separators[data]
    fresh = np.zeros(n + 1, bool)
    fresh[bounds] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | fresh[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | fresh[1:])) + 1
    # a byte's place in its word, spread over 64 bits
    began = np.zeros(n, np.int64)
    began[start] = np.diff(start, prepend=0)
    place = (np.arange(n) - np.cumsum(began)).astype(np.uint64) * U64(_ODD)
    stop = np.minimum(end, start + prefix) if prefix else end
    h = _word_hash(data, start, stop, place, 0)
    h2 = _word_hash(data, start, stop, place, 1) if two else None
    first = np.searchsorted(start, bounds)
    doc = np.repeat(np.arange(docs), np.diff(first))
    return Words(data, start, end, doc, h, first, h2)


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds) of runs of rows with about limit bytes; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = len(column)
    if not rows:
        return
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + rows + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < rows:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(rows, max(at + 1, to))
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
