"""Words, shingles and windows of UTF-8 text as numpy arrays, many texts at a time.

An Arrow string column already is one byte buffer with offsets, so texts are never turned into Python strings here.
Texts are taken in runs of about ``CHUNK`` bytes, which bounds the working memory by a run or the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

CHUNK = 1 << 20

_BYTE = np.arange(256)
#: Bytes that are not white space (space, tab to carriage return).
NOT_SPACE = ~((_BYTE == 0x20) | ((_BYTE >= 0x09) & (_BYTE <= 0x0D)))
#: Bytes of lower-case letters, digits and everything beyond ASCII.
ALPHANUMERIC = ((_BYTE >= 0x30) & (_BYTE <= 0x39)) | ((_BYTE >= 0x61) & (_BYTE <= 0x7A)) | (_BYTE >= 0x80)
UPPER = (_BYTE >= 0x41) & (_BYTE <= 0x5A)
#: Maps A-Z to a-z and leaves other bytes.
LOWER = np.where((_BYTE >= 0x41) & (_BYTE <= 0x5A), _BYTE + 32, _BYTE).astype(np.uint8)

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finalising rounds of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_STEP = U(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
#: Keeps the first n of 8 bytes.
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], U)
#: Longer byte sequences are hashed one by one.
_VECTOR_BYTES = 64
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """Powers of base; kept for runs of up to CHUNK values, made anew for a longer text."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK // 4), base, U)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= CHUNK:
            _powers[base] = have
    return have[:n]


def byte_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:start + size]. Eight bytes at a time go through a mixing that is no polynomial, so that
    no family of texts is known to collide; up to eight bytes the hash is one to one for each size."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    out = mix((size.astype(U) + U(1)) * _STEP)
    at = np.flatnonzero(size > 0) if len(size) and size.min() <= 0 else np.arange(len(size))
    for c in range(0, _VECTOR_BYTES, 8):
        at = at[size[at] > c]
        if not len(at):
            break
        part = eight[start[at] + c] & _KEEP[np.minimum(size[at] - c, 8)]
        out[at] = mix((out[at] ^ part) * _STEP)
    for i in np.flatnonzero(size > _VECTOR_BYTES).tolist():
        out[i] = xxhash.xxh64_intdigest(data[start[i] : start[i] + size[i]].tobytes(), 1)
    return out


def _window_sums(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """A polynomial of values[start:end] for each pair, whatever stands before it (mod 2**64, then mixed)."""
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values * _power(base, len(values)), out=sums[1:])
    inverse = pow(base, -1, 1 << 64)
    at = _power(inverse, len(values) + 1)[start]
    return mix((sums[end] - sums[start]) * at + (end - start).astype(U) * _STEP)


class Texts:
    """A run of texts: their bytes, word boundaries, and for text i the words first[i]:first[i + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray):
        self.data, self.offsets = data, offsets
        self.inside = inside = word_bytes[data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        begins[edges] = inside[edges]
        ends[edges - 1] = inside[edges - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.counts())

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def word_hashes(self) -> np.ndarray:
        return byte_hashes(self.data, self.start, self.end - self.start)

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words, a space after each, and where each word begins and ends in these bytes."""
        size = self.end - self.start
        end = np.cumsum(size + 1) - 1
        out = np.full(int(end[-1]) + 1 if len(end) else 0, 0x20, np.uint8)
        inside = np.ones(len(out), bool)
        inside[end] = False
        out[inside] = self.data[self.inside]
        return out, end - size, end

    def prefix_hashes(self, n_bytes: int, at: np.ndarray) -> np.ndarray:
        """Hashes of the first bytes of the words at these positions."""
        return byte_hashes(self.data, self.start[at], np.full(len(at), n_bytes))

    def window_starts(self, n: int) -> np.ndarray:
        """Positions of words at which a window of n words fits into the text."""
        left = np.repeat(self.first[1:], self.counts()) - np.arange(len(self.start))
        return np.flatnonzero(left >= n)


def span_hashes(words: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hashes of the word sequences words[start:end]; words are their hashes. As a polynomial modulo 2**64 it only finds
    candidates: whoever needs equality compares the words."""
    return _window_sums(words, start, end, (_BASE + 8 * (2 * salt + 1)) % (1 << 64))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string or binary column; null is as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary() if pa.types.is_large_binary(column.type) or pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)), offsets


def runs(column: pa.Array, chunk: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(Index of the first text, bytes, offsets from 0) for runs of texts of about chunk bytes; at least one text each."""
    if not len(column):
        return
    data, offsets = buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + chunk, side="right")) - 1))
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
