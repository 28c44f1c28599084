"""Arrow texts to words and word hashes, vectorised in numpy.

Words are told apart by their bytes: hashes are taken of distinct words only,
XXH3 for names and a rolling polynomial for features that may collide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes between words of letters, digits and non-ASCII characters.
MARKS = np.zeros(256, bool)
MARKS[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Any odd number with well spread bits makes a hash base modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 20


def mix64(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64((salt * _BASE) & (2**64 - 1))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of the base and its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(16, (n - 1).bit_length())
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_POWERS: list[_Powers] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        _POWERS.append(_Powers())
    return _POWERS[0].get(n)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str, size: int) -> Iterator[pa.RecordBatch]:
    """Batches of about ``size`` bytes of text (one row at least), whatever comes in."""
    held, total = [], 0
    for batch in batches:
        _, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            room = size - total
            to = int(np.searchsorted(offsets, offsets[at] + room, "right")) - 1
            to = min(max(to, at + (not held)), batch.num_rows)
            if to > at:
                held.append(batch.slice(at, to - at))
                total += int(offsets[to] - offsets[at])
                at = to
            if at < batch.num_rows:
                yield _merge(held)
                held, total = [], 0
    if held:
        yield _merge(held)


def _merge(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]


class Words:
    """The words of a batch of texts, ``[^\\x20\\x09-\\x0D]+`` unless other ``breaks`` are given.

    ``start``/``end`` are byte positions in ``data``, where a space follows each
    text; the words of text i are numbers ``first[i]`` to ``first[i + 1]``.
    """

    def __init__(self, column: pa.Array, lower: bool = False, breaks: np.ndarray = _SPACE):
        data, offsets = utf8(column)
        n = len(offsets) - 1
        keep = np.ones(len(data) + n, bool)
        keep[offsets[1:] + np.arange(n)] = False
        self.data = np.full(len(keep), 32, np.uint8)
        self.data[keep] = _LOWER[data] if lower else data
        self.offsets = offsets + np.arange(n + 1)
        self.gap = gap = breaks[self.data]
        before = np.append(True, gap[:-1])[: len(gap)]
        self.start = np.flatnonzero(before & ~gap)
        self.end = np.flatnonzero(gap & ~before)
        self.first = np.searchsorted(self.start, self.offsets)

    def coded(self) -> tuple[np.ndarray, pa.Array]:
        """(number of its distinct word for each word, the distinct words as large binary); told apart by their bytes."""
        ends = np.append(0, np.cumsum(self.end - self.start))
        packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(ends), pa.py_buffer(self.data[~self.gap])])
        coded = packed.dictionary_encode()
        return coded.indices.to_numpy().astype(np.int64), coded.dictionary

    def distinct(self) -> tuple[np.ndarray, list[bytes]]:
        """``coded`` with the distinct words as a list."""
        codes, words = self.coded()
        return codes, words.to_pylist()

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """XXH3 of each word, 128 bits in two arrays."""
        codes, words = self.distinct()
        both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2)
        return both[codes, 0], both[codes, 1]

    def features(self, *prefixes: int) -> np.ndarray:
        """A hash of each word for feature hashing, where words may collide anyway: a polynomial, then mixed.

        One row for the words and one for each prefix of so many bytes (for
        shorter words the word's own hash).
        """
        size = self.end - self.start
        to = [self.end, *(self.start + np.minimum(size, k) for k in prefixes)]
        out = np.zeros((len(to), len(size)), np.uint64)
        i = 0
        while i < len(size):
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + _BLOCK, "right")))
            base, part = self.start[i], self.data[self.start[i] : self.end[j - 1]]
            up, down = _powers(len(part) + 1)
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=total[1:])
            at = self.start[i:j] - base
            for row, end in zip(out, to, strict=True):
                row[i:j] = (total[end[i:j] - base] - total[at]) * down[at]
            i = j
        for row, end in zip(out, to, strict=True):
            row[:] = mix64(row ^ ((end - self.start).astype(np.uint64) << np.uint64(52)))
        return out

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1] - 1].tobytes()


def windows(names: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` consecutive names (as many as fit)."""
    m = len(names) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    x = mix64(names, salt) if salt else names
    for k in range(n):
        out *= np.uint64(_BASE)
        out += x[k : k + m]
    return mix64(out, salt)


def codepoints(data: np.ndarray) -> np.ndarray:
    """``[i]``: characters before byte i, for byte positions 0 to len(data)."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
