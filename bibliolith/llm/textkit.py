"""Vectorised text primitives shared by the corpus operators.

Everything here works on one Arrow batch inside a Spark task: texts stay UTF-8
bytes, words and windows are found and hashed with array arithmetic, and a batch
is walked in slices of bounded size, so memory does not follow the partition.

A *word* is a maximal run of bytes other than 0x20 and 0x09-0x0D.  Those bytes
never occur inside a multi-byte UTF-8 sequence, so bytes and code points agree.
A null text is the empty text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xD6E8FEB86659FD93 | 1
_U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply, xor-shift)."""
    x = x ^ (x >> _U64(31))
    x = x * _U64(0x7FB5D329728EA185)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U64(33))


class _Powers:
    """base**i and base**-i modulo 2**64, grown when a longer slice comes."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), SLICE_BYTES + 1024)
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, b, _U64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_BYTES, _WORDS = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)


class Rolling:
    """Hashes of any span of a sequence in constant time: prefix sums of value * base**i."""

    def __init__(self, values: np.ndarray, powers: _Powers):
        up, self.down = powers.get(len(values) + 1)
        self.prefix = np.zeros(len(values) + 1, _U64)
        np.cumsum((values.astype(_U64) + _U64(1)) * up[: len(values)], out=self.prefix[1:])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.down[start] + (end - start).astype(_U64))


def byte_rolling(data: np.ndarray) -> Rolling:
    return Rolling(data, _BYTES)


def word_rolling(hashes: np.ndarray) -> Rolling:
    return Rolling(hashes, _WORDS)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges of at most ``limit`` bytes, and of one row at least."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class Words:
    """The words of the rows of one slice.

    ``start``/``end``: byte range of each word in ``data``; ``row``: its row;
    ``first``: for each row the index of its first word, with one more at the end.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        inside = ~SPACE[data]
        edge = np.empty(len(data) + 1, bool)
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[0] = edge[-1] = True
        edge[offsets] = True
        at = np.flatnonzero(edge)
        begin, stop = at[:-1], at[1:]
        held = inside[begin] if len(begin) else np.zeros(0, bool)
        self.start, self.end = begin[held], stop[held]
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self) -> np.ndarray:
        return byte_rolling(self.data).span(self.start, self.end)


def windows(count: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions of all windows of ``size`` items inside rows, and the row of each."""
    n = np.maximum(count - size + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    base = np.cumsum(n) - n
    return np.arange(int(n.sum())) - base[row] + first[row], row


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each ``size`` consecutive values."""
    if len(values) < size:
        return values[:0]
    span, out = 1, values
    while span * 2 <= size:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = size - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def minimizers(order: np.ndarray, window_starts: np.ndarray, size: int, bits: int) -> np.ndarray:
    """For each window, the position of its least item (the leftmost among equals).

    ``order`` is a hash of each item.  Its low ``bits`` are replaced by the position,
    so that the choice depends on the window's content alone.
    """
    mask = _U64((1 << bits) - 1)
    at = np.arange(len(order), dtype=_U64)
    keyed = (order & ~mask) | (at & mask)
    least = sliding_min(keyed, size)[window_starts]
    return (least & mask).astype(np.int64)


def runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals, as sorted disjoint maximal ones."""
    if not len(starts):
        return starts, ends
    by = np.argsort(starts, kind="stable")
    starts, ends = starts[by], np.maximum.accumulate(ends[by])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)
    return starts[new], ends[last]


def pack(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()
