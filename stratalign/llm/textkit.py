"""Vectorised work on the UTF-8 buffers of Arrow string columns.

Words are runs of bytes other than ``\\x20\\x09-\\x0D``.  A word's hash is a
polynomial over random 64-bit values of its bytes, taken from one running sum
over the buffer, so that hashing costs a few nanoseconds a byte and no Python
object is made for a word.  Texts are handled in segments of bounded size.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SEGMENT = 1 << 17
_BASE = 0x9E3779B97F4A7C15 | 1
END = U64(0x5851F42D4C957F2D)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, over an array of uint64."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def trimmed(function):
    """A function over batches that hands what it has freed back to the system when a task ends: a worker process goes on
    to other tasks, and what the allocator keeps would count as its memory for good."""

    def run(batches):
        yield from function(batches)
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library: it has its own ways
            pass

    return run


class _Tables:
    """Byte tables and powers, made once a process."""

    def __init__(self):
        self.space = np.zeros(256, bool)
        self.space[[32, 9, 10, 11, 12, 13]] = True
        keys = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93)) | U64(1)
        self.keys = keys
        lower = np.arange(256)
        lower[65:91] += 32
        self.lower_keys = keys[lower]
        self.power = self.inverse = np.ones(1, U64)

    def powers(self, n: int) -> None:
        if len(self.power) <= n:
            size = max(n + 1, SEGMENT + 1)
            with np.errstate(over="ignore"):
                self.power = np.cumprod(np.r_[U64(1), np.full(size, U64(_BASE))], dtype=U64)
                self.inverse = np.cumprod(np.r_[U64(1), np.full(size, U64(pow(_BASE, -1, 1 << 64)))], dtype=U64)


_TABLES: list[_Tables] = []


def tables() -> _Tables:
    if not _TABLES:
        _TABLES.append(_Tables())
    return _TABLES[0]


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n+1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type not in (pa.large_string(), pa.large_binary()):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - (offsets[0] if len(offsets) else 0)


def _segments(data: np.ndarray, offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Cuts the buffer at row ends, and rows beyond the limit at white space."""
    space, start, total = tables().space, 0, int(offsets[-1])
    while start < total:
        end = total
        if total - start > limit:
            end = int(offsets[np.searchsorted(offsets, start + limit, "right") - 1])
            if end <= start:  # within one long row
                row_end, at = int(offsets[np.searchsorted(offsets, start, "right")]), start + limit
                while at < row_end and not space[data[at]]:
                    at += 1
                end = min(at, row_end)
        yield start, end
        start = end


def word_spans(data: np.ndarray, offsets: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """First and past-last positions of the words in data[start:end]."""
    word = ~tables().space[data[start:end]]
    edge = np.zeros(end - start + 1, bool)
    inside = offsets[np.searchsorted(offsets, start) : np.searchsorted(offsets, end, "right")] - start
    edge[inside] = True
    edge[0] = edge[-1] = True
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (edge[:-1] | ~before))
    after = np.empty_like(word)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (edge[1:] | ~after)) + 1
    return starts + start, ends + start


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and n+1 offsets into them by row."""
    t = tables()
    keys = t.lower_keys if lower else t.keys
    found, where = [], []
    with np.errstate(over="ignore"):
        for start, end in _segments(data, offsets, SEGMENT):
            starts, ends = word_spans(data, offsets, start, end)
            if not len(starts):
                continue
            t.powers(end - start)
            total = np.zeros(end - start + 1, U64)
            np.cumsum(keys[data[start:end]] * t.power[: end - start], out=total[1:])
            at = starts - start
            found.append(mix((total[ends - start] - total[at]) * t.inverse[at]))
            where.append(starts)
    if not found:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    return np.concatenate(found), np.searchsorted(np.concatenate(where), offsets).astype(np.int64)


def shingles(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n-word shingles by row, in order and with repeats; a shorter row that has words gives one."""
    count = np.diff(rows)
    made = np.where(count == 0, 0, np.maximum(count - n + 1, 1))
    out_rows = np.r_[0, np.cumsum(made)]
    with np.errstate(over="ignore"):
        if len(hashes) >= n:
            total = np.zeros(len(hashes) - n + 1, U64)
            for k in range(n):
                total += hashes[k : len(hashes) - n + 1 + k] * U64(pow(_BASE, 2 * k + 3, 1 << 64))
        else:
            total = np.zeros(0, U64)
        out = np.empty(int(out_rows[-1]), U64)
        long = count >= n
        take = np.repeat(rows[:-1][long] - out_rows[:-1][long], made[long])
        place = _ranges(out_rows[:-1][long], made[long])
        out[place] = total[place + take]
        for r in np.flatnonzero((count > 0) & ~long):  # fewer words than n
            value = U64(int(count[r]))
            for k in range(int(count[r])):
                value = value + hashes[rows[r] + k] * U64(pow(_BASE, 2 * k + 3, 1 << 64))
            out[out_rows[r]] = value * U64(0xC2B2AE3D27D4EB4F)
    return mix(out), out_rows


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(s, s + l)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    step = np.ones(total, np.int64)
    step[0] = starts[0]
    step[np.cumsum(lengths)[:-1]] = starts[1:] - starts[:-1] - lengths[:-1] + 1
    return np.cumsum(step)


ranges = _ranges


def distinct_by_row(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values sorted and distinct within each row."""
    parts, counts = [], np.zeros(len(rows), np.int64)
    for r in range(len(rows) - 1):
        part = np.sort(values[rows[r] : rows[r + 1]])
        if len(part) > 1:
            part = part[np.r_[True, part[1:] != part[:-1]]]
        parts.append(part)
        counts[r + 1] = len(part)
    return (np.concatenate(parts) if parts else values[:0]), np.cumsum(counts)


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts together have about limit bytes at most, one row at least."""
    _, offsets = buffer_of(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end
