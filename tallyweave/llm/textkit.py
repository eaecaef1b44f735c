"""Words, hashes and windows of whole Arrow batches as numpy arrays, for use inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20  # texts are worked on in groups of about this size

# `[^\x20\x09-\x0D]+`: everything but space and the ASCII control spaces.
SPACED = np.ones(256, bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

# `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of text whose A-Z are lower-cased: digits, letters, everything beyond ASCII.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[0x30:0x3A] = ALPHANUMERIC[0x61:0x7B] = ALPHANUMERIC[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def bytes_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and where each row begins (one more entry than rows); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def groups(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; a longer row is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


class Words:
    """Words of some rows: ``starts`` and ``ends`` in ``data``, and per row the index of its ``first`` word (one more entry)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        inside = table[data]
        before = np.zeros(len(data), bool)
        after = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        heads = offsets[:-1][offsets[:-1] < len(data)]
        before[heads] = False
        after[heads[heads > 0] - 1] = False
        self.data = data
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, salt: int = 0) -> np.ndarray:
        return spans(self.data, self.starts, self.ends, salt)

    def heads(self, width: int) -> np.ndarray:
        """Indices of words that begin a window of ``width`` words within one row."""
        index = np.arange(len(self.starts))
        return index[index + width <= np.repeat(self.first[1:], self.counts)]


def joined(words: Words, offsets: np.ndarray, kept: np.ndarray | None = None) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Words (or the ``kept`` ones) with one space after each that another byte follows in its row.

    Returns the bytes, where each row begins in them (one more entry), and where each word of
    ``words`` begins. A row may end with a space.
    """
    begins, ends = (words.starts, words.ends) if kept is None else (words.starts[kept], words.ends[kept])
    step = np.zeros(len(words.data) + 1, np.int8)
    step[begins] += 1
    step[ends] -= 1
    inside = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
    after = np.zeros(len(inside), bool)
    after[1:] = inside[:-1]
    after[offsets[:-1][offsets[:-1] < len(inside)]] = False
    keep = inside | after
    count = np.r_[0, np.cumsum(keep)]
    return np.where(inside, words.data, 0x20).astype(np.uint8)[keep].tobytes(), count[offsets], count[words.starts]


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    v = np.atleast_1d(values)
    v = v ^ (v >> np.uint64(30))
    v = v * np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(27)
    v *= np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


STRIDE = 1 << 11  # powers are products of one below and one of multiples of it


def _powers(n: int, salt: int, inverse: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to ``STRIDE`` - 1 of a salt's odd base, or of its inverse, and its powers at multiples of ``STRIDE`` up to ``n``.

    The power of i is ``low[i % STRIDE] * high[i // STRIDE]``: some kilobytes instead of one value per byte of text, made
    anew each time, so that workers, which outlive their tasks, keep nothing.
    """
    base = (int(_MULTIPLIER) + 2 * salt * 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF | 1
    if inverse:
        base = pow(base, -1, 1 << 64)
    out = []
    for step, size in ((base, STRIDE), (pow(base, STRIDE, 1 << 64), n // STRIDE + 1)):
        steps = np.full(size, step, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hashes of ``values[start:end]``, all at once: differences of one running polynomial."""
    n = len(values)
    low, high = _powers(n, salt)
    total = np.zeros(n + 1, np.uint64)
    total[1:] = values
    total[1:] += np.uint64(1)
    whole = n // STRIDE * STRIDE
    blocks = total[1 : whole + 1].reshape(-1, STRIDE)  # a view
    blocks *= low
    blocks *= high[: len(blocks), None]
    total[whole + 1 :] *= low[: n - whole] * high[-1]
    np.cumsum(total, out=total)
    low, high = _powers(n, salt, inverse=True)
    down = low[starts % STRIDE] * high[starts // STRIDE]
    length = (ends - starts).astype(np.uint64)
    return mix((total[ends] - total[starts]) * down + length * _MULTIPLIER + np.uint64(salt))


def windows(hashes: np.ndarray, heads: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hashes of the ``width`` words from each head on."""
    return spans(hashes, heads, heads + width, salt)


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])


def stretches(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal values."""
    edges = np.r_[runs(sorted_values), len(sorted_values)].tolist()
    return list(zip(edges[:-1], edges[1:], strict=True))


def summed(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, with their counts added up."""
    order = np.argsort(hashes, kind="stable")
    hashes, counts = hashes[order], counts[order]
    at = runs(hashes)
    return hashes[at], np.add.reduceat(counts, at) if len(at) else counts


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the stretches between one entry of ``first`` and the next; empty stretches give 0."""
    out = np.zeros(len(first) - 1, values.dtype if values.dtype.kind != "b" else np.int64)
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        out[full] = np.add.reduceat(values.astype(out.dtype, copy=False), first[:-1][full])
    return out


def buckets(hashes: np.ndarray, n: int) -> np.ndarray:
    """A bucket below ``n`` for each hash, by its high bits."""
    return ((hashes >> np.uint64(33)) * np.uint64(n) >> np.uint64(31)).astype(np.int64)


def trim() -> None:
    """Give memory that a worker no longer uses back; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library keeps what it has
        pass
