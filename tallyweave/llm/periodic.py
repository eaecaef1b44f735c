"""Runs of repeated words: dyadic blocks look for their next occurrences by range successor over the suffix array, and these give candidate periods."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import textkit

LEAST = 12  # words of a run
BASE = 4  # words of the smallest blocks, which begin at every second word
GRAM = 6  # a run of LEAST words or more holds so many in a row that occur a period later
CHUNK = 2 << 20  # bytes of text searched at once

_RUNS = "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RUNS_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])


class WaveletMatrix:
    """The bits of an array of numbers, highest first, each level sorted by the one before: order statistics of any range."""

    def __init__(self, values: np.ndarray):
        self.size = len(values)
        self.bits = max(1, int(self.size).bit_length())
        self.zeros: list[np.ndarray] = []
        for b in reversed(range(self.bits)):
            zero = (values >> b) & 1 == 0
            before = np.zeros(self.size + 1, np.int32)
            np.cumsum(zero, out=before[1:])
            self.zeros.append(before)
            values = np.concatenate([values[zero], values[~zero]])

    def _down(self, level: int, low: np.ndarray, high: np.ndarray):
        before = self.zeros[level]
        return before[low], before[high], before[-1]

    def below(self, low: np.ndarray, high: np.ndarray, than: np.ndarray) -> np.ndarray:
        """How many values of each range are smaller than a number."""
        than = np.minimum(than, (1 << self.bits) - 1)
        count = np.zeros(len(low), np.int64)
        for level in range(self.bits):
            a, b, zeros = self._down(level, low, high)
            one = (than >> (self.bits - 1 - level)) & 1 == 1
            count += np.where(one, b - a, 0)
            low, high = np.where(one, zeros + low - a, a), np.where(one, zeros + high - b, b)
        return count

    def smallest(self, low: np.ndarray, high: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The value of a rank, from 0, in each range."""
        value = np.zeros(len(low), np.int64)
        for level in range(self.bits):
            a, b, zeros = self._down(level, low, high)
            one = rank >= b - a
            rank = rank - np.where(one, b - a, 0)
            value = value << 1 | one
            low, high = np.where(one, zeros + low - a, a), np.where(one, zeros + high - b, b)
        return value

    def successor(self, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The smallest value of each range that is not below ``least``; the array's size if there is none."""
        rank = self.below(low, high, least)
        out = np.full(len(low), self.size, np.int64)
        there = np.flatnonzero((rank < high - low) & (least < self.size))
        out[there] = self.smallest(low[there], high[there], rank[there])
        return out


class Sequences:
    """Sequences of numbers, one after the other, with the names of all their factors of 2**k numbers and their suffix array."""

    def __init__(self, values: np.ndarray, first: np.ndarray):
        sizes = np.diff(first)
        self.size = len(values)
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        self.begin, self.end = np.repeat(first[:-1], sizes), np.repeat(first[1:], sizes)
        _, names = np.unique(self.owner * (int(values.max(initial=0)) + 1) + values, return_inverse=True)
        self.names = [names.astype(np.int32)]
        # Sequences in which a factor of this length occurs twice go on to the next.
        open_ = self._repeating(self.names[0], np.arange(self.size))
        while len(open_):
            step, now = 1 << (len(self.names) - 1), self.names[-1]
            after = np.where(open_ + step < self.end[open_], now[np.minimum(open_ + step, self.size - 1)] + 1, 0)
            _, names = np.unique(now[open_].astype(np.int64) * (self.size + 1) + after, return_inverse=True)
            longer = now.copy()
            longer[open_] = names
            self.names.append(longer)
            open_ = self._repeating(longer, open_)
        self.order = np.argsort(self.owner * (self.size + 1) + self.names[-1], kind="stable")
        self.place = np.empty(self.size, np.int64)
        self.place[self.order] = np.arange(self.size)

    def _repeating(self, names: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Those of the places ``at`` whose sequence has a name twice."""
        twice = np.bincount(names[at], minlength=1)[names[at]] > 1
        return at[np.isin(self.owner[at], np.unique(self.owner[at][twice]))]

    def intervals(self, level: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where, in the suffix array, the suffixes that begin with the 2**level numbers at a place are."""
        names, owner = self.names[min(level, len(self.names) - 1)][self.order], self.owner[self.order]
        edge = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]) | (owner[1:] != owner[:-1]), True])
        interval = np.searchsorted(edge, self.place[at], "right") - 1
        return edge[interval], edge[interval + 1]

    def same(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        names = self.names[min(level, len(self.names) - 1)]
        return names[a] == names[b]

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many numbers from two places (a < b) of one sequence on are the same."""
        total, end = np.zeros(len(a), np.int64), self.end[a]
        for level in reversed(range(len(self.names))):
            x, y = a + total, b + total
            inside = y < end
            equal = self.names[level][np.minimum(x, self.size - 1)] == self.names[level][np.minimum(y, self.size - 1)]
            total += np.where(inside & equal, 1 << level, 0)
        return total

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many numbers before two places (a < b) of one sequence are the same."""
        total, begin = np.zeros(len(a), np.int64), self.begin[a]
        for level in reversed(range(len(self.names))):
            x, y = a - total - (1 << level), b - total - (1 << level)
            equal = self.names[level][np.maximum(x, 0)] == self.names[level][np.maximum(y, 0)]
            total += np.where((x >= begin) & equal, 1 << level, 0)
        return total

    def extended(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the longest stretch around two places that keeps their distance as a period."""
        return a - self.behind(a, b), b + self.ahead(a, b)


def _candidates(text: Sequences, index: WaveletMatrix, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods to try: those at which blocks of 2**level occur again within the window of their level.

    Occurrences no further apart than half a block form a progression, as they lie in a stretch with their difference as
    period: its ends give all of them without another search. In the block's own stretch only the difference itself is tried.
    """
    block = 1 << level
    step, low, high = (2, 1, 4 * block - 2) if block == BASE else (block, 2 * block - 1, 4 * block - 2)
    at = np.arange(text.size)
    at = at[((at - text.begin) % step == 0) & (at + block + low <= text.end)]
    left, right = text.intervals(level, at)
    often = right - left > 1
    at, left, right = at[often], left[often], right[often]
    least = at + low
    places, periods = [], []
    while len(at):
        found = index.successor(left, right, least)
        there = (found < index.size) & (found <= at + high)
        at, left, right, found = (x[there] for x in (at, left, right, found))
        if not len(at):
            break
        places.append(at)
        periods.append(found - at)
        least = found + 1
        after = index.successor(left, right, least)
        dense = np.flatnonzero((after < index.size) & (after - found <= block // 2))
        if len(dense):
            a, b, d = at[dense], found[dense], (after - found)[dense]
            begin, _ = text.extended(a, a + d)
            begin2, end2 = text.extended(b, b + d)
            last = (end2 - block - b) // d
            # In the block's own stretch every distance is a multiple of d.
            more = np.where(begin2 == begin, 0, np.minimum(last, (a + high - b) // d))
            count = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
            places += [a, np.repeat(a, more)]
            periods += [d, np.repeat(b - a, more) + count * np.repeat(d, more)]
            least[dense] = b + last * d + 1
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, period = np.concatenate(places), np.concatenate(periods)
    fits = (period >= 1) & (period <= high) & (place + period + block <= text.end[place])
    place, period = place[fits], period[fits]
    equal = text.same(level, place, place + period)
    return place[equal], period[equal]


def runs(values: np.ndarray, first: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (sequence, start, length, period) of all runs, in this order.

    A run is a stretch with smallest period q and a length of at least max(``least``, 2q) that cannot be made longer.
    A run of period q at least twice a block holds a whole block in its first period and the same one a period on; runs of
    smaller periods hold two of the smallest blocks, ``least`` being at least three of these.
    """
    if least < 3 * BASE:
        raise ValueError(f"runs of fewer than {3 * BASE} words are not sought")
    none = np.zeros((0, 4), np.int64)
    if len(values) < least:
        return none
    text = Sequences(values, first)
    index = WaveletMatrix(text.order)
    found = [none]
    level, longest = BASE.bit_length() - 1, int(np.diff(first).max())
    # Beyond the named lengths no factor occurs twice.
    while level < len(text.names) and (level == BASE.bit_length() - 1 or 2 * ((2 << level) - 1) <= longest):
        place, period = _candidates(text, index, level)
        if len(place):
            begin, end = text.extended(place, place + period)
            long = end - begin >= np.maximum(least, 2 * period)
            rows = np.c_[text.owner[place], begin, end - begin, period][long]
            found.append(np.unique(rows, axis=0) if len(rows) else none)
        level += 1
    rows = np.unique(np.concatenate(found), axis=0)
    # The same stretch has multiples of its smallest period too.
    rows = rows[np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)][: len(rows)]]
    rows[:, 1] -= first[rows[:, 0]]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _suspects(hashes: np.ndarray, words: textkit.Words) -> np.ndarray:
    """Rows in which some GRAM words in a row occur twice, by hash; without that there is no run."""
    heads = words.heads(GRAM)
    if not len(heads):
        return np.zeros(0, np.int64)
    row = words.rows()[heads]
    keys = textkit.mix(textkit.windows(hashes, heads, GRAM) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    keys = keys[order]
    return np.unique(row[order[1:][keys[1:] == keys[:-1]]])


def _words(words: textkit.Words, rows: np.ndarray) -> pa.Array:
    """The words of some rows, as they stand."""
    index = np.concatenate([np.arange(words.first[r], words.first[r + 1]) for r in rows])
    starts, ends = words.starts[index], words.ends[index]
    at = np.r_[0, np.cumsum(ends - starts)]
    data = words.data[np.arange(at[-1]) + np.repeat(starts - at[:-1], ends - starts)]
    return pa.Array.from_buffers(pa.large_binary(), len(index), [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])


def _searched(least: int):
    def chunk(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list[dict]], list[str]]:
        words = textkit.Words(data, offsets, textkit.SPACED)
        n = len(words.counts)
        raw, begin, _ = textkit.joined(words, offsets)
        collapsed = [raw[a:b].rstrip(b" ").decode() for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
        listed: list[list[dict]] = [[] for _ in range(n)]
        suspects = _suspects(words.hashes(), words)
        if not len(suspects):
            return words.counts, listed, collapsed
        own = _words(words, suspects)
        first = np.r_[0, np.cumsum(words.counts[suspects])]
        found = runs(own.dictionary_encode().indices.to_numpy().astype(np.int64), first, least)
        edges = textkit.stretches(found[:, 0])
        for a, b in edges:
            row, base = suspects[found[a, 0]], first[found[a, 0]]
            listed[row] = [{"start": s, "length": m, "period": q} for s, m, q in found[a:b, 1:].tolist()]
            size = int(words.counts[row])
            covered = np.zeros(size + 1, np.int64)
            np.add.at(covered, found[a:b, 1] + found[a:b, 3], 1)
            np.add.at(covered, found[a:b, 1] + found[a:b, 2], -1)
            kept = np.flatnonzero(np.cumsum(covered[:-1]) == 0)
            collapsed[row] = b" ".join(own.take(pa.array(base + kept)).to_pylist()).decode()
        return words.counts, listed, collapsed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textkit.bytes_of(batch.column("text"))
            for a, b in textkit.groups(offsets, CHUNK):
                own = offsets[a : b + 1]
                counts, listed, collapsed = chunk(data[own[0] : own[-1]], own - own[0])
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(a, b - a), pa.array(counts, pa.int64()), pa.array(listed, pa.list_(_RUN)), pa.array(collapsed, pa.string()),
                ], schema=_RUNS_ARROW)
        textkit.trim()

    return run


def repeated_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of (doc_id, text).

    ``runs`` are the stretches of at least ``least`` words, and of at least twice their smallest period, that no
    neighbouring word extends: start (a word's number, from 0), length and period, by start, then period.
    ``collapsed`` are the words, joined by one space, without those that any run has after its first period.

    Words are what lies between spaces and ASCII control spaces, compared as they are. Null and empty texts have no words, no
    runs and an empty ``collapsed``. Null ids stay null; rows that repeat give a row each; an empty table gives
    no rows; other columns are ignored. Documents are searched where they are read, some at a time; a long one by itself.
    """
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_searched(least), _RUNS)


def looped(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in which every text whose crc32(doc_id) ends in 0 goes on in a loop from some word on, as the query's contract wants it."""
    h = F.crc32(F.col("doc_id").cast("bigint").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.col("text").cast("string"), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), g.alias("g"), F.when(h % 10 == 0, words).alias("w"))
    n = F.size("w").cast("bigint")
    a = F.col("g") % n
    p = 1 + F.floor((n - a) / (3 + F.col("g") % 8))
    rows = rows.withColumn("a", F.when(n > 0, a).cast("int")).withColumn("p", F.when(n > 0, p).cast("int"))
    loop = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil((F.size("w") - F.col("a")) / F.col("p")).cast("int")))
    text = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(loop, F.lit(1), F.size("w") - F.col("a"))), " ")
    return rows.select("doc_id", F.when(F.size("w") > 0, text).otherwise(F.col("text")).alias("text"))
