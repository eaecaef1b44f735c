"""Benchmark decontamination: suffix arrays over shards of the corpus, searched for every suffix of the benchmark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import textkit
from tallyweave.llm.shared import scratch
from tallyweave.llm.stores import record_batches

WINDOW = 10  # words of a benchmark item that must recur verbatim
SHARD_BYTES = 1 << 20  # text behind one suffix array
ITEMS_PER_BLOCK = 20_000  # benchmark items searched at a time

SCHEMA = (
    "doc_id bigint, n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>, "
    "longest bigint, longest_at bigint, longest_item string"
)


def suffix_array(ids: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Positions of ``ids`` (0 ends a document) in the order of the word sequences that begin there.

    ``stop`` is the end of each position's document. The first words are packed into one
    sort key; what is still equal is sorted by the rank of what follows, over distances
    that double, until no two suffixes tie or tying ones have both ended.
    """
    n = len(ids)
    width = max(1, int(ids.max(initial=0)).bit_length())
    depth = max(1, 63 // width)
    key = np.zeros(n, np.uint64)
    at = np.arange(n)
    for step in range(depth):
        key = key << np.uint64(width) | ids[np.minimum(at + step, stop)].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    first = textkit.runs(ordered)
    sizes = np.diff(np.r_[first, n])
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, sizes)
    slots = np.flatnonzero(np.repeat(sizes > 1, sizes))
    slots = slots[order[slots] + depth < stop[order[slots]]]
    while len(slots):
        members = order[slots]
        # The end of a document sorts before any word.
        ahead = np.where(members + depth < stop[members], rank[np.minimum(members + depth, stop[members])] + 1, 0)
        pair = rank[members].astype(np.uint64) << np.uint64(32) | ahead.astype(np.uint64)
        inner = np.argsort(pair, kind="stable")
        members, pair = members[inner], pair[inner]
        order[slots] = members
        first = textkit.runs(pair)
        sizes = np.diff(np.r_[first, len(pair)])
        rank[members] = np.repeat(slots[first], sizes)
        depth *= 2
        tied = np.repeat(sizes > 1, sizes) & (members + depth < stop[members])
        slots = slots[tied]
    return order


class Shard:
    """Words of some documents with their suffix array."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.words = textkit.Words(data, offsets, textkit.ALPHANUMERIC)
        self.vocabulary, ids = np.unique(self.words.hashes(), return_inverse=True)
        rows = self.words.rows()
        # One 0 after each document keeps suffixes inside it.
        self.ids = np.zeros(len(ids) + len(offsets) - 1, np.int64)
        self.place = np.arange(len(ids)) + rows
        self.ids[self.place] = ids + 1
        self.begin = self.words.first[:-1] + np.arange(len(offsets) - 1)
        self.stop = self.begin + self.words.counts
        self.row = np.repeat(np.arange(len(offsets) - 1), self.words.counts + 1)
        self.order = suffix_array(self.ids, self.stop[self.row])
        self.second: np.ndarray | None = None

    def renamed(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers of this shard for hashes of other words; -1 where it lacks them."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, -1)

    def bounds(self, wanted: np.ndarray, heads: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the suffix array whose first ``lengths`` words are those of ``wanted`` from ``heads`` on."""
        low, high = (self._bound(wanted, heads, lengths, after) for after in (False, True))
        return low, high

    def _bound(self, wanted, heads, lengths, after: bool) -> np.ndarray:
        low, high = np.zeros(len(heads), np.int64), np.full(len(heads), len(self.order))
        open_ = np.flatnonzero(low < high)
        stops = self.stop[self.row]
        while len(open_):
            middle = (low[open_] + high[open_]) // 2
            suffix = self.order[middle]
            sign = np.zeros(len(open_), np.int64)
            live = np.arange(len(open_))
            step = 0
            while len(live):
                mine = self.ids[np.minimum(suffix[live] + step, stops[suffix[live]])]
                sign[live] = np.sign(mine - wanted[heads[open_[live]] + step])
                step += 1
                live = live[(sign[live] == 0) & (step < lengths[open_[live]])]
            right = sign <= 0 if after else sign < 0
            low[open_[right]] = middle[right] + 1
            high[open_[~right]] = middle[~right]
            open_ = open_[low[open_] < high[open_]]
        return low

    def second_hash(self) -> np.ndarray:
        """Another hash of every word, by which matches are confirmed."""
        if self.second is None:
            self.second = np.zeros(len(self.ids), np.uint64)
            self.second[self.place] = self.words.hashes(1)
        return self.second


class Items:
    """The words of a block of benchmark items, each followed by a gap."""

    def __init__(self, ids: list[str | None], column: pa.Array, window: int):
        data, offsets = textkit.bytes_of(column)
        words = textkit.Words(textkit.LOWER[data], offsets, textkit.ALPHANUMERIC)
        rows = words.rows()
        place = np.arange(len(rows)) + rows
        size = len(rows) + len(ids)
        self.item_ids = ids
        self.hashes, self.second = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.hashes[place], self.second[place] = words.hashes(), words.hashes(1)
        self.known = np.zeros(size, bool)
        self.known[place] = True
        self.row = np.repeat(np.arange(len(ids)), words.counts + 1)
        self.stop = (words.first[1:] + np.arange(len(ids)))[self.row]
        wide = place[place + window <= self.stop[place]]
        brief = np.flatnonzero((words.counts > 0) & (words.counts < window))
        brief_at = words.first[:-1][brief] + brief
        self.heads = np.r_[wide, brief_at]
        self.lengths = np.r_[np.full(len(wide), window), words.counts[brief]]

    def hits(self, shard: Shard) -> tuple[np.ndarray, ...]:
        """Every place of the shard at which a window of an item occurs: place, window's length, item, length of the whole match."""
        wanted = np.where(self.known, shard.renamed(self.hashes), -1)
        absent = np.r_[0, np.cumsum(wanted < 0)]
        whole = absent[self.heads + self.lengths] == absent[self.heads]
        heads, lengths = self.heads[whole], self.lengths[whole]
        low, high = shard.bounds(wanted, heads, lengths)
        each = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(heads)), each)
        if not len(which):
            return (np.zeros(0, np.int64),) * 4
        inside = np.arange(len(which)) - np.repeat(np.cumsum(each) - each, each)
        place, head, length = shard.order[low[which] + inside], heads[which], lengths[which]
        second, same, step = shard.second_hash(), np.ones(len(place), bool), 0
        while (live := np.flatnonzero(same & (step < length))).size:
            same[live] = second[place[live] + step] == self.second[head[live] + step]
            step += 1
        place, head, length = place[same], head[same], length[same]
        match, live = length.copy(), np.arange(len(place))
        while len(live):
            a, b = place[live] + match[live], head[live] + match[live]
            inside = (a < shard.stop[shard.row[place[live]]]) & (b < self.stop[head[live]])
            a, b, live = a[inside], b[inside], live[inside]
            more = (shard.ids[a] == wanted[b]) & (second[a] == self.second[b])
            live = live[more]
            match[live] += 1
        return place, length, self.row[head], match


class Found:
    """What the hits in a shard come to: the words covered and, per row, the items and the longest match. No hit is kept by itself."""

    def __init__(self, shard: Shard, rows: int):
        self.shard, self.edges = shard, np.zeros(len(shard.ids) + 1, np.int64)
        self.items: list[set[str]] = [set() for _ in range(rows)]
        self.longest: list[tuple[int, int | None, str | None]] = [(0, None, None)] * rows

    def add(self, items: Items) -> None:
        place, length, item, match = items.hits(self.shard)
        if not len(place):
            return
        self.edges += np.bincount(place, minlength=len(self.edges)) - np.bincount(place + length, minlength=len(self.edges))
        row = self.shard.row[place]
        for r, i in np.unique(np.c_[row, item], axis=0).tolist():
            if items.item_ids[i] is not None:
                self.items[r].add(items.item_ids[i])
        # Of each row the longest match, of equally long ones the first.
        order = np.lexsort((place, -match, row))
        for n in order[textkit.runs(row[order])].tolist():
            r = int(row[n])
            size, at = int(match[n]), int(place[n] - self.shard.begin[r])
            known = self.longest[r]
            if size > known[0] or size == known[0] and at < known[1]:
                self.longest[r] = (size, at, items.item_ids[item[n]])

    def spans(self) -> list[list[dict[str, int]]]:
        """Per row the stretches of covered words, from its own first word on."""
        out: list[list[dict[str, int]]] = [[] for _ in self.items]
        inside = np.r_[False, np.cumsum(self.edges) > 0]
        starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
        rows = self.shard.row[starts]
        for r, start, end in zip(rows.tolist(), (starts - self.shard.begin[rows]).tolist(), (ends - self.shard.begin[rows]).tolist(), strict=True):
            out[r].append({"start": start, "end": end})
        return out

    def hit(self) -> np.ndarray:
        """Whether each row has a hit."""
        out = np.zeros(len(self.items), bool)
        out[self.shard.row[np.flatnonzero(self.edges[:-1] > 0)]] = True
        return out


def _shards(folder: str, window: int, shard_bytes: int, row_of):
    """Search the shards of each batch; ``row_of`` makes what is returned of a shard's rows and what was found in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[Items] | None = None
        for batch in batches:
            data, offsets = textkit.bytes_of(batch.column("text"))
            data = textkit.LOWER[data]
            if blocks is None:
                source = _blocks(folder, window)
                blocks = [b for _, b in zip(range(2), source, strict=False)]
                source.close()
            # One block of items is kept. A larger benchmark is read anew for each batch, whose shards then are all held.
            ranges, held = list(textkit.groups(offsets, shard_bytes)), []
            for first, last in ranges:
                own = offsets[first : last + 1]
                found = Found(Shard(data[own[0] : own[-1]], own - own[0]), last - first)
                if len(blocks) > 1:
                    held.append(found)
                    continue
                for items in blocks:
                    found.add(items)
                yield row_of(batch.slice(first, last - first), found)
            if held:
                for items in _blocks(folder, window):
                    for found in held:
                        found.add(items)
                for (first, last), found in zip(ranges, held, strict=True):
                    yield row_of(batch.slice(first, last - first), found)
            textkit.trim()

    return run


def _blocks(folder: str, window: int) -> Iterator[Items]:
    for batch in record_batches(folder, ITEMS_PER_BLOCK):
        yield Items(batch.column("item_id").to_pylist(), batch.column("text"), window)


def _rows(batch: pa.RecordBatch, found: Found) -> pa.RecordBatch:
    return pa.record_batch(
        {
            "doc_id": batch.column("doc_id"),
            "n_words": pa.array(found.shard.words.counts, pa.int64()),
            "spans": pa.array(found.spans(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            "items": pa.array([sorted(x) for x in found.items], pa.list_(pa.string())),
            "longest": pa.array([x[0] for x in found.longest], pa.int64()),
            "longest_at": pa.array([x[1] for x in found.longest], pa.int64()),
            "longest_item": pa.array([x[2] for x in found.longest], pa.string()),
        }
    )


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Find the verbatim passages that documents (doc_id, text) share with benchmark items (item_id, text).

    A-Z are lower-cased; words are runs of digits, letters and characters beyond ASCII. Each
    task builds suffix arrays over shards of the documents it reads and binary-searches
    every benchmark suffix of ``window`` words in them; an item with fewer words is searched
    whole. Nothing is shuffled, and a task holds one shard and one block of items at a time.

    Returns per document: doc_id, n_words, ``spans`` (merged ranges of words inside an
    occurrence), ``items`` (ids as text, in order), and the ``longest`` match in words with
    its place (``longest_at``) and item; ties go to the earliest place.

    Null and empty texts have no words and no spans. Items without words are never found;
    items without an id mark spans but are not listed; repeated items and ids count once.
    Repeated rows and ids of documents give one row each. An empty table gives no rows or no
    spans. Other columns are ignored.
    """
    folder = _stored(benchmark)
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_shards(folder, window, shard_bytes, _rows), SCHEMA)


def _stored(benchmark: DataFrame) -> str:
    folder = scratch(benchmark.sparkSession, "benchmark")
    benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).write.parquet(folder)
    return folder


def _clean(batch: pa.RecordBatch, found: Found) -> pa.RecordBatch:
    return batch.select(["_row"]).filter(pa.array(~found.hit()))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The documents, whole and with their columns, in which no window of the benchmark occurs.

    Every row is judged by its own ``text``, where it is read: nothing is shuffled, and ids, null
    or repeated, play no part. Texts that are null, empty or without words stay.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").cast("string").alias("text"))
    kept = rows.mapInArrow(_shards(_stored(benchmark), window, shard_bytes, _clean), rows.select("_row").schema)
    return kept.select("_row.*")
