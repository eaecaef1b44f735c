"""Substring dedup by seed and extend: winnowed anchors join documents, windows around them are extended and compared."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import textkit
from tallyweave.llm.shared import parts_for, text_bytes, written

LEAST = 35  # words of a repeat
ANCHOR = 8  # words of an anchor
BLOCK_BYTES = 2 << 20  # text of one block
PART_BYTES = 16 << 20  # text behind one part of the hash range, about

_PACKED = "block bigint, part int, data binary"
_PACKED_ARROW = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("data", pa.binary())])


def _rolling(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over ``width`` values from each place on, as far as there are so many."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = pick(values[: len(values) - step], values[step:])
        have += step
    return values


class Block:
    """Words of the texts of a block with their anchors."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, least: int, anchor: int):
        self.words, self.least, self.anchor, self.offsets = textkit.Words(data, offsets, textkit.SPACED), least, anchor, offsets
        n, span = len(self.words.starts), least - anchor + 1
        self.heads = self.words.heads(least)  # windows of a full repeat
        self.hashes = self.words.hashes()
        self.picked, self.prints = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if not len(self.heads):
            return
        grams = np.full(n + span, np.uint64(0xFFFFFFFFFFFFFFFF))
        at = self.words.heads(anchor)
        grams[at] = textkit.windows(self.hashes, at, anchor, 2)
        # An anchor is a least gram of some window; equal windows have theirs at the same places.
        self.least_gram = _rolling(grams, span, np.minimum)[self.heads]
        lowest = np.zeros(n + 2 * span, np.uint64)
        lowest[self.heads + span] = self.least_gram
        highest = _rolling(lowest, span, np.maximum)[1 : n + 1]
        self.picked = np.flatnonzero((highest > 0) & (grams[:n] == highest))
        self.prints = grams[self.picked]

    def candidates(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows whose least gram is a ``repeated`` anchor (these in order), with two hashes each."""
        if not len(self.heads) or not len(repeated):
            return (np.zeros(0, np.int64),) + (np.zeros(0, np.uint64),) * 2
        turn = textkit.runs(self.least_gram)  # windows in a row mostly have the same one
        grams = self.least_gram[turn]
        again = repeated[np.minimum(np.searchsorted(repeated, grams), len(repeated) - 1)] == grams
        heads = self.heads[np.repeat(again, np.diff(np.r_[turn, len(self.least_gram)]))]
        if not len(heads):
            return (heads,) + (np.zeros(0, np.uint64),) * 2
        return heads, textkit.windows(self.hashes, heads, self.least, 3), textkit.windows(self.words.hashes(1), heads, self.least, 4)

    def kept(self, heads: np.ndarray) -> np.ndarray:
        """Words outside the windows that begin at ``heads``."""
        step = np.zeros(len(self.words.starts) + 1, np.int64)
        step[heads] += 1
        np.subtract.at(step, heads + self.least, 1)
        return np.cumsum(step[:-1]) == 0


def _distinct(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the pairs, where each run of equal ones begins in it, and the sizes of the runs."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    at = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
    return order, at, np.diff(np.r_[at, len(a)])


def _pack(block: int, parts: int, first: np.ndarray, second: np.ndarray, twice: np.ndarray) -> Iterator[dict]:
    """Rows of one block, one per part of the hash range; hashes are in order and different from each other."""
    edges = np.searchsorted(textkit.buckets(first, parts), np.arange(parts + 1))
    for part in np.flatnonzero(np.diff(edges)).tolist():
        own = slice(edges[part], edges[part + 1])
        yield {"block": block, "part": part, "data": first[own].tobytes() + second[own].tobytes() + twice[own].astype(np.uint8).tobytes()}


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data) // 17
    return np.frombuffer(data, np.uint64, n), np.frombuffer(data, np.uint64, n, 8 * n), np.frombuffer(data, np.uint8, n, 16 * n).astype(bool)


def _repeats(table: pa.Table) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per row of a part: its block, the part, its first hashes, and which of them occur elsewhere too."""
    rows = [_unpack(x) for x in table.column("data").to_pylist()]
    first, second, twice = (np.concatenate(x) for x in zip(*rows, strict=True))
    order, at, sizes = _distinct(first, second)
    found = np.zeros(len(first), bool)
    found[order] = np.repeat((sizes > 1) | np.maximum.reduceat(twice[order], at), sizes)
    ends = np.cumsum([len(x[0]) for x in rows]).tolist()
    places = zip(table.column("block").to_pylist(), table.column("part").to_pylist(), rows, ends, strict=True)
    textkit.trim()
    return [(block, part, row[0], found[end - len(row[0]) : end]) for block, part, row, end in places]


def _store(least: int, anchor: int, parts: int):
    """Blocks of documents as rows of their own, beside the anchors in them."""

    def flush(number: int, gathered: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = pa.Table.from_batches(gathered).combine_chunks().to_batches()[0]
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(batch)
        yield pa.RecordBatch.from_pylist([{"block": number, "part": -1, "data": sink.getvalue().to_pybytes()}], schema=_PACKED_ARROW)
        prints = Block(*textkit.bytes_of(batch.column("text")), least, anchor).prints
        values, counts = np.unique(prints, return_counts=True)
        rows = list(_pack(number, parts, values, np.zeros(len(values), np.uint64), counts > 1))
        textkit.trim()
        yield pa.RecordBatch.from_pylist(rows, schema=_PACKED_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        gathered, size = [], 0
        for batch in batches:
            _, offsets = textkit.bytes_of(batch.column("text"))
            for first, last in textkit.groups(offsets, BLOCK_BYTES // 4):
                own = int(offsets[last] - offsets[first])
                if gathered and size + own > BLOCK_BYTES:
                    yield from flush(number, gathered)
                    number, gathered, size = number + 1, [], 0
                gathered.append(batch.slice(first, last - first))
                size += own
        if gathered:
            yield from flush(number, gathered)

    return run


def _seeds(table: pa.Table) -> pa.Table:
    rows = [{"block": b, "part": p, "data": first[found].tobytes()} for b, p, first, found in _repeats(table) if found.any()]
    return pa.Table.from_pylist(rows, schema=_PACKED_ARROW)


def _seen_again(table: pa.Table) -> pa.Table:
    rows = [{"block": b, "part": p, "data": np.packbits(found).tobytes()} for b, p, _, found in _repeats(table)]
    return pa.Table.from_pylist(rows, schema=_PACKED_ARROW)


def _opened(stored: pa.Table, seeds: pa.Table, least: int, anchor: int):
    """The documents of a block and its windows to compare: order of the windows, runs of equal ones, their hashes."""
    batch = pa.ipc.open_stream(stored.column("data")[0].as_buffer()).read_next_batch()
    block = Block(*textkit.bytes_of(batch.column("text")), least, anchor)
    parts = sorted(zip(seeds.column("part").to_pylist(), seeds.column("data").to_pylist(), strict=True))
    repeated = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for _, x in parts)])
    heads, first, second = block.candidates(repeated)
    return batch, block, heads, first, second, _distinct(first, second)


def _extend(least: int, anchor: int, parts: int):
    def run(stored: pa.Table, seeds: pa.Table) -> pa.Table:
        if not stored.num_rows or not seeds.num_rows:
            return _PACKED_ARROW.empty_table()
        _, _, _, first, second, (order, at, sizes) = _opened(stored, seeds, least, anchor)
        one = order[at]
        textkit.trim()
        return pa.Table.from_pylist(list(_pack(stored.column("block")[0].as_py(), parts, first[one], second[one], sizes > 1)), schema=_PACKED_ARROW)

    return run


SCHEMA = "doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept_sha256 string, kept_text string"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _cut(least: int, anchor: int, parts: int, with_text: bool):
    def run(stored: pa.Table, messages: pa.Table) -> pa.Table:
        # Seeds have parts from 0 on; what came back for the windows is kept below 0.
        known = messages.column("part").to_numpy()
        seeds = messages.filter(pa.array(known >= 0))
        batch, block, heads, first, _, (order, at, sizes) = _opened(stored, seeds, least, anchor)
        answers = messages.filter(pa.array(known < 0))
        found = np.zeros(len(at), bool)
        edges = np.searchsorted(textkit.buckets(first[order[at]], parts), np.arange(parts + 1))
        for part, bits in zip(answers.column("part").to_pylist(), answers.column("data").to_pylist(), strict=True):
            low, high = edges[-1 - part], edges[-part]
            found[low:high] = np.unpackbits(np.frombuffer(bits, np.uint8), count=high - low)
        again = np.zeros(len(heads), bool)
        again[order] = np.repeat(found, sizes)
        kept = block.kept(heads[again])
        words = block.words
        raw, bounds, _ = textkit.joined(words, block.offsets, kept)
        texts = [raw[a:b].rstrip(b" ") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        # Maximal repeats: runs of removed words within one document.
        rows = words.rows()
        turn = np.flatnonzero(np.diff(np.r_[False, ~kept, False].astype(np.int8)))
        spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        for low, high in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True):
            while low < high:  # removed words at the end of one document may meet those of the next
                row = int(rows[low])
                end = min(high, int(words.first[row + 1]))
                spans[row].append({"start": low - int(words.first[row]), "end": end - int(words.first[row])})
                low = end
        textkit.trim()
        return pa.table(
            {
                "doc_id": batch.column("doc_id"),
                "n_words": pa.array(words.counts, pa.int64()),
                "n_removed": pa.array(textkit.row_sums(~kept, words.first), pa.int64()),
                "spans": pa.array(spans, _SPANS),
                "kept_sha256": [hashlib.sha256(t).hexdigest() for t in texts],
                "kept_text": pa.array([t.decode() for t in texts] if with_text else [None] * len(texts), pa.string()),
            }
        )

    return run


def without_repeats(docs: DataFrame, least: int = LEAST, anchor: int = ANCHOR, with_text: bool = True) -> DataFrame:
    """Documents (doc_id, text) less the words of passages of ``least`` words or more that occur more than once.

    1. Seeds: of every ``least`` words at least one gram of ``anchor`` words is an anchor
       (winnowing). Documents are read once, kept as blocks in the shared folder, and send the
       different anchors of each block to their part of the hash range, which answers with those met elsewhere.
    2. Extension: around anchors met elsewhere, every window of ``least`` words whose
       own anchor is one is compared, by 128 bits of hash, with all others, again by parts of the hash range.
    3. Windows that occur elsewhere, in the same document too, join to maximal repeats, whose words go.

    A block sends each hash once, however often it holds it, so a passage that a third of all
    documents share costs a part one entry per block. All windows are judged on the input.

    Returns doc_id, n_words, n_removed, ``spans`` (word ranges removed), kept_sha256 and, unless
    ``with_text`` is false, ``kept_text``: the kept words joined by one space. Null and empty
    texts have no words. Each row gives a row, repeated rows and ids too; an empty table gives none.
    """
    if not 0 < anchor <= least:
        raise ValueError("an anchor must fit the least repeat")
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = parts_for(text_bytes(narrow), PART_BYTES)
    stored = written(narrow.mapInArrow(_store(least, anchor, parts), _PACKED), "blocks", by="part < 0")
    texts, anchors = (stored.filter(F.col("apart") == k).select("block", "part", "data") for k in (True, False))
    seeds = written(anchors.groupBy("part").applyInArrow(_seeds, _PACKED), "seeds")
    sent = texts.groupBy("block").cogroup(seeds.groupBy("block")).applyInArrow(_extend(least, anchor, parts), _PACKED)
    answers = sent.groupBy("part").applyInArrow(_seen_again, _PACKED).withColumn("part", (-1 - F.col("part")).cast("int"))
    messages = seeds.unionByName(answers)
    return texts.groupBy("block").cogroup(messages.groupBy("block")).applyInArrow(_cut(least, anchor, parts, with_text), SCHEMA)
