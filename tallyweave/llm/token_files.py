"""Token files: patched frame-of-reference blocks of token ids with exception lists and a block index.

A file holds the ids of consecutive documents, little-endian throughout::

    magic "PFOR1\\0\\0\\0" | u32 ids in a block | u32 documents | u64 ids | u64 blocks
    documents: i64 doc_id, u8 null flag (all ids, then all flags), u64 first id of each and the end
    block index: u64 where each block begins in the body, and the end
    body, per block: u32 minimum | u8 width | u16 exceptions | packed offsets | u8 places | u32 offsets of the exceptions

Offsets from the block's minimum are packed at the smallest width that fits the chosen
percentile of them; the few beyond it are listed as exceptions with their places.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm import textkit
from tallyweave.llm.shared import scratch, text_bytes, written
from tallyweave.llm.stores import get, put

BLOCK = 128  # ids, at most 256
PERCENTILE = 97  # of a block's offsets that fit the packed width
FILE_TEXT_BYTES = 4 << 20  # text behind one file, about
TEXT_AT_ONCE = 1 << 20  # bytes encoded together
ROWS_AT_ONCE = 256
CACHED_PIECES = 500_000  # per worker; only a memo, it is emptied when full

MAGIC = b"PFOR1\0\0\0"
HEAD = struct.Struct("<8sIIQQ")

# Kinds of characters, as the pre-tokenizer of this family of vocabularies cuts texts into pieces.
LETTER, NUMBER, OTHER, SPACE = 1, 2, 3, 4
KINDS = np.full(256, OTHER, np.uint8)
KINDS[0x30:0x3A] = NUMBER
KINDS[0x41:0x5B] = KINDS[0x61:0x7B] = LETTER
KINDS[[0x09, 0x0A, 0x0D, 0x20]] = SPACE
KINDS[0x80:] = LETTER  # of the familiar texts: U+00C0 to U+024F without the two signs between them
# Texts with other characters go to the library whole: its idea of a letter may be of another Unicode version.
UNFAMILIAR = np.zeros(256, bool)
UNFAMILIAR[:0x20] = UNFAMILIAR[0x7F] = UNFAMILIAR[0xC0:0xC3] = UNFAMILIAR[0xCA:] = True
UNFAMILIAR[[0x09, 0x0A, 0x0D]] = False
# What follows an apostrophe in pieces of their own.
SHORT_FORMS = (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll")


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or the next free one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of familiar texts begin: a run of letters, digits or other signs with the one space before it, or white space."""
    kinds = KINDS[data]
    turn = np.ones(len(data), bool)
    turn[1:] = kinds[1:] != kinds[:-1]
    heads = np.zeros(len(data), bool)
    heads[offsets[:-1][offsets[:-1] < len(data)]] = True
    turn |= heads
    blank = kinds == SPACE
    begins = turn.copy()
    word = np.flatnonzero(turn & ~blank & ~heads)
    led = word[blank[word - 1]]
    begins[led - 1] = True  # the last white space before a run is no part of the white space before it
    begins[led[data[led - 1] == 0x20]] = False  # and belongs to the run if it is a space
    quote = np.flatnonzero((data == 0x27) & begins)
    quote = quote[quote + 1 < len(data)]
    quote = quote[turn[quote + 1] & ~heads[quote + 1] & (kinds[quote + 1] == LETTER)]
    for form in SHORT_FORMS:
        hit = quote[quote + len(form) < len(data)] if len(form) > 1 else quote
        for i, letter in enumerate(form):
            hit = hit[(data[hit + 1 + i] == letter) & ((i == 0) | ~heads[hit + 1 + i])]
        begins[hit + 1] = False
        after = hit + 1 + len(form)
        begins[after[after < len(data)]] = True
    return np.flatnonzero(begins)


class Encoder:
    """Ids of texts by the tokenizers library; pieces met before are remembered, for merges never cross them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.clear()

    def clear(self) -> None:
        self.known, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # hashes in order, and where each piece stands
        self.size, self.filled = 0, 0
        self.check = np.zeros(1 << 16, np.uint64)
        self.at = np.zeros((1 << 16) + 1, np.int64)
        self.pool = np.zeros(1 << 18, np.uint32)

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        """Where the pieces of these hashes stand, -1 for those not met yet."""
        out = np.full(len(hashes), -1, np.int64)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
            met = self.known[at] == hashes
            out[met] = self.place[at[met]]
        return out

    def _learn(self, hashes: np.ndarray, checks: np.ndarray, pieces: list[bytes]) -> None:
        """Encode new pieces with the library's merges and keep their ids."""
        tokenize, letters = self.library.model.tokenize, self.letters
        ids = [[token.id for token in tokenize(piece.decode("latin-1").translate(letters))] for piece in pieces]
        lengths = np.array([len(x) for x in ids], np.int64)
        flat = np.array([x for own in ids for x in own], np.uint32)
        while self.size + len(ids) >= len(self.check):
            self.check, self.at = np.r_[self.check, np.zeros_like(self.check)], np.r_[self.at, np.zeros_like(self.at)]
        while self.filled + len(flat) > len(self.pool):
            self.pool = np.r_[self.pool, np.zeros_like(self.pool)]
        self.check[self.size : self.size + len(ids)] = checks
        self.at[self.size + 1 : self.size + len(ids) + 1] = self.filled + np.cumsum(lengths)
        self.pool[self.filled : self.filled + len(flat)] = flat
        into = np.searchsorted(self.known, hashes)
        self.known, self.place = np.insert(self.known, into, hashes), np.insert(self.place, into, np.arange(self.size, self.size + len(ids)))
        self.size, self.filled = self.size + len(ids), self.filled + len(flat)

    def whole(self, text: bytes) -> np.ndarray:
        return np.array(self.library.encode(text.decode(), add_special_tokens=False).ids, np.uint32)

    def _familiar(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        odd = UNFAMILIAR[data]
        signs = np.flatnonzero(data[:-1] == 0xC3)
        odd[signs] |= (data[signs + 1] == 0x97) | (data[signs + 1] == 0xB7)
        strange = textkit.row_sums(odd.view(np.int8).astype(np.int64), offsets) > 0
        raw = data.tobytes()
        for mark in self.special:
            at = raw.find(mark)
            while at >= 0:
                strange[np.searchsorted(offsets, at, "right") - 1] = True
                at = raw.find(mark, at + 1)
        return ~strange

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows in turn, and how many each row has."""
        familiar = self._familiar(data, offsets)
        if familiar.all():
            return self._pieces(data, offsets)
        counts = np.zeros(len(familiar), np.int64)
        parts: list[np.ndarray] = []
        edges = np.flatnonzero(np.r_[True, familiar[1:] != familiar[:-1], True])
        for first, last in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if familiar[first]:
                own = offsets[first : last + 1]
                ids, counts[first:last] = self._pieces(data[own[0] : own[-1]], own - own[0])
                parts.append(ids)
                continue
            for row in range(first, last):
                parts.append(self.whole(data[offsets[row] : offsets[row + 1]].tobytes()))
                counts[row] = len(parts[-1])
        return np.concatenate(parts), counts

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = piece_starts(data, offsets)
        ends = np.r_[starts[1:], len(data)].astype(np.int64)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        checks = textkit.spans(data, starts, ends, 1)
        hashes, place, which = np.unique(textkit.spans(data, starts, ends), return_index=True, return_inverse=True)
        if self.size + len(hashes) > CACHED_PIECES:
            self.clear()
        known = self._places(hashes)
        new = np.flatnonzero(known < 0)
        if len(new):
            raw = data.tobytes()
            pieces = [raw[a:b] for a, b in zip(starts[place[new]].tolist(), ends[place[new]].tolist(), strict=True)]
            known[new] = np.arange(self.size, self.size + len(new))
            self._learn(hashes[new], checks[place[new]], pieces)
        each = known[which]
        if not (self.check[each] == checks).all():  # two pieces of one hash
            found = [self.whole(data[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            return np.concatenate(found), np.array([len(x) for x in found], np.int64)
        low, length = self.at[each], self.at[each + 1] - self.at[each]
        total = np.r_[0, np.cumsum(length)]
        ids = self.pool[np.repeat(low - total[:-1], length) + np.arange(total[-1])]
        return ids, np.diff(total[np.searchsorted(starts, offsets)])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of offsets as rows of packed bytes, ``width`` bits each."""
    narrow = values.astype("<u2" if width <= 16 else "<u4")
    bits = np.unpackbits(narrow.view(np.uint8).reshape(-1, narrow.itemsize), axis=1, count=width, bitorder="little")
    return np.packbits(bits.reshape(len(values), -1), axis=1, bitorder="little")


def unpack(packed: np.ndarray, width: int, block: int) -> np.ndarray:
    bits = np.unpackbits(packed, axis=1, count=block * width, bitorder="little").reshape(-1, width)
    size = 2 if width <= 16 else 4
    full = np.zeros((len(bits), 8 * size), np.uint8)
    full[:, :width] = bits
    return np.packbits(full.ravel(), bitorder="little").view(f"<u{size}").reshape(len(packed), block)


_WIDTHS = np.r_[0, np.repeat(np.arange(1, 17), 1 << np.arange(16))].astype(np.uint8)  # of all 16-bit values


def bit_widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value takes."""
    high = values >> np.uint32(16)
    low = _WIDTHS[values & np.uint32(0xFFFF)]
    return np.where(high > 0, _WIDTHS[high] + 16, low).astype(np.uint8) if high.any() else low


def encode_file(ids: np.ndarray, doc_ids: np.ndarray, missing: np.ndarray, firsts: np.ndarray, block: int = BLOCK, percentile: int = PERCENTILE) -> bytes:
    """One file of ``ids``; document i has those from ``firsts[i]`` to ``firsts[i + 1]``; ``missing`` marks documents without an id."""
    count = -(-len(ids) // block)
    padded = np.zeros(count * block, np.uint32)
    padded[: len(ids)] = ids
    if len(padded) > len(ids):
        padded[len(ids) :] = ids[(count - 1) * block :].min()  # costs no bits
    rows = padded.reshape(count, block)
    least = rows.min(axis=1) if count else np.zeros(0, np.uint32)
    offsets = rows - least[:, None]
    bits = bit_widths(offsets)
    rank = min(block - 1, -(-block * percentile // 100) - 1)
    widths = np.partition(bits, rank, axis=1)[:, rank].astype(np.int64)
    beyond = bits > widths[:, None]
    outliers = np.count_nonzero(beyond, axis=1)
    lengths = 7 + (block * widths + 7) // 8 + 5 * outliers
    index = np.r_[0, np.cumsum(lengths)].astype("<u8")
    body = np.zeros(int(index[-1]), np.uint8)
    at = index[:-1].astype(np.int64)
    for raw, skip in ((least.astype("<u4"), 0), (widths.astype("u1"), 4), (outliers.astype("<u2"), 5)):
        body[at[:, None] + skip + np.arange(raw.itemsize)] = raw.view(np.uint8).reshape(-1, raw.itemsize)
    for width in np.unique(widths[widths > 0]):
        same = np.flatnonzero(widths == width)
        packed = pack(offsets[same] & np.uint32((1 << int(width)) - 1), int(width))
        body[(at[same] + 7)[:, None] + np.arange(packed.shape[1])] = packed
    which, place = np.nonzero(beyond)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(outliers) - outliers, outliers)
    tail = at + 7 + (block * widths + 7) // 8
    body[tail[which] + nth] = place
    body[(tail[which] + outliers[which] + 4 * nth)[:, None] + np.arange(4)] = offsets[which, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    head = HEAD.pack(MAGIC, block, len(doc_ids), len(ids), count)
    return head + doc_ids.astype("<i8").tobytes() + missing.astype("u1").tobytes() + firsts.astype("<u8").tobytes() + index.tobytes() + body.tobytes()


def decode_file(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ids, the doc_ids, which of these are missing, and where each document begins."""
    magic, block, documents, total, count = HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = HEAD.size
    doc_ids = np.frombuffer(raw, "<i8", documents, at)
    missing = np.frombuffer(raw, "u1", documents, at + 8 * documents).astype(bool)
    at += 9 * documents
    firsts = np.frombuffer(raw, "<u8", documents + 1, at).astype(np.int64)
    index = np.frombuffer(raw, "<u8", count + 1, at + 8 * (documents + 1)).astype(np.int64)
    body = np.frombuffer(raw, np.uint8, offset=at + 8 * (documents + count + 2))
    begin = index[:-1]
    if not count:
        return np.zeros(0, "<u4"), doc_ids, missing, firsts

    def field(where: np.ndarray, kind: str) -> np.ndarray:
        return body[where[:, None] + np.arange(np.dtype(kind).itemsize)].view(kind).ravel()

    least, widths, outliers = field(begin, "<u4"), field(begin + 4, "u1").astype(np.int64), field(begin + 5, "<u2").astype(np.int64)
    out = np.zeros((count, block), "<u4")
    for width in np.unique(widths[widths > 0]):
        same = np.flatnonzero(widths == width)
        out[same] = unpack(body[(begin[same] + 7)[:, None] + np.arange((block * width + 7) // 8)], int(width), block)
    which = np.repeat(np.arange(count), outliers)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(outliers) - outliers, outliers)
    tail = (begin + 7 + (block * widths + 7) // 8)[which]
    out[which, field(tail + nth, "u1")] = field(tail + outliers[which] + 4 * nth, "<u4")
    out += least[:, None]
    return out.ravel()[:total], doc_ids, missing, firsts


MANIFEST = "part int, file int, path string, n_docs bigint, n_tokens bigint, n_bytes bigint"


_MANIFEST_ARROW = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])


def _write(folder: str, vocabulary: str, end_id: int, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        tool = encoder(vocabulary)
        rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        gathered, files = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal gathered, files
            doc_ids, missing, ids, counts = (np.concatenate(x) for x in zip(*rows, strict=True))
            path = f"{folder}/{part:08d}-{files:06d}-{attempt}.pfor"
            raw = encode_file(ids, doc_ids, missing, np.r_[0, np.cumsum(counts)])
            put(path, raw)
            row = {"part": [part], "file": [files], "path": [path], "n_docs": [len(doc_ids)], "n_tokens": [len(ids)], "n_bytes": [len(raw)]}
            rows.clear()
            textkit.trim()
            gathered, files = 0, files + 1
            return pa.record_batch(row, schema=_MANIFEST_ARROW)

        for batch in batches:
            data, offsets = textkit.bytes_of(batch.column("text"))
            doc_ids, missing = batch.column("doc_id").fill_null(0).to_numpy(), batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            for first, last in textkit.groups(offsets, TEXT_AT_ONCE):
                own = offsets[first : last + 1]
                ids, counts = tool.encode(data[own[0] : own[-1]], own - own[0])
                ended = np.insert(ids, np.cumsum(counts), end_id)
                rows.append((doc_ids[first:last], missing[first:last], ended, counts + 1))
                gathered += int(own[-1] - own[0])
                if gathered >= file_bytes:
                    yield flush()
        if rows:
            yield flush()

    return run


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None, file_bytes: int = FILE_TEXT_BYTES) -> DataFrame:
    """Encode documents (doc_id, text) and write their ids, in ascending order of doc_id, as token files.

    Rows are dealt by ranges of doc_id and sorted within them (ids that are null first, equal
    ids by text), encoded in the tasks and written to ``folder`` (by default a new one below
    the shared folder). ``end_id`` follows each document. ``vocabulary`` is the path of a
    tokenizers file that every worker has.

    Returns the manifest, a table in the shared folder: one row per file with its ``path``,
    number, ``n_docs``, ``n_tokens``, ``n_bytes`` and ``start``, the ids in the files before
    it. Files that a lost attempt left are not in it. Null and empty texts are documents of
    the end id alone; an empty table gives an empty manifest; other columns are ignored.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), text_bytes(narrow) // (16 * file_bytes))
    ordered = narrow.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    files = written(ordered.mapInArrow(_write(folder, vocabulary, end_id, file_bytes), MANIFEST), "manifest")
    # The sums of the parts first, so that no single window holds the rows of all files.
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("own"))
    bases = sums.select("part", (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias("base"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("file")) - F.col("n_tokens")
    return files.withColumn("inside", inside).join(bases, "part").withColumn("start", F.col("base") + F.col("inside")).drop("base", "inside")


def _read(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                ids, doc_ids, missing, firsts = decode_file(get(path))
                raw = memoryview(ids.tobytes())
                cut = list(zip((4 * firsts[:-1]).tolist(), (4 * firsts[1:]).tolist(), strict=True))
                for low in range(0, len(cut), ROWS_AT_ONCE):
                    own = cut[low : low + ROWS_AT_ONCE]
                    n = slice(low, low + len(own))
                    columns = {
                        "doc_id": pa.array(doc_ids[n], pa.int64(), mask=missing[n]),
                        "start": pa.array(start + firsts[:-1][n], pa.int64()),
                        "n_tokens": pa.array(np.diff(firsts)[n], pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(raw[a:b]) for a, b in own], pa.int64()),
                    }
                    if with_ids:
                        columns["ids"] = pa.array([bytes(raw[a:b]) for a, b in own], pa.binary())
                    yield pa.record_batch(columns)
                textkit.trim()

    return run


def read_token_files(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Documents of the files of a manifest: doc_id, start, n_tokens, ids_crc32 and ``ids`` (little-endian unsigned 32-bit).

    Each task opens whole files by their manifest rows; a file is as large as its writer
    made it. Without ``with_ids`` the ids themselves stay out of the rows.
    """
    # A file to a task where there are few of them; opening a file costs far more than moving its row.
    parts = 4 * int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return manifest.select("path", "start").repartition(parts, "path").mapInArrow(_read(with_ids), kind)
