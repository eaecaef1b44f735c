"""Large JSON files cut at record borders: one list, or one mapping, of objects is read by many tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.sources.byte_ranges import read_bytes

BLOCK_BYTES = 16 << 20

# How many rows, or bytes of records, a task hands on at a time.
ROWS_AT_ONCE, BYTES_AT_ONCE = 4096, 4 << 20

# Where a block may begin: outside strings, inside one, or inside one behind a backslash.
OUTSIDE, INSIDE, ESCAPED = 0, 1, 2

_SCANS = "path string, start bigint, length bigint, state int, ends int, depth bigint, opens array<struct<depth: bigint, n: bigint>>"
_SCAN_ARROW = pa.schema([
    ("path", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("state", pa.int32()), ("ends", pa.int32()), ("depth", pa.int64()),
    ("opens", pa.list_(pa.struct([("depth", pa.int64()), ("n", pa.int64())]))),
])
_STARTS = "path string, start bigint, length bigint, state int, depth bigint, place bigint"
_START_ARROW = pa.schema([("path", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("state", pa.int32()), ("depth", pa.int64()), ("place", pa.int64())])
_RECORDS = "path string, place bigint, text string"
_RECORD_ARROW = pa.schema([("path", pa.string()), ("place", pa.int64()), ("text", pa.string())])


def structure(data: np.ndarray, state: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of the braces and brackets outside strings, the depth after each relative to the start, and the state at the end."""
    slash = data == 0x5C
    escaped = np.zeros(len(data) + 1, bool)
    if slash.any() or state == ESCAPED:
        # A byte is escaped if an odd number of backslashes stands right before it.
        at = np.flatnonzero(slash)
        run = np.cumsum(np.diff(at, prepend=-2) != 1) - 1
        first = at[np.flatnonzero(np.diff(at, prepend=-2) != 1)]
        odd = ((at - first[run]) % 2 == 0) if len(at) else np.zeros(0, bool)
        if state == ESCAPED:
            escaped[0] = True
            if len(at) and first[0] == 0:  # the escaped byte is itself a backslash: the rest of its run counts from the next
                odd[run == 0] = ~odd[run == 0]
        escaped[at[odd] + 1] = True
    quote = (data == 0x22) & ~escaped[:-1]
    inside = (np.cumsum(quote) + (state != OUTSIDE)) % 2 == 1
    step = np.zeros(len(data), np.int8)
    step[(data == 0x7B) | (data == 0x5B)] = 1
    step[(data == 0x7D) | (data == 0x5D)] = -1
    step[inside] = 0
    place = np.flatnonzero(step)
    ends = OUTSIDE if not (inside[-1] if len(data) else state != OUTSIDE) else ESCAPED if escaped[-1] else INSIDE
    return place, np.cumsum(step[place], dtype=np.int64), ends


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each block comes to, whichever way it begins."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            data = np.frombuffer(read_bytes(row["path"], row["start"], row["length"]), np.uint8)
            for state in (OUTSIDE, INSIDE, ESCAPED):
                place, depth, ends = structure(data, state)
                opens, n = np.unique(depth[data[place] == 0x7B] - 1, return_counts=True)
                rows.append(row | {"state": state, "ends": ends, "depth": int(depth[-1]) if len(depth) else 0, "opens": [{"depth": d, "n": c} for d, c in zip(opens.tolist(), n.tolist(), strict=True)]})
            if len(rows) >= ROWS_AT_ONCE:
                yield pa.RecordBatch.from_pylist(rows, _SCAN_ARROW)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _SCAN_ARROW)


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How each block of a file really begins: state, depth, and the number of records before it.

    Scans come sorted by file, start and state; nothing but what the next block begins with is kept of those before it.
    """
    file = block = None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["path"] != file:
                file, block, following = row["path"], None, (OUTSIDE, 0, 0)
            if row["start"] != block:
                block, (state, depth, place) = row["start"], following
            if row["state"] == state:
                out.append({"path": file, "start": block, "length": row["length"], "state": state, "depth": depth, "place": place})
                following = (row["ends"], depth + row["depth"], place + sum(x["n"] for x in row["opens"] if x["depth"] + depth == 1))
        if out:
            yield pa.RecordBatch.from_pylist(out, _START_ARROW)


def _records(found: list[tuple[str, int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), _RECORD_ARROW, strict=True)], schema=_RECORD_ARROW)


def _cut(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The records that begin in a block; the last one is read to its end in the blocks after it."""
        found, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                data = np.frombuffer(read_bytes(row["path"], row["start"], row["length"]), np.uint8)
                place, depth, state = structure(data, row["state"])
                depth = depth + row["depth"]
                first = place[(data[place] == 0x7B) & (depth == 2)]
                last = place[(data[place] == 0x7D) & (depth == 1)]
                last = last[last > first[0]] if len(first) else last[:0]
                texts = [data[a : b + 1].tobytes() for a, b in zip(first.tolist(), last.tolist(), strict=False)]
                if len(first) > len(last):
                    pieces, at, deep = [data[first[-1] :]], row["start"] + row["length"], int(depth[-1])
                    while True:
                        more = np.frombuffer(read_bytes(row["path"], at, block_bytes), np.uint8)
                        if not len(more):
                            raise ValueError(f"{row['path']} ends within a record")
                        place, depth, state = structure(more, state)
                        closed = place[(depth + deep == 1) & (more[place] == 0x7D)]
                        if len(closed):
                            pieces.append(more[: closed[0] + 1])
                            break
                        pieces.append(more)
                        at, deep = at + len(more), deep + (int(depth[-1]) if len(depth) else 0)
                    texts.append(b"".join(x.tobytes() for x in pieces))
                for place, text in enumerate(texts, row["place"]):
                    found.append((row["path"], place, text.decode()))
                    size += len(text)
                    if len(found) >= ROWS_AT_ONCE or size >= BYTES_AT_ONCE:
                        yield _records(found)
                        found, size = [], 0
        if found:
            yield _records(found)

    return run


def record_texts(spark: SparkSession, pattern: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, place, text) of the objects in JSON files that each hold one list, or one mapping, of objects.

    Files are cut in blocks of bytes. A first pass finds what each block comes to in brackets, whether it begins in a string or
    not; per file that settles how every block begins, and a second pass cuts out the records that begin in it.
    ``place`` counts the objects of a file from 0; elements that are no objects are passed over. An
    empty file has none; a file that breaks off within a record raises.
    """
    files = spark.read.format("binaryFile").load(pattern).select("path", "length").where("length > 0")  # contents stay where they are
    blocks = files.select("path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(block_bytes).cast("bigint"))).alias("start"), F.col("length").alias("all"))
    blocks = blocks.select("path", "start", F.least(F.lit(block_bytes), F.col("all") - F.col("start")).cast("bigint").alias("length"))
    n = max(1, blocks.count())
    dealt = min(n, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    scans = blocks.repartition(dealt, "path", "start").mapInArrow(_scan, _SCANS)
    starts = scans.repartition("path").sortWithinPartitions("path", "start", "state").mapInArrow(_starts, _STARTS)
    return starts.repartition(dealt, "path", "start").mapInArrow(_cut(block_bytes), _RECORDS)
