"""Product quantisation in whole numbers: the nearest codebook entry of a vector's part is sought among those its grid cell cannot rule out."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import textkit
from tallyweave.llm.shared import written
from tallyweave.llm.voronoi import integers, usable

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
STEP = 16  # edge of a grid cell
LIMIT = 1 << 27  # components beyond count as this, so that sums of squares stay within a long
CELLS_KEPT = 1 << 15  # of a part, in a worker's memory; others are worked out again

_SUMS = "part int, entry int, place int, n bigint, total bigint"
_SUMS_ARROW = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("place", pa.int32()), ("n", pa.int64()), ("total", pa.int64())])
_CODES = "vec_id bigint, label string, code string, error bigint"
_CODES_ARROW = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.string()), ("error", pa.int64())])
_MEMO: dict[str, list[Grid]] = {}


class Grid:
    """The entries of one part's codebook, with a memory of the cells met so far.

    A cell keeps the entries whose least distance from its box is no more than the least of all entries'
    greatest distances: any other entry is beaten, for every point of the box, by one of them.
    """

    def __init__(self, entries: np.ndarray, step: int = STEP):
        self.entries, self.step = entries, step
        self.cells: dict[bytes, np.ndarray] = {}

    def _rivals(self, cells: np.ndarray) -> list[np.ndarray]:
        low = cells[:, None, :] * self.step
        high = low + self.step - 1
        under, over = low - self.entries, self.entries - high
        least = (np.maximum(0, np.maximum(under, over)) ** 2).sum(axis=2)
        most = (np.maximum(np.abs(under), np.abs(over)) ** 2).sum(axis=2)
        return [np.flatnonzero(x) for x in least <= most.min(axis=1)[:, None]]

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entry nearest to each point, ties to the lower index, and the squared distance."""
        cells = np.ascontiguousarray(np.floor_divide(points, self.step))
        keys = cells.view(np.dtype((np.void, cells.itemsize * cells.shape[1]))).ravel()
        _, first, at = np.unique(keys, return_index=True, return_inverse=True)
        names = [x.tobytes() for x in keys[first]]
        rivals = [self.cells.get(x) for x in names]
        new = [i for i, x in enumerate(rivals) if x is None]
        for a in range(0, len(new), 4096):
            own = new[a : a + 4096]
            for i, x in zip(own, self._rivals(cells[first[own]]), strict=True):
                rivals[i] = x
                if len(self.cells) < CELLS_KEPT:
                    self.cells[names[i]] = x
        best, far = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        # Points whose cells keep equally many entries are measured at once.
        counts = np.array([len(x) for x in rivals])[at]
        order = np.argsort(counts, kind="stable")
        for a, b in textkit.stretches(counts[order]):
            width = int(counts[order[a]])
            for c in range(a, b, max(1, (1 << 18) // width)):
                own = order[c : min(b, c + max(1, (1 << 18) // width))]
                kinds, back = np.unique(at[own], return_inverse=True)
                entry = np.stack([rivals[k] for k in kinds])[back]  # ascending, so the first least is the lower index
                apart = ((self.entries[entry] - points[own][:, None, :]) ** 2).sum(axis=2)
                place = apart.argmin(axis=1)
                line = np.arange(len(own))
                best[own], far[own] = entry[line, place], apart[line, place]
        return best, far


def _grids(books: np.ndarray, step: int) -> list[Grid]:
    """The grids of a codebook, kept by the worker as long as it meets no other."""
    name = f"{step} {books.shape} {hashlib.sha256(books.tobytes()).hexdigest()}"
    if name not in _MEMO:
        _MEMO.clear()
        _MEMO[name] = [Grid(b, step) for b in books]
    return _MEMO[name]


def _parted(batch: pa.RecordBatch, parts: int, width: int, scale: int) -> np.ndarray:
    return integers(batch.column("embedding"), parts * width, scale, LIMIT).reshape(-1, parts, width)


def _summed(books: np.ndarray, scale: int, step: int):
    parts, size, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, size), np.int64), np.zeros((parts, size, width), np.int64)
        grids = _grids(books, step)
        for batch in batches:
            points = _parted(batch, parts, width, scale)
            for p, grid in enumerate(grids):
                entry, _ = grid.nearest(points[:, p])
                n[p] += np.bincount(entry, minlength=size)
                np.add.at(total[p], entry, points[:, p])
        p, e = np.nonzero(n)
        if len(p):
            place = np.tile(np.arange(width), len(p))
            columns = [np.repeat(p, width), np.repeat(e, width), place, np.repeat(n[p, e], width), total[p, e].ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, _SUMS_ARROW, strict=True)], schema=_SUMS_ARROW)

    return run


def _assigned(books: np.ndarray, scale: int, step: int):
    parts, size, width = books.shape
    digits = max(2, len(f"{size - 1:x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = _grids(books, step)
        names = np.array([f"{e:0{digits}x}" for e in range(size)])
        for batch in batches:
            points = _parted(batch, parts, width, scale)
            code, error = np.zeros((len(points), parts), np.int64), np.zeros(len(points), np.int64)
            for p, grid in enumerate(grids):
                code[:, p], far = grid.nearest(points[:, p])
                error += far
            text = ["".join(x) for x in names[code].tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(error)], schema=_CODES_ARROW)

    return run


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, step: int = STEP) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of every vector that is not null and has no null or non-finite component.

    Components are floor(``scale`` * x); vectors are cut in ``parts`` equal parts, each with a codebook that starts as
    that part of the first ``entries`` vectors by vec_id (null ids last, equal ids by their components). Each of the ``rounds``
    replaces the entries by the floors of their parts' means; entries without parts stay. ``code`` has the index of the
    nearest entry of each part (squared Euclidean distance, ties to the lower index), two hex digits each, ``error`` the sum of these distances,
    ``label_error`` its sum over the rows of the label (nulls together).

    Rows that repeat count as often as they stand. Vectors shorter than the longest, or whose length the parts do not
    divide, end in zeros. Components beyond 2**27 count as that. An empty table gives no rows; other columns are ignored.

    Codebooks are the only thing that goes over the driver: ``parts`` x ``entries`` entries. Tasks add up their own rows and
    send a sum for each component of an entry.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter(usable(F.col("embedding")))
    dims = rows.agg(F.max(F.size("embedding"))).first()[0]
    if dims is None:
        return spark.createDataFrame([], _CODES + ", label_error bigint, codebooks_sha256 string")
    width = max(1, -(-dims // parts))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").toArrow()
    books = np.ascontiguousarray(integers(first.column(0), parts * width, scale, LIMIT).reshape(-1, parts, width).transpose(1, 0, 2))
    for _ in range(rounds):
        sums = rows.select("embedding").mapInArrow(_summed(books, scale, step), _SUMS).groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        books = books.copy()
        for r in sums.collect():
            books[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
    coded = written(rows.mapInArrow(_assigned(books, scale, step), _CODES), "codes")
    totals = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    known = totals.select(F.col("label").alias("of"), "label_error")
    return coded.join(known, F.col("label").eqNullSafe(F.col("of"))).drop("of").withColumn("codebooks_sha256", F.lit(digest))
