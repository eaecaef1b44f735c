"""Exact top-k by inner product as a Voronoi join: cells of pivots, bounds from cell summaries, blocks sent only where needed, groups solved locally."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm import textkit
from tallyweave.llm.shared import written

SCALE = 64
NEIGHBOURS = 20
PIVOTS = 256
BLOCK = 2048  # vectors that travel together
GROUP = 4096  # queries solved together
SLICE = 1 << 14  # vectors one task holds against a group, about
LONG = np.iinfo(np.int64)

_CODED = "row bigint, vec_id bigint, code binary, cell int, distance double, asked_cell int"
_BLOCK = pa.schema([
    ("block", pa.int64()), ("cell", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("n", pa.int64()), ("least", pa.list_(pa.float64())),
    ("rows", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("codes", pa.binary()),
])
_BLOCKS = "block bigint, cell int, low double, high double, n bigint, least array<double>, rows array<bigint>, ids array<bigint>, codes binary"
_GROUPS = "query_group bigint, rows array<bigint>, ids array<bigint>, codes binary, floors array<double>, needs array<struct<cell: int, low: double, high: double>>"
_FOUND = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def usable(vector: Column) -> Column:
    """Whether a vector takes part: it is not null and neither are its components, which are finite."""
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite, F.lit(False))


def integers(vectors: pa.Array | pa.ChunkedArray, dims: int, scale: int, limit: int) -> np.ndarray:
    """floor(scale * x) of all components, a row per vector: shorter vectors end in zeros, what is beyond ``limit`` counts as the limit."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    at = vectors.offsets.to_numpy()
    flat = vectors.values.slice(at[0], at[-1] - at[0]).cast(pa.float64()).to_numpy(zero_copy_only=False) if len(vectors) else np.zeros(0)
    with np.errstate(over="ignore"):  # beyond the limit in any case
        whole = np.clip(np.floor(flat * scale), -limit, limit).astype(np.int64)
    sizes = np.diff(at)
    if len(sizes) and (sizes == dims).all():
        return whole.reshape(-1, dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(whole)) - np.repeat(at[:-1] - at[0], sizes)] = whole
    return out


@dataclass(frozen=True)
class Space:
    """What tasks need to know of all vectors: their width, how components are stored, the square of the greatest length."""

    dims: int
    scale: int
    limit: int
    kind: str
    square: float

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        return vectors.astype(self.kind)

    def vectors(self, codes: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(codes), self.kind).reshape(-1, self.dims).astype(np.float64)

    def lifts(self, vectors: np.ndarray) -> np.ndarray:
        """The component more that gives every vector the greatest length, so that the nearest has the greatest product."""
        return np.sqrt(np.maximum(0.0, self.square - np.einsum("ij,ij->i", vectors, vectors)))

    @property
    def slack(self) -> float:
        """More than the rounding error of a distance."""
        return 1e-6 * np.sqrt(self.square) + 1e-9


class Pivots:
    """Some of the vectors, lifted, in an order in which neighbours follow each other."""

    def __init__(self, space: Space, vectors: np.ndarray):
        lifted = np.unique(np.c_[vectors, space.lifts(vectors)], axis=0)
        order, left = [0], set(range(1, len(lifted)))
        while left:
            rest = np.array(sorted(left))
            order.append(int(rest[np.argmin(((lifted[rest] - lifted[order[-1]]) ** 2).sum(axis=1))]))
            left.discard(order[-1])
        self.space, self.points = space, lifted[order]
        self.squares = (self.points**2).sum(axis=1)

    def distances(self, vectors: np.ndarray, lifts: np.ndarray | None) -> np.ndarray:
        """Of each vector to each pivot; queries have no lift."""
        own = (vectors**2).sum(axis=1)
        product = vectors @ self.points[:, :-1].T
        if lifts is not None:
            own = own + lifts**2
            product = product + lifts[:, None] * self.points[:, -1]
        return np.sqrt(np.maximum(0.0, own[:, None] + self.squares - 2 * product))

    def apart(self) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, self.squares[:, None] + self.squares - 2 * self.points @ self.points.T))


def _coded(pivots: Pivots):
    """Vectors in whole numbers with their cell and, for those that ask, the cell of the query."""
    space = pivots.space

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = space.codes(integers(batch.column("embedding"), space.dims, space.scale, space.limit))
            exact = vectors.astype(np.float64)
            far = pivots.distances(exact, space.lifts(exact))
            cell, asked = far.argmin(axis=1), pivots.distances(exact, None).argmin(axis=1).astype(np.int32)
            raw = pa.Array.from_buffers(pa.binary(space.dims * vectors.itemsize), len(vectors), [None, pa.py_buffer(vectors.tobytes())])
            columns = [batch.column("row"), batch.column("vec_id"), raw.cast(pa.binary()), pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell])]
            columns.append(pa.array(asked, mask=~batch.column("asked").to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays(columns, ["row", "vec_id", "code", "cell", "distance", "asked_cell"])

    return run


def _packed(size: int, k: int):
    """Rows of a partition, which come by cell and distance, as blocks of one cell each."""

    def blocks(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        distance = rows.column("distance").to_numpy()
        for first, last in textkit.stretches(rows.column("cell").to_numpy()):
            for a in range(first, last, size):
                b = min(a + size, last)
                part = rows.slice(a, b - a)
                row = {
                    "block": part.column("row")[0].as_py(), "cell": part.column("cell")[0].as_py(), "low": distance[a], "high": distance[b - 1], "n": b - a,
                    "least": distance[a : min(b, a + k + 1)], "rows": part.column("row").to_numpy(), "ids": part.column("vec_id").to_pylist(),
                    "codes": b"".join(part.column("code").to_pylist()),
                }
                yield pa.RecordBatch.from_pylist([row], _BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) < 4 * size:
                continue
            rows = pa.Table.from_batches(held)
            cells = rows.column("cell").to_numpy()
            # The last cell may go on in the next batch; whole blocks of it can leave.
            tail = int(np.searchsorted(cells, cells[-1]))
            done = tail + (len(cells) - tail) // size * size
            yield from blocks(rows.slice(0, done))
            held = rows.slice(done).to_batches()
        if held:
            yield from blocks(pa.Table.from_batches(held))

    return run


def _bounds(pivots: Pivots, summary: np.ndarray, k: int):
    """Groups of queries with a lower bound on each one's k-th score and the distances to each pivot at which vectors can beat it.

    ``summary`` holds the least distances of each cell, as many as a query may need (infinite if the cell has fewer).
    """
    space, apart = pivots.space, pivots.apart()

    def run(rows: pa.Table) -> pa.Table:
        vectors = space.vectors(rows.column("code").to_pylist())
        squares = (vectors**2).sum(axis=1)
        far = pivots.distances(vectors, None)
        own = far.argmin(axis=1)
        reach = np.empty(len(vectors))
        for a in range(0, len(vectors), 256):
            within = (far[a : a + 256, :, None] + summary).reshape(len(far[a : a + 256]), -1)
            # One more than k, as a query may be among them itself.
            reach[a : a + 256] = np.partition(within, k, axis=1)[:, k] if within.shape[1] > k else np.inf
        reach += space.slack
        needs = []
        for cell in range(len(pivots.points)):
            # A vector of the cell is beyond the plane between the query's pivot and the cell's.
            plane = (far[:, cell] ** 2 - far[np.arange(len(far)), own] ** 2) / (2 * np.maximum(apart[own, cell], 1e-12))
            near = (own == cell) | (plane <= reach)
            if near.any():
                low, high = (far[near, cell] - reach[near]).min(), (far[near, cell] + reach[near]).max()
                needs.append({"cell": cell, "low": low, "high": high})
        floors = (squares + space.square - np.minimum(reach + space.slack, 1e150) ** 2) / 2 - space.slack
        return pa.table({
            "query_group": [rows.column("query_group")[0].as_py()], "rows": [rows.column("row").to_numpy()], "ids": [rows.column("vec_id").to_pylist()],
            "codes": [b"".join(rows.column("code").to_pylist())], "floors": [floors], "needs": [needs],
        }, schema=pa.schema([
            ("query_group", pa.int64()), ("rows", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("codes", pa.binary()), ("floors", pa.list_(pa.float64())),
            ("needs", pa.list_(pa.struct([("cell", pa.int32()), ("low", pa.float64()), ("high", pa.float64())]))),
        ]))

    return run


def products(queries: np.ndarray, vectors: np.ndarray, square: float) -> np.ndarray:
    """Inner products of rows, exact: by floats as long as these hold every sum, by whole numbers beyond, kept within a long."""
    if square < 1 << 24:
        return (queries.astype(np.float32) @ vectors.astype(np.float32).T).astype(np.float64)
    if square < 1 << 53:
        return queries @ vectors.T
    whole = np.array([[int(x) for x in r] for r in queries], object) @ np.array([[int(x) for x in r] for r in vectors], object).T
    return np.clip(whole, LONG.min + 1, LONG.max)


def best(scores: np.ndarray, k: int, square: float) -> np.ndarray:
    """Columns of the ``k`` greatest scores of each row, ties to the first; in no order."""
    n = scores.shape[1]
    if n <= k:
        return np.broadcast_to(np.arange(n), scores.shape)
    if square * n < 1 << 52:
        keys = scores * n - np.arange(n)
        return np.argpartition(keys, n - k, axis=1)[:, n - k :]
    return np.argsort(-scores, axis=1, kind="stable")[:, :k]


def _solved(space: Space, k: int):
    """The ``k`` best of some blocks for each query of a group, without those below its floor."""

    def run(blocks: pa.Table, queries: pa.Table) -> pa.Table:
        if not blocks.num_rows or not queries.num_rows:
            return _FOUND.empty_table()
        rows, ids = (blocks.column(c).combine_chunks().flatten() for c in ("rows", "ids"))
        vectors = space.vectors(blocks.column("codes").to_pylist())
        order = pa.compute.sort_indices(ids).to_numpy()  # by id, nulls last, so that ties go to the first
        rows, ids, vectors = rows.to_numpy()[order], ids.take(pa.array(order)), vectors[order]
        place = dict(zip(rows.tolist(), range(len(rows)), strict=True))
        group = queries.slice(0, 1).to_pylist()[0]
        asked, floors = space.vectors([group["codes"]]), np.array(group["floors"])
        own = np.array([place.get(x, -1) for x in group["rows"]])
        step = max(1, (1 << 22) // len(rows))
        found = []
        for a in range(0, len(asked), step):
            scores = products(asked[a : a + step], vectors, space.square)
            self_ = np.flatnonzero(own[a : a + step] >= 0)
            takes = np.ones(scores.shape, bool)
            takes[self_, own[a : a + step][self_]] = False
            columns = best(np.where(takes, scores, -2 * space.square - 1), k, space.square)
            kept = np.take_along_axis(takes, columns, 1) & (np.take_along_axis(scores, columns, 1) >= floors[a : a + step, None])
            line, at = np.nonzero(kept)
            column = columns[line, at]
            found.append((line + a, column, scores[line, column].astype(np.int64)))
        line, column, score = (np.concatenate(x) for x in zip(*found, strict=True))
        names = pa.array(group["ids"], pa.int64())
        return pa.table([pa.array(np.array(group["rows"], np.int64)[line]), names.take(pa.array(line)), ids.take(pa.array(column)), pa.array(score)], schema=_FOUND)

    return run


def nearest(vectors: DataFrame, asked: Column, k: int = NEIGHBOURS, scale: int = SCALE, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows with the greatest inner product of floor(``scale`` * x), for each row for which ``asked`` holds.

    A row is no answer to itself; rows that repeat an id are queries and answers of their own. Ties go to the smaller vec_id,
    null ids last; fewer rows than ``k`` are all returned. Vectors that are null or hold null or non-finite
    components take no part. Shorter vectors count as ended by zeros, components beyond 2**31 as that, scores beyond a long
    as its ends. An empty table gives no rows; other columns are ignored.

    Vectors are lifted to one length, so the greatest product is the least distance. Each belongs to the nearest
    of at most ``pivots`` vectors, drawn by hash; cells are cut in blocks by distance from the pivot, so a cell of any size is many blocks.
    The least distances of each cell bound the distance of a query's k-th neighbour; blocks that no query of a group can need
    by the triangle inequality or by the plane between two pivots are not sent to it. A task
    holds one group of queries against about ``SLICE`` vectors.
    """
    spark = vectors.sparkSession
    embedding = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("bigint").alias("vec_id"), embedding.alias("embedding"), F.coalesce(asked, F.lit(False)).alias("asked"))
    rows = rows.filter(usable(F.col("embedding")))
    whole = F.transform("embedding", lambda x: F.floor(x * scale).cast("double"))
    square = F.aggregate(whole, F.lit(0.0), lambda a, x: a + x * x)
    peak = F.array_max(F.transform(whole, lambda x: F.abs(x)))
    n, n_asked, dims, most, longest = rows.agg(F.count("*"), F.count_if("asked"), F.max(F.size("embedding")), F.max(peak), F.max(square)).first()
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    if not n_asked or not n:
        return empty
    limit = min(most or 0.0, float(1 << 31))
    kind = next(t for t, bits in (("<i1", 7), ("<i2", 15), ("<i8", 63)) if limit < 1 << bits)
    space = Space(max(dims, 1), scale, int(limit), kind, min(longest, space_square(limit, dims)) * (1 + 1e-12))
    drawn = rows.orderBy(F.xxhash64("embedding", "vec_id"), "embedding").limit(pivots).select("embedding").toArrow()
    points = Pivots(space, space.codes(integers(drawn.column(0), space.dims, scale, space.limit)).astype(np.float64))

    coded = written(rows.select("row", "vec_id", "embedding", "asked").mapInArrow(_coded(points), _CODED), "vectors")
    parts = max(1, -(-n // SLICE))
    ordered = coded.repartitionByRange(parts, "cell", "distance", "row").sortWithinPartitions("cell", "distance", "row")
    blocks = written(ordered.mapInArrow(_packed(BLOCK, k), _BLOCKS), "blocks")

    # A bounded summary: at most k + 1 distances of each pivot's cell.
    nearer = Window.partitionBy("cell").orderBy("distance")
    least = blocks.select("cell", F.explode("least").alias("distance")).withColumn("place", F.row_number().over(nearer)).filter(F.col("place") <= k + 1)
    summary = np.full((len(points.points), k + 1), np.inf)
    for r in least.collect():
        summary[r["cell"], r["place"] - 1] = r["distance"]

    # Cells next to each other make a group of queries; a cell with more is split by hash.
    asking = coded.filter("asked_cell is not null").select("row", "vec_id", "code", F.col("asked_cell").alias("cell"))
    groups, held, made = [], 0, 0
    sizes = {r["cell"]: r["n"] for r in asking.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    for cell in sorted(sizes):
        share = -(-sizes[cell] // GROUP)
        if share > 1 or held + sizes[cell] > GROUP:
            made, held = made + (held > 0), 0
        groups.append((cell, made, share))
        held += sizes[cell]
        if share > 1:
            made, held = made + share, 0
    named = spark.createDataFrame(groups, "cell int, base bigint, share bigint")
    number = F.col("base") + F.pmod(F.xxhash64("row"), F.col("share"))
    bounded = asking.join(F.broadcast(named), "cell").withColumn("query_group", number).groupBy("query_group").applyInArrow(_bounds(points, summary, k), _GROUPS)
    bounded = written(bounded, "groups")

    wants = bounded.select("query_group", F.explode("needs").alias("w")).select("query_group", "w.*")
    b, w = blocks.select("block", "cell", "low", "high").alias("b"), wants.alias("w")
    slice_ = F.pmod(F.xxhash64("b.block"), F.lit(parts))
    meets = (F.col("b.cell") == F.col("w.cell")) & (F.col("b.low") <= F.col("w.high")) & (F.col("b.high") >= F.col("w.low"))
    pairs = written(b.join(w, meets).select("block", "query_group", slice_.alias("slice")), "pairs")
    sent = pairs.join(blocks.select("block", "rows", "ids", "codes"), "block").select("slice", "query_group", "rows", "ids", "codes")
    held_by = pairs.select(F.col("slice").alias("held_by"), F.col("query_group").alias("held")).distinct()
    asking = held_by.join(bounded.drop("needs").withColumnRenamed("query_group", "held"), "held")
    solved = sent.groupBy("slice", "query_group").cogroup(asking.groupBy("held_by", "held")).applyInArrow(_solved(space, k), "query bigint, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return solved.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def space_square(limit: float, dims: int) -> float:
    """The square of the greatest length that components within ``limit`` can make."""
    return float(limit) ** 2 * max(dims, 1)
