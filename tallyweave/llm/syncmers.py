"""Document fingerprints of closed syncmers, and the comparison of documents with edited copies."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm import textkit
from tallyweave.llm.shared import written

INNER = 8  # bytes of the inner substrings
OUTER = 23  # bytes of the k-mers: 16 inner substrings each
LEAST, SHARE = 256, 8  # a fingerprint has the hashes in the lowest eighth of their range, and so many of the smallest at least
CUTS = 4096  # of doc_id that the driver knows; between two of them ids are divided evenly
ROWS_PER_RANGE = 2048  # about; a range streams through its task in order
PARTITIONS = 100_000  # at most; more ranges share them


def closed_syncmers(data: np.ndarray, inner: int = INNER, outer: int = OUTER) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the closed syncmers of some bytes.

    A window of ``outer`` bytes is one if the least of its ``inner``-byte substrings, by
    hash, is its first or last. That depends on the window alone, so equal passages have
    equal syncmers wherever they stand. Fewer than ``outer`` bytes, but some, count as one.
    """
    n = len(data) - outer + 1
    if n < 1:
        return (np.zeros(1, np.int64), textkit.spans(data, np.array([0]), np.array([len(data)]), 2)) if len(data) else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    small = np.zeros(len(data) - inner + 1, np.uint64)
    for i in range(inner):
        small |= data[i : i + len(small)].astype(np.uint64) << np.uint64(8 * i)
    small = textkit.mix(small * np.uint64(0x9E3779B97F4A7C15))
    span, least, have = outer - inner + 1, small, 1
    while have < span:  # minima of windows that double in length
        step = min(have, span - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    place = np.flatnonzero((small[:n] == least) | (small[span - 1 :] == least))
    return place, textkit.spans(data, place, place + outer, 2)


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The different syncmer hashes of a text, as 32-bit numbers in order: all below the bound, the ``LEAST`` smallest at least.

    It grows with the text; up to ``LEAST`` different hashes it holds them all.
    """
    values = np.unique((hashes >> np.uint64(32)).astype(np.uint32))
    return values[: max(LEAST, int(np.searchsorted(values, (1 << 32) // SHARE)))]


def _known(print_: np.ndarray) -> int:
    """The bound below which a fingerprint has all hashes of its text."""
    return 1 << 32 if len(print_) < LEAST else max((1 << 32) // SHARE, int(print_[-1]) + 1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Common syncmers as a share of those of both fingerprints, as far as both are known to be whole. Two empty ones are alike."""
    bound = min(_known(a), _known(b))
    a, b = a[: np.searchsorted(a, bound)], b[: np.searchsorted(b, bound)]
    both = len(np.intersect1d(a, b, True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _same(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading bytes are the same."""
    size, done, step = min(len(a), len(b)), 0, 64
    while done < size:
        differ = a[done : min(done + step, size)] != b[done : min(done + step, size)]
        if differ.any():
            return done + int(differ.argmax())
        done, step = done + step, 2 * step
    return size


def passages(a: np.ndarray, b: np.ndarray, anchors_a: tuple[np.ndarray, np.ndarray], anchors_b: tuple[np.ndarray, np.ndarray], outer: int = OUTER) -> list[tuple[int, int, int]]:
    """Passages (start in a, start in b, bytes) that two texts share, as long as they can be, found by their anchors.

    An anchor is paired with the same one in the other text, the first of each if they repeat. Pairs with one
    shift lie on one passage as long as the bytes between agree; a passage is extended both ways from its first pair.
    """
    first_a, first_b = (np.unique(h, return_index=True) for _, h in (anchors_a, anchors_b))
    _, at_a, at_b = np.intersect1d(first_a[0], first_b[0], True, return_indices=True)
    x, y = anchors_a[0][first_a[1][at_a]], anchors_b[0][first_b[1][at_b]]
    order = np.lexsort((x, y - x))
    x, y = x[order], y[order]
    out = []
    for low, high in textkit.stretches(y - x):
        nth, end = low, 0
        while nth < high:
            i, j = int(x[nth]), int(y[nth])
            ahead = _same(a[i:], b[j:])
            if ahead >= min(outer, len(a) - i):
                behind = _same(a[end:i][::-1], b[end + j - i : j][::-1]) if end + j - i >= 0 else _same(a[:i][::-1], b[:j][::-1])
                out.append((i - behind, j - behind, behind + ahead))
                end = i + ahead
            nth = max(nth + 1, low + int(np.searchsorted(x[low:high], i + ahead)))
    return sorted(out)


def covered(spans: list[tuple[int, int, int]]) -> int:
    """Bytes of the first text that lie in a passage."""
    total = end = 0
    for start, _, size in spans:
        total += max(0, start + size - max(end, start))
        end = max(end, start + size)
    return total


def written_out(values: np.ndarray) -> str:
    return values.astype(">u4").tobytes().hex()


SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_bytes bigint, anchored_bytes bigint"


class Printed:
    """A text with its anchors and fingerprint."""

    def __init__(self, text: str):
        self.text, self.data = text, np.frombuffer(text.encode(), np.uint8)
        self.anchors = closed_syncmers(self.data)
        self.print = fingerprint(self.anchors[1])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    before: tuple[int, int | None, Printed] | None = None  # range, doc_id, text
    out: list[tuple] = []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("place", "lent", "doc_id", "text")]
        for place, lent, doc_id, text in zip(*columns, strict=True):
            printed = Printed(text)
            if before is not None:
                if before[0] != place:
                    raise RuntimeError("a range of documents does not end with the first one of the next")
                out.append(_row(*before[1:], printed))
            before = None if lent else (place, doc_id, printed)
            if len(out) >= 512:
                yield _batch(out)
                out.clear()
    if before is not None:
        raise RuntimeError("a range of documents does not end with the first one of the next")
    if out:
        yield _batch(out)


def _row(doc_id: int | None, own: Printed, following: Printed) -> tuple:
    third = len(own.text) // 3
    edited = Printed(own.text[: len(own.text) - third] + following.text[:third])
    digest = hashlib.sha256(edited.data.tobytes()).hexdigest()
    anchored = covered(passages(own.data, edited.data, own.anchors, edited.anchors))
    return (
        doc_id, len(own.text), digest, written_out(own.print), written_out(edited.print), likeness(own.print, edited.print), likeness(own.print, following.print),
        len(own.data), anchored,
    )


_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_bytes", pa.int64()), ("anchored_bytes", pa.int64())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def compared_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of documents (doc_id, text), of edited copies, and how alike they are.

    The edited text has the last third of its characters replaced by as many first ones of
    the next document (all, if it has fewer) in descending order of doc_id; the last one's
    next is the first. Rows are dealt by ranges of doc_id; each range streams through its task
    in order, followed by the first row of the next range, which is sent to both.

    Null texts are empty: no syncmers, an empty fingerprint; two empty fingerprints have
    likeness 1. Null ids come last; equal ids are ordered by text, so repeated rows follow each
    other. A single document is its own next. Other columns are ignored; no rows give none.

    ``near_edited`` and ``near_next`` compare fingerprints, which grow with their texts. ``anchored_bytes`` of the
    text's ``n_bytes`` lie in passages that it shares with its edited copy, found and extended from common anchors.
    Rows of one id, and those without one, are one range however many they are.
    """
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    count, lowest, highest = narrow.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    ranges = max(1, -(-count // ROWS_PER_RANGE))
    n_cuts = min(ranges, CUTS)
    split = -(-ranges // n_cuts)
    cuts = narrow.agg(F.percentile_approx("doc_id", [i / n_cuts for i in range(1, n_cuts)], 20 * n_cuts)).first()[0] if n_cuts > 1 else []
    cuts = sorted(set(cuts or []), reverse=True)
    # Ranges come in descending order, ids that are null last of all: a row's place is the number of
    # cuts above its id, counted in whole strides first and then within one.
    stride = int(len(cuts) ** 0.5) + 1
    above = lambda some: F.array_size(F.filter(some, lambda c: c > F.col("doc_id")))
    whole = above(F.lit(cuts[stride - 1 :: stride]).cast("array<bigint>")) if len(cuts) >= stride else F.lit(0)
    cut = whole * stride + above(F.slice(F.lit(cuts).cast("array<bigint>"), whole * stride + 1, stride)) if cuts else F.lit(0)
    nameless = (len(cuts) + 1) * split
    placed = narrow.withColumn("cut", F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(cut).cast("bigint"))
    within = F.lit(0)
    if split > 1:
        ends = F.lit([highest, *cuts, lowest - 1]).cast("array<decimal(20,0)>")
        top, bottom = F.get(ends, F.col("cut").cast("int")), F.get(ends, F.col("cut").cast("int") + 1)
        within = F.least(F.floor((top - F.col("doc_id")).cast("double") / F.greatest(top - bottom, F.lit(1)).cast("double") * split), F.lit(split - 1))
    place = F.when(F.col("doc_id").isNull(), nameless).otherwise(F.col("cut") * split + within)
    placed = placed.withColumn("place", place.cast("bigint"))
    # The first row of each range, found by id and hash before any text moves; it goes to the range before, if need be over empty ones.
    keys = written(placed.groupBy("cut", "place").agg(F.max("doc_id").alias("top")), "keys")
    last = keys.groupBy("cut").agg(F.max("place").alias("last"))  # a row per cut
    last = last.select("cut", F.lag("last").over(Window.orderBy("cut")).alias("before"), F.max("last").over(Window.partitionBy()).alias("wrap"))
    heads = keys.withColumn("near", F.lag("place").over(Window.partitionBy("cut").orderBy("place"))).join(F.broadcast(last), "cut")
    heads = written(heads.select("place", "top", F.coalesce("near", "before", "wrap").alias("to")), "heads")
    lent = heads.select(F.col("place").alias("from"), "top", "to")
    firsts = placed.join(lent, (placed["place"] == lent["from"]) & placed["doc_id"].eqNullSafe(lent["top"]))
    firsts = firsts.groupBy("to").agg(F.min("text").alias("text"), F.first("doc_id").alias("doc_id"))
    rows = placed.drop("cut").withColumn("lent", F.lit(False)).unionByName(firsts.select("doc_id", "text", F.col("to").alias("place"), F.lit(True).alias("lent")))
    together = -(-(nameless + 1) // PARTITIONS)
    dealt = rows.repartitionById(-(-(nameless + 1) // together), F.floor(F.col("place") / together).cast("int"))
    return dealt.sortWithinPartitions("place", "lent", F.col("doc_id").desc_nulls_last(), "text").mapInArrow(_compare, SCHEMA)
