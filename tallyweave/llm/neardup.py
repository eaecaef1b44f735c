"""SimHash near-duplicates: fingerprints in tasks, candidate pairs by pigeonring chains, components by stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import textkit
from tallyweave.llm.shared import written

SHINGLE = 3  # words
SEED = 42
DISTANCE = 2  # differing bits of linked fingerprints
SEGMENTS = 16  # of the 64 bits, in a ring


def _fingerprints(width: int):
    digest = xxhash.xxh64_intdigest

    def chunk(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        words = textkit.Words(textkit.LOWER[data], offsets, textkit.SPACED)
        n = len(offsets) - 1
        if not len(words.starts):
            return np.zeros(n, np.uint64)
        joined, _, begin = textkit.joined(words, offsets)
        end = begin + (words.ends - words.starts)
        heads = words.heads(width)
        tails = heads + width - 1
        brief = np.flatnonzero((words.counts > 0) & (words.counts < width))
        heads, tails = np.r_[heads, words.first[:-1][brief]], np.r_[tails, words.first[1:][brief] - 1]
        order = np.argsort(heads, kind="stable")
        heads, tails = heads[order], tails[order]
        pairs = zip(begin[heads].tolist(), end[tails].tolist(), strict=True)
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), "<u8", len(heads))
        first = np.searchsorted(heads, words.first)
        total = np.diff(first)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.zeros((n, 64), np.int64)
        full = np.flatnonzero(total)
        ones[full] = np.add.reduceat(bits, first[:-1][full], axis=0, dtype=np.int32)
        return np.packbits(ones * 2 > total[:, None], axis=1, bitorder="little").view("<u8").ravel()

    @F.arrow_udf("bigint")
    def fingerprint(text: pa.Array) -> pa.Array:
        data, offsets = textkit.bytes_of(text)
        values = [np.zeros(0, np.uint64)]
        for first, last in textkit.groups(offsets):
            own = offsets[first : last + 1]
            values.append(chunk(data[own[0] : own[-1]], own - own[0]))
        textkit.trim()
        return pa.array(np.concatenate(values).view(np.int64))

    return fingerprint


def simhash(text: Column, width: int = SHINGLE) -> Column:
    """The 64-bit fingerprint of a text: bit i is 1 if it is set in over half of its shingles' XXH64 values.

    A-Z are lower-cased; shingles are ``width`` words joined by a space, repeats counted;
    fewer words make one shingle. Null and empty texts give 0.
    """
    return _fingerprints(width)(text.cast("string"))


def _turned(fp: Column, bits: int) -> Column:
    """The ring of bits, begun ``bits`` further on."""
    return fp if bits == 0 else F.shiftleft(fp, bits).bitwiseOR(F.shiftrightunsigned(fp, 64 - bits))


def pigeonring_pairs(fps: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """Pairs (a, b) of different values of ``fp`` that differ in at most ``distance`` bits.

    The 64 bits form a ring of ``segments``. If two values differ in at most ``distance``
    bits, then from some segment on every chain of l segments differs in at most
    l * distance / segments bits. Chains whose share is below one bit must be equal: they
    are the key of the join. The longer ones are checked in turn, the whole ring last.
    """
    width = 64 // segments
    equal = next(k for k in range(segments, 0, -1) if k * distance < segments)
    ring = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(s).alias("s"), _turned(F.col("fp"), s * width).alias("turn")) for s in range(segments)])).alias("r"))
    ring = ring.select("fp", "r.s", "r.turn", F.shiftrightunsigned("r.turn", 64 - equal * width).alias("key"))
    left, right = ring.alias("l"), ring.alias("r")
    apart = F.col("l.turn").bitwiseXOR(F.col("r.turn"))
    chain = F.lit(True)
    for k in range(equal + 1, segments + 1):
        if k == segments or (k + 1) * distance // segments > k * distance // segments:  # the last length with this budget
            part = apart if k == segments else F.shiftrightunsigned(apart, 64 - k * width)
            chain = chain & (F.bit_count(part) <= k * distance // segments)
    match = (F.col("l.s") == F.col("r.s")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.fp") < F.col("r.fp")) & chain
    return left.join(right, match).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of undirected ``edges`` (a, b): root is the smallest node reachable.

    Large stars and small stars in turn hang every node nearer to the smallest one it knows,
    until nothing changes; each round is a table in the shared folder.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = written(small.filter("u <> v").distinct(), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _placed(prints: DataFrame, distance: int, segments: int) -> DataFrame:
    """(fp, component_id, root, n_links) of the different fingerprints in (doc_id, fp)."""
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    pairs = written(pigeonring_pairs(nodes.select("fp"), distance, segments), "pairs")
    roots = connected(pairs)
    links = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(smallest, "root").join(links, "fp", "left")
    return named.select("fp", "component_id", "root", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """(doc_id, fp, component_id, n_links) of documents: component_id is the smallest doc_id reachable over linked fingerprints.

    Fingerprints link at ``distance`` or fewer differing bits. Rows with one fingerprint are
    handled as one node, so copies make no pairs; links are sought between different
    fingerprints only and none is dropped. ``n_links`` counts the other fingerprints a
    row's own is linked with. Texts without words have fingerprint 0 and link like others.
    Null ids are never the smallest; a component of null ids alone has a null id. Repeated
    rows stay; an empty table gives no rows; other columns are ignored.
    """
    prints = written(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), simhash(F.col("text")).alias("fp")), "fingerprints")
    return prints.join(_placed(prints, distance, segments).drop("root"), "fp").select("doc_id", "fp", "component_id", "n_links")


def deduplicated(docs: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """One document, with its columns, of each component of near-duplicates: that with the smallest doc_id.

    Null ids come last, equal ids are ordered by a hash of the text; of rows that repeat both one stays.
    Texts without words are near-duplicates of each other.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(row, F.col("text"), F.col("doc_id").cast("bigint").alias("_id"), F.xxhash64("text").alias("_hash"))
    prints = written(rows.select(F.col("_id").alias("doc_id"), simhash(F.col("text")).alias("fp"), "_hash"), "fingerprints")
    roots = _placed(prints.select("doc_id", "fp"), distance, segments).select("fp", "root")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "_hash")).alias("k")
    kept = prints.join(roots, "fp").groupBy("root").agg(first).select(F.col("k.doc_id").alias("k_id"), F.col("k._hash").alias("k_hash"))
    # Equal texts have equal fingerprints, so id and hash find the row without another fingerprint.
    same = rows["_id"].eqNullSafe(kept["k_id"]) & (rows["_hash"] == kept["k_hash"])
    return rows.drop("text").join(kept, same, "left_semi").dropDuplicates(["_id", "_hash"]).select("_row.*")
