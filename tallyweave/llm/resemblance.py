"""Near-duplicates by resemblance: SimHash rings, min-hash bands and signatures find candidates, the exact Jaccard similarity of shingles decides, stars join components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import textkit
from tallyweave.llm.neardup import connected, pigeonring_pairs, simhash
from tallyweave.llm.shared import written

SHINGLE = 5  # words
LEAST = 0.8  # Jaccard similarity of linked texts
BANDS, DEPTH = 20, 5  # a pair at 0.8 meets in no band once in 2,800 times; rarer above
BITS = 1024  # of a signature
HEAVY = 1024  # members of a bucket that one task pairs with all others


def _shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of some rows, and where each row's begin (one more entry)."""
    words = textkit.Words(textkit.LOWER[data], offsets, textkit.SPACED)
    hashes = words.hashes()
    heads = words.heads(width)
    tails = heads + width
    brief = np.flatnonzero((words.counts > 0) & (words.counts < width))
    heads, tails = np.r_[heads, words.first[:-1][brief]], np.r_[tails, words.first[1:][brief]]
    order = np.argsort(heads, kind="stable")
    heads, tails = heads[order], tails[order]
    return textkit.spans(hashes, heads, tails), np.searchsorted(heads, words.first)


def _prints(width: int, bands: int, depth: int, bits: int):
    """The keys of all bands, then a signature: one bit of each of ``bits`` least hashes, whose differing share is half the distance."""
    n_seeds = max(bands * depth, bits)
    seeds = np.random.default_rng(7).integers(0, 1 << 63, (2, n_seeds), np.int64).astype(np.uint64)
    size = bands + bits // 64

    @F.arrow_udf("array<bigint>")
    def prints(text: pa.Array) -> pa.Array:
        data, offsets = textkit.bytes_of(text)
        out = np.zeros((len(offsets) - 1, size), np.uint64)
        for first, last in textkit.groups(offsets):
            own = offsets[first : last + 1]
            hashes, at = _shingles(data[own[0] : own[-1]], own - own[0], width)
            full = np.flatnonzero(np.diff(at))
            if not len(full):
                continue
            begin = at[:-1][full]
            key, signature = np.zeros(len(full), np.uint64), np.zeros((len(full), bits), bool)
            for n in range(n_seeds):
                least = np.minimum.reduceat((hashes ^ seeds[0, n]) * (seeds[1, n] | np.uint64(1)), begin)
                if n < bits:
                    signature[:, n] = textkit.mix(least) & np.uint64(1)
                if n < bands * depth:
                    key = textkit.mix(key * np.uint64(0x9E3779B97F4A7C15) + least + np.uint64(n))
                    if n % depth == depth - 1:
                        out[first + full, n // depth] = key
                        key = np.zeros(len(full), np.uint64)
            out[first + full, bands:] = np.packbits(signature, axis=1).view(np.uint64)
        textkit.trim()
        return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, size), pa.int32()), pa.array(out.view(np.int64).ravel()))

    return prints


def _sets(width: int):
    """The distinct shingle hashes of a text, sorted and packed."""

    @F.arrow_udf("binary")
    def sets(text: pa.Array) -> pa.Array:
        data, offsets = textkit.bytes_of(text)
        out: list[bytes] = []
        for first, last in textkit.groups(offsets):
            own = offsets[first : last + 1]
            hashes, at = _shingles(data[own[0] : own[-1]], own - own[0], width)
            out += [np.unique(hashes[a:b]).tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        textkit.trim()
        return pa.array(out, pa.binary())

    return sets


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two packed sets; two empty ones have 1."""

    @F.arrow_udf("double")
    def jaccard(a: pa.Array, b: pa.Array) -> pa.Array:
        out = np.ones(len(a))
        for n, (x, y) in enumerate(zip(a, b, strict=True)):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            if len(x) or len(y):
                both = len(np.intersect1d(x, y, assume_unique=True))
                out[n] = both / (len(x) + len(y) - both)
        return pa.array(out)

    return jaccard(a, b)


def _similarity(width: int):
    @F.arrow_udf("double")
    def jaccard(a: pa.Array, b: pa.Array) -> pa.Array:
        left, right = textkit.bytes_of(a), textkit.bytes_of(b)
        out = np.ones(len(left[1]) - 1)
        for first, last in textkit.groups(left[1] + right[1]):
            sides = []
            for data, offsets in (left, right):
                own = offsets[first : last + 1]
                sides.append(_shingles(data[own[0] : own[-1]], own - own[0], width))
            for n in range(last - first):
                x, y = (np.unique(h[at[n] : at[n + 1]]) for h, at in sides)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if len(x) or len(y):
                    out[first + n] = both / (len(x) + len(y) - both)
        textkit.trim()
        return pa.array(out)

    return jaccard


def prints(text: Column, width: int = SHINGLE, bands: int = BANDS, depth: int = DEPTH, bits: int = BITS) -> Column:
    """Keys of which two texts share one if all ``depth`` least hashes of a band agree, then ``bits`` bits; texts without words share all."""
    return _prints(width, bands, depth, bits)(text.cast("string"))


def _may_link(a: Column, b: Column, least: float, bits: int = BITS) -> Column:
    """Whether two signatures differ in few enough bits for a similarity of ``least``; one pair at that similarity in 100,000 does not."""
    share = (1 - least) / 2
    most = math.floor(bits * share + 4.5 * math.sqrt(bits * share * (1 - share)))
    apart = sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(bits // 64)), F.lit(0))
    return apart <= most


def _meets_first(a: Column, b: Column, band: Column) -> Column:
    """Whether a band is the first in which two nodes share a key, so that a pair is found once."""
    return F.coalesce(*[F.when(a[i] == b[i], i) for i in range(BANDS + 1)]) == band


def similarity(a: Column, b: Column, width: int = SHINGLE) -> Column:
    """Jaccard similarity of the sets of shingles of two texts; two without words have 1."""
    return _similarity(width)(a.cast("string"), b.cast("string"))


def _verified(edges: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """The ``edges`` (a, b) of nodes that are similar enough. Only the sets of their own shingles are brought together, made once a node."""
    ends = edges.select(F.col("a").alias("n")).distinct().unionByName(edges.select(F.col("b").alias("n")).distinct())
    needed = ends.distinct().join(nodes.select("n", "node"), "n")
    own = texts.join(needed, "node").dropDuplicates(["n"]).select("n", _sets(width)(F.col("text").cast("string")).alias("hashes"))
    own = written(own, "sets")
    pairs = edges.join(own.select(F.col("n").alias("a"), F.col("hashes").alias("x")), "a").join(own.select(F.col("n").alias("b"), F.col("hashes").alias("y")), "b")
    return written(pairs.filter(set_similarity(F.col("x"), F.col("y")) >= least).select("a", "b"), "similar")


def _components(nodes: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """(node, root), by numbers, of nodes (n, node, keys, bits) that are linked with others.

    Every node of a bucket is first compared with that one of them which has the most company in all its buckets, so a
    large group of near copies mostly becomes one component at a linear price. Nodes of a bucket that are in different
    components then are paired, each pair in the first bucket it shares, where their signatures allow the similarity; the test is part of
    the join, and heavy buckets are dealt over several tasks. No pair of a bucket that could join two components is left out.
    """
    members = nodes.select("n", F.posexplode("keys").alias("band", "key"))
    buckets = written(members.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "buckets")
    members = written(members.join(buckets, "key"), "members")
    company = members.groupBy("n").agg(F.sum("size").alias("company"))
    hubs = members.join(company, "n").groupBy("key").agg(F.max(F.struct("company", "n")).alias("hub"))
    stars = members.join(hubs, "key").select(F.least("n", "hub.n").alias("a"), F.greatest("n", "hub.n").alias("b")).filter("a <> b").distinct()
    bits = nodes.select("n", "keys", "bits")
    near = stars.join(bits.select(F.col("n").alias("a"), F.col("bits").alias("p")), "a").join(bits.select(F.col("n").alias("b"), F.col("bits").alias("q")), "b")
    stars = written(near.filter(_may_link(F.col("p"), F.col("q"), least)).select("a", "b"), "stars")
    links = _verified(stars, nodes, texts, width, least)
    roots = connected(links)
    placed = members.join(roots.withColumnRenamed("node", "n"), "n", "left").select("n", "band", "key", "size", F.coalesce("root", "n").alias("c"))
    parted = placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("key")
    open_ = written(placed.join(parted, "key").join(bits, "n").withColumn("shares", F.ceil(F.col("size") / HEAVY)), "parted")
    left = open_.withColumn("share", F.pmod(F.xxhash64("n"), F.col("shares"))).alias("l")
    right = open_.withColumn("share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1))).alias("r")
    match = (F.col("l.key") == F.col("r.key")) & (F.col("l.share") == F.col("r.share")) & (F.col("l.n") < F.col("r.n")) & (F.col("l.c") != F.col("r.c"))
    match = match & _may_link(F.col("l.bits"), F.col("r.bits"), least) & _meets_first(F.col("l.keys"), F.col("r.keys"), F.col("l.band"))
    rest = left.join(right, match).select(F.col("l.n").alias("a"), F.col("r.n").alias("b"))
    rest = written(rest.join(stars, ["a", "b"], "left_anti"), "rest")
    return connected(links.unionByName(_verified(rest, nodes, texts, width, least)))


def _with_rings(nodes: DataFrame) -> DataFrame:
    """The nodes with one key more: that of their SimHash component, fingerprints being linked by pigeonring chains."""
    rings = connected(written(pigeonring_pairs(nodes.select("fp").distinct()), "pairs")).withColumnRenamed("node", "fp")
    ring = F.xxhash64(F.lit("ring"), F.coalesce("root", "fp"))
    return nodes.join(rings, "fp", "left").withColumn("keys", F.array_append("keys", ring)).drop("fp", "root")


def deduplicated(docs: DataFrame, width: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """One document, with its columns, of each component of near-duplicates: that with the smallest doc_id.

    Texts are linked at a Jaccard similarity of ``least`` or more of their sets of shingles
    (``width`` words, A-Z lower-cased; fewer words make one shingle). Equal texts are one node.
    Candidates are texts whose SimHash fingerprints hang together (op6's links, two bits or fewer) or that share a band.
    Links are exact; of the pairs at 0.8 the bands alone miss one in 2,800, the signatures one in 100,000. Null ids come last, equal ids are
    ordered by a hash of the text; of rows that repeat both one stays. Texts without words are near-duplicates of each other.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    node = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("node")
    rows = docs.select(row, F.col("text"), F.col("doc_id").cast("bigint").alias("_id"), F.xxhash64("text").alias("_hash"), node)
    marked = rows.select(F.col("_id").alias("doc_id"), "_hash", "node", prints(F.col("text"), width).alias("prints"), simhash(F.col("text")).alias("fp"))
    marked = written(marked, "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "_hash")).alias("k")
    nodes = marked.groupBy("node").agg(first, F.any_value("prints").alias("prints"), F.any_value("fp").alias("fp")).withColumn("n", F.monotonically_increasing_id())
    nodes = written(nodes.select("n", "node", "k", "fp", F.slice("prints", 1, BANDS).alias("keys"), F.slice("prints", BANDS + 1, BITS // 64).alias("bits")), "nodes")
    nodes = written(_with_rings(nodes), "ringed")
    roots = _components(nodes, rows.select("node", "text"), width, least).withColumnRenamed("node", "n")
    placed = nodes.select("n", "k").join(roots, "n", "left").groupBy(F.coalesce("root", "n").alias("root")).agg(F.min("k").alias("k"))
    kept = placed.select(F.col("k.doc_id").alias("k_id"), F.col("k._hash").alias("k_hash"))
    same = rows["_id"].eqNullSafe(kept["k_id"]) & (rows["_hash"] == kept["k_hash"])
    return rows.drop("text", "node").join(kept, same, "left_semi").dropDuplicates(["_id", "_hash"]).select("_row.*")
