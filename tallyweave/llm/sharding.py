"""Sharding by extendible hashing: a directory over hash-prefix bits in which only oversized buckets split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.shared import written

HASH_BITS = 60
STEP_BITS = 12  # prefix bits looked at per round
SHARD_BYTES = 1 << 20


def hash_of(key: Column) -> Column:
    """The first 60 bits of a value's MD5 as a number; null counts as an empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("bigint")


def _prefix(bits: Column | int) -> Column:
    return F.call_function("shiftright", F.col("hash"), (F.lit(HASH_BITS) - bits).cast("int"))


def directory(buckets: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """The leaves of the directory over (hash, n_bytes, n_rows): prefix, depth, shard_bytes, shard_rows, oversize.

    A bucket that exceeds ``limit`` bytes splits on its next hash bit, others stay. Each round
    sums the bytes below all prefixes of the next bits at once and goes on with the hashes
    in buckets that are still too large; one that holds a single hash, or whose bits are
    used up, cannot split and is marked ``oversize``. Halves without rows are no leaves.
    """
    open_ = buckets.withColumn("depth", F.lit(0))
    leaves = None
    for done in range(0, HASH_BITS + 1, STEP_BITS):
        top = min(done + STEP_BITS - 1, HASH_BITS)
        narrow = open_.groupBy(_prefix(top).alias("p")).agg(
            F.sum("n_bytes").alias("n_bytes"), F.sum("n_rows").alias("n_rows"), F.min("hash").alias("low"), F.max("hash").alias("high")
        )
        levels = F.explode(F.sequence(F.lit(done), F.lit(top))).alias("depth")
        level = narrow.select("p", "n_bytes", "n_rows", "low", "high", levels).withColumn("prefix", F.call_function("shiftright", "p", F.lit(top) - F.col("depth")))
        level = level.groupBy("depth", "prefix").agg(
            F.sum("n_bytes").alias("shard_bytes"), F.sum("n_rows").alias("shard_rows"), F.min("low").alias("low"), F.max("high").alias("high")
        )
        level = level.withColumn("fits", F.col("shard_bytes") <= limit).withColumn("ends", F.col("fits") | (F.col("low") == F.col("high")) | (F.col("depth") == HASH_BITS))
        level = written(level, "directory")
        # A bucket is a leaf if it ends while its parent had to split; parents of the round's first level did.
        split = level.filter(~F.col("ends"))
        parents = split.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above"))
        ends = level.filter("ends").withColumn("above", F.call_function("shiftright", "prefix", F.lit(1)))
        first = ends.filter(F.col("depth") == done).drop("above")
        later = ends.filter(F.col("depth") > done).join(parents, ["depth", "above"], "left_semi").drop("above")
        found = first.unionByName(later.select(first.columns)).select("prefix", "depth", "shard_bytes", "shard_rows", (~F.col("fits")).alias("oversize"))
        leaves = found if leaves is None else leaves.unionByName(found)
        rest = split.filter(F.col("depth") == top).select("prefix")
        if top >= HASH_BITS or rest.isEmpty():
            break
        open_ = open_.join(rest, _prefix(top) == rest["prefix"], "left_semi")
    return leaves


def sharded(docs: DataFrame, key: str = "doc_id", limit: int = SHARD_BYTES) -> DataFrame:
    """Documents (``key``, text) with their shard: hash, n_bytes, shard (its prefix bits as text), depth, shard_bytes, shard_rows, oversize.

    Shards hold at most ``limit`` bytes of text, unless all rows of one share their key's
    hash (``oversize``): a single row or a key repeated too often. Null texts have 0 bytes,
    null keys hash as an empty text; the text of the only shard of a small or empty table
    has no prefix. Other columns are dropped; every row gives a row.

    Leaves are keyed by as many bits as the shallowest one has: a row meets the few leaves below
    those bits in one equality join, and its hash lies in the range of just one.
    """
    n_bytes = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("bigint")
    rows = written(docs.select(F.col(key).alias("doc_id"), hash_of(F.col(key)).alias("hash"), n_bytes.alias("n_bytes")), "hashes")
    leaves = written(directory(rows.groupBy("hash").agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_rows")), limit), "leaves")
    shallow = F.lit(leaves.agg(F.min("depth")).first()[0] or 0)
    label = F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0")))
    low = F.call_function("shiftleft", "prefix", F.lit(HASH_BITS) - F.col("depth"))
    size = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(HASH_BITS) - F.col("depth"))
    ranges = leaves.select(
        F.call_function("shiftright", "prefix", F.col("depth") - shallow).alias("top"), low.alias("low"), (low + size - 1).alias("high"),
        label.alias("shard"), "depth", "shard_bytes", "shard_rows", "oversize",
    )
    met = (_prefix(shallow) == ranges["top"]) & rows["hash"].between(ranges["low"], ranges["high"])
    return rows.join(ranges, met).drop("top", "low", "high")


SHARDED_SQL = f"""
WITH d AS (
    SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS hash,
        coalesce(octet_length(encode(text)), 0) AS n_bytes
    FROM documents
), level AS (
    SELECT depth, hash >> ({HASH_BITS} - depth) AS prefix, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_rows,
        sum(n_bytes) > {SHARD_BYTES} AS oversize, min(hash) = max(hash) AS one
    FROM d, (SELECT unnest(range(0, {HASH_BITS} + 1)) AS depth) GROUP BY 1, 2
), placed AS (
    SELECT d.doc_id, d.hash, d.n_bytes, min(level.depth) AS depth
    FROM d JOIN level ON d.hash >> ({HASH_BITS} - level.depth) = level.prefix AND (NOT oversize OR one OR level.depth = {HASH_BITS})
    GROUP BY ALL
)
SELECT p.doc_id, p.hash, p.n_bytes, CAST(p.depth AS INTEGER) AS depth, shard_bytes, shard_rows, oversize,
    CASE WHEN p.depth = 0 THEN '' ELSE lpad(bin(level.prefix), CAST(p.depth AS INTEGER), '0') END AS shard
FROM placed p JOIN level ON level.depth = p.depth AND level.prefix = p.hash >> ({HASH_BITS} - p.depth)
"""
