"""The registered queries of this folder and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import decontamination, gridcodes, language, mixing, neardup, periodic, scoring, sharding, substrings, syncmers, token_files, voronoi, warc
from tallyweave.llm.oracles import ORACLES as ORACLES
from tallyweave.llm.shared import configured, remainder, table, written

END_ID = 2


def vocabulary() -> str:
    """The path of the vocabulary file; every worker has it at the same place."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_warc_transactions(spark: SparkSession, folder: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, folder, "pages"))
    rows = warc.captures(warc.read_records(manifest))
    # A response's figures come from the payload in its capture, a revisit's from what its record says.
    payload = F.col("response.payload")
    size = F.coalesce(F.octet_length(payload).cast("bigint"), F.col("response.payload_bytes")).alias("payload_bytes")
    digest = F.coalesce(F.sha2(payload, 256), F.col("response.payload_digest")).alias("payload_digest")
    return rows.select("page_id", "url", size, digest, "response.record_type", "response.refers_to")


def op2_language_codes(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    model = language.fit(docs.filter(~held_out))
    return language.tagged(docs.select("doc_id", "text"), model).drop("text").withColumn("held_out", held_out)


def op3_token_blocks(spark: SparkSession, folder: str) -> DataFrame:
    manifest = token_files.write_token_files(table(spark, folder, "documents"), vocabulary(), END_ID)
    return token_files.read_token_files(manifest, with_ids=False)


def op4_suffix_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.benchmark_matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    items = F.array_distinct(F.array_sort("items"))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def op5_bloom_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 1, F.lit(False))
    return scoring.scored(docs, ~held_out).drop("text_hash").withColumn("held_out", held_out)


def op6_simhash_components(spark: SparkSession, folder: str) -> DataFrame:
    rows = neardup.near_duplicates(table(spark, folder, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def op7_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.without_repeats(table(spark, folder, "documents"), with_text=False).drop("spans", "kept_text")


def op8_extendible_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.sharded(table(spark, folder, "documents"))


def op9_mixed_sources(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    qualities = written(mixing.quality_of(table(spark, folder, "labels")), "qualities")
    rows = mixing.mixed_by_labels(docs, qualities, with_rows=False)
    return rows.select("doc_id", "source", "size", "source_size", "target", "taken", "copies")


def op10_closed_syncmers(spark: SparkSession, folder: str) -> DataFrame:
    return syncmers.compared_with_edits(table(spark, folder, "documents"))


def op11_voronoi_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return voronoi.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_grid_codes(spark: SparkSession, folder: str) -> DataFrame:
    return gridcodes.compressed(table(spark, folder, "embeddings")).drop("label")


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic.repeated_runs(periodic.looped(table(spark, folder, "documents")))
    # The greatest length first, then the smallest start, then the smallest period.
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    rows = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), longest.alias("best"), F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")).alias("lines"), "collapsed")
    return rows.select(
        "doc_id", "n_runs", "best.start", (-F.col("best.less")).alias("length"), "best.period", F.floor(-1000 * F.col("best.less") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


_RUN = [
    op1_warc_transactions, op2_language_codes, op3_token_blocks, op4_suffix_decontamination, op5_bloom_scores,
    op6_simhash_components, op7_repeated_passages, op8_extendible_shards, op9_mixed_sources, op10_closed_syncmers,
    op11_voronoi_neighbours, op12_grid_codes, op13_periodic_runs,
]


def _configured(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: build(configured(spark), folder)


QUERIES = {build.__name__: _configured(build) for build in _RUN}
