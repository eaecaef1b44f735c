"""A corpus from raw documents to token files, in stages that each work on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import decontamination, language, mixing, resemblance, token_files
from tallyweave.llm.queries import END_ID, vocabulary
from tallyweave.llm.shared import configured, scratch, table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the codes tell surely.

    Null, empty and letterless texts go, as do texts as near to a second language or as far from all as hardly any labelled one is. Rows that
    repeat stay or go together, null ids and labels decide nothing, columns of any name stay; no rows give none.
    """
    configured(spark)
    return language.recognised(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: texts at a Jaccard similarity of 0.8 or more in five-word shingles.

    Texts without words are one component. The smallest doc_id stays, null ids last; of rows that repeat id and text one
    stays. Columns of any name stay; no rows give none.
    """
    configured(spark)
    return resemblance.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    Every row is judged by its own text: null and empty ones stay, rows that repeat stay or go together, ids play no
    part. Columns of any name stay; no rows, or a benchmark without words, change nothing.
    """
    configured(spark)
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them whole; one of which it takes less than half is left out.

    Null sources are a source of their own, the last; null and empty texts have no words and are never taken in part, so they
    come as often as their source is taken whole. Rows that repeat are mixed each by itself. Null ids have no label. Columns of
    any name stay; no rows give none.
    """
    configured(spark)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text", "source")
    rows = mixing.mixed_by_labels(rows, written(mixing.quality_of(table(spark, sf_dir, "labels")), "qualities"))
    return rows.select("_row", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("_row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all copies; a row per copy, read back from the files, in ascending doc_id order, null ids last.

    Null and empty texts are an end alone. Rows that repeat give a row each. Other columns are left behind; no rows give none.
    """
    configured(spark)
    manifest = token_files.write_token_files(docs, vocabulary(), END_ID)
    return token_files.read_token_files(manifest, with_ids=False)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("tokens", tokens),
]

# Classifiers, fingerprints and token files are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's result is a table that the next one reads."""
    configured(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
