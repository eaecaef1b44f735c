"""Comparing extraction results with what was expected, and summing up runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.text import stripped

# Price per million input and output tokens, in dollars.
INPUT_PRICE, OUTPUT_PRICE = 1.0, 5.0

ITEM_FIELDS = ("date", "number", "reference")
METADATA_FIELDS = ("header_mapping", "date_format", "date_confidence")


def diff_items(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Differing text fields of items at the same place; scenarios of unequal length are one row each."""
    counts = _counts(expected, actual)
    same = counts.where(F.col("expected_count") == F.col("actual_count")).select("scenario")
    left = expected.select("scenario", "item_seq", F.struct(*ITEM_FIELDS).alias("e"))
    right = actual.select("scenario", "item_seq", F.struct(*ITEM_FIELDS).alias("a"))
    both = left.join(right, ["scenario", "item_seq"], "full_outer").join(same, "scenario", "left_semi")
    fields = F.array(
        *[
            F.when(
                stripped(F.col(f"e.{f}")) != stripped(F.col(f"a.{f}")),
                F.struct(F.lit(f).alias("field"), F.col(f"e.{f}").alias("expected"), F.col(f"a.{f}").alias("actual")),
            )
            for f in ITEM_FIELDS
        ]
    )
    differing = both.select("scenario", "item_seq", F.explode(F.filter(fields, lambda x: x.isNotNull())).alias("d"))
    lengths = counts.where(F.col("expected_count") != F.col("actual_count")).select(
        "scenario",
        F.lit(None).cast("int").alias("item_seq"),
        F.lit("item_count").alias("field"),
        F.col("expected_count").cast("string").alias("expected"),
        F.col("actual_count").cast("string").alias("actual"),
    )
    return differing.select("scenario", F.col("item_seq").cast("int").alias("item_seq"), "d.*").unionByName(lengths)


def _counts(expected: DataFrame, actual: DataFrame) -> DataFrame:
    left = expected.groupBy("scenario").agg(F.count("*").alias("expected_count"))
    right = actual.groupBy("scenario").agg(F.count("*").alias("actual_count"))
    return left.join(right, "scenario", "full_outer").na.fill(0, ["expected_count", "actual_count"])


def diff_totals(expected: DataFrame, actual: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Differing totals by (scenario, item, label), over the labels of both sides.

    Two amounts may differ by the tolerance; a label missing on one side differs.
    """

    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select("scenario", "item_seq", F.explode("total_amounts").alias("label", name))

    both = long(expected, "expected").join(long(actual, "actual"), ["scenario", "item_seq", "label"], "full_outer")
    close = F.abs(F.col("expected") - F.col("actual")) <= F.lit(tolerance).cast("decimal(10,4)")
    return both.where(~F.coalesce(close, F.col("expected").isNull() & F.col("actual").isNull()))


def diff_metadata(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Differing metadata of a statement; maps are compared as sorted text."""

    def text(side: str, field: str):
        column = F.col(f"{side}.{field}")
        return F.to_json(F.array_sort(F.map_entries(column))) if field == "header_mapping" else column

    left = expected.select("scenario", F.struct(*METADATA_FIELDS).alias("e"))
    right = actual.select("scenario", F.struct(*METADATA_FIELDS).alias("a"))
    fields = F.array(
        *[
            F.when(
                ~text("e", f).eqNullSafe(text("a", f)),
                F.struct(F.lit(f).alias("field"), text("e", f).alias("expected"), text("a", f).alias("actual")),
            )
            for f in METADATA_FIELDS
        ]
    )
    return left.join(right, "scenario", "full_outer").select(
        "scenario", F.explode(F.filter(fields, lambda x: x.isNotNull())).alias("d")
    ).select("scenario", "d.*")


def extraction_run_summary(files: DataFrame) -> DataFrame:
    """Pages, chunks, items, tokens and cost per file, with the run's total (``filename`` null).

    ``files`` has one row per chunk: filename, pages, items, input_tokens, output_tokens, failed.
    """
    cost = (F.col("input_tokens") * INPUT_PRICE + F.col("output_tokens") * OUTPUT_PRICE) / 1_000_000
    return files.rollup("filename").agg(
        F.count("*").alias("chunks"),
        F.sum("pages").cast("bigint").alias("pages"),
        F.sum("items").cast("bigint").alias("items"),
        F.sum("input_tokens").cast("bigint").alias("input_tokens"),
        F.sum("output_tokens").cast("bigint").alias("output_tokens"),
        F.round(F.sum(cost.cast("decimal(20,8)")), 4).cast("double").alias("cost_usd"),
        F.count_if("failed").alias("failures"),
    )
