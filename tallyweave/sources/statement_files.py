"""Statements as self-describing JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.schemas import STATEMENT_KEYS

# A document holds at most about this many items; a longer statement is several documents.
ITEMS_PER_DOCUMENT = 5_000

_ITEM = """struct<item_seq:bigint,statement_item_id:string,date:string,number:string,due_date:string,reference:string,
  total:map<string,string>,raw:map<string,string>,item_type:string,flags:array<string>>"""

_DOCUMENT = f"""tenant_id string, statement_id string, part int, date_format string, date_confidence string,
  detected_headers array<string>, column_order array<string>, header_mapping map<string,string>,
  earliest_item_date date, latest_item_date date, statement_items array<{_ITEM}>"""


def write_statement_json(
    statements: DataFrame, items: DataFrame, folder: str, per_document: int = ITEMS_PER_DOCUMENT
) -> None:
    """One JSON document per statement with its items in order.

    A statement with more than ``per_document`` items continues in further documents (``part``), so
    no statement has to fit into one row. Every document carries the statement's metadata, and every
    item its number, so documents are read the same way however they were split.
    """
    fields = ["item_seq", "statement_item_id", "date", "number", "due_date", "reference", "total", "raw", "item_type", "flags"]
    row = F.struct(*[F.col(f) if f in items.columns else F.lit(None).cast(_types()[f]).alias(f) for f in fields])
    part = F.floor((F.col("item_seq") - 1) / per_document).cast("int")
    grouped = items.withColumn("part", part).groupBy(*STATEMENT_KEYS, "part").agg(
        # Maps cannot be sorted, so the items wait as JSON text.
        F.sort_array(F.collect_list(F.struct("item_seq", F.to_json(row).alias("item")))).alias("ordered")
    )
    listed = grouped.select(
        *STATEMENT_KEYS, "part", F.transform("ordered", lambda x: F.from_json(x["item"], _ITEM)).alias("statement_items")
    )
    meta = [c for c in _meta_columns() if c in statements.columns]
    documents = statements.select(*STATEMENT_KEYS, *meta).join(listed, STATEMENT_KEYS, "left").na.fill(0, ["part"])
    documents.write.mode("overwrite").json(folder)


def _types() -> dict[str, str]:
    return {
        "item_seq": "bigint", "statement_item_id": "string", "date": "string", "number": "string", "due_date": "string", "reference": "string",
        "total": "map<string,string>", "raw": "map<string,string>", "item_type": "string", "flags": "array<string>",
    }


def _meta_columns() -> list[str]:
    return [
        "date_format", "date_confidence", "detected_headers", "column_order", "header_mapping",
        "earliest_item_date", "latest_item_date",
    ]


def read_statements(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Statements and items of a folder of documents; a folder that is not there is an error.

    Items without a number, as in documents of other origin, are numbered by their place.
    """
    documents = spark.read.schema(_DOCUMENT).json(folder)
    statements = documents.where(F.coalesce("part", F.lit(0)) == 0).drop("part", "statement_items")
    items = documents.select(
        *STATEMENT_KEYS, F.posexplode("statement_items").alias("pos", "item")
    ).select(*STATEMENT_KEYS, "item.*", (F.col("pos") + 1).cast("bigint").alias("place"))
    return statements, items.withColumn("item_seq", F.coalesce("item_seq", "place")).drop("place")
