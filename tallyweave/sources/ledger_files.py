"""Ledger data sets: per-tenant JSON files, and a table laid out by contact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.operators.ledger import bundle_by_contact
from tallyweave.schemas import CONTACT_KEYS
from tallyweave.sources.json_ranges import BLOCK_BYTES, record_texts

# Contacts are spread over this many folders, whatever their number.
CONTACT_BUCKETS = 256


def read_ledger(spark: SparkSession, folder: str, kind: str, record: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Records of one kind from ``<folder>/<tenant>/data/<kind>.json`` of all tenants.

    A file holds a list of records or a mapping of records by id; ``record`` is the record's schema
    as DDL. A large file is read by several tasks, cut at record borders. ``load_seq`` is the record's place in the file.
    """
    texts = record_texts(spark, f"{folder}/*/data/{kind}.json", block_bytes)
    tenant = F.regexp_extract("path", r"([^/]+)/data/[^/]+$", 1).alias("tenant_id")
    return texts.select(tenant, F.from_json("text", f"struct<{_struct(record)}>").alias("r"), F.col("place").alias("load_seq")).select("tenant_id", "r.*", "load_seq")


def _struct(ddl: str) -> str:
    """'a string, b int' as the inside of a struct type."""
    return ",".join(":".join(part.strip().split(" ", 1)) for part in ddl.split(","))


def contact_bucket() -> Column:
    """The folder number of a contact."""
    return F.pmod(F.xxhash64(*CONTACT_KEYS), F.lit(CONTACT_BUCKETS)).cast("int")


def write_ledger_by_contact(docs: DataFrame, payments: DataFrame, folder: str) -> None:
    """Write the contact bundles, sorted by contact within a fixed number of bucket folders.

    Rows without a contact are not written; nothing could reach them. A contact with very many
    records is several bundle rows, and a bucket is split over tasks by contact and part.
    """
    bundles = bundle_by_contact(docs, payments).withColumn("bucket", contact_bucket())
    (
        bundles.repartitionByRange("bucket", *CONTACT_KEYS, "part")
        .sortWithinPartitions("bucket", *CONTACT_KEYS, "part")
        .write.mode("overwrite")
        .partitionBy("bucket")
        .parquet(folder)
    )


def read_ledger_for_contacts(spark: SparkSession, folder: str, contacts: DataFrame) -> DataFrame:
    """Bundles of the wanted contacts; whole bucket folders are skipped by dynamic pruning."""
    wanted = contacts.where(F.col("contact_id").isNotNull()).select(*CONTACT_KEYS).distinct()
    wanted = wanted.withColumn("bucket", contact_bucket())
    return spark.read.parquet(folder).join(wanted, ["bucket", *CONTACT_KEYS], "left_semi")


def unbundle(bundles: DataFrame, kind: str) -> DataFrame:
    """The rows of one kind ('invoices', 'credit_notes' or 'payments') of bundles."""
    return bundles.select(*CONTACT_KEYS, F.explode(kind).alias("r")).select(*CONTACT_KEYS, "r.*")
