"""Backup of a tenant's statements and the plan to restore them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.text import has_text, stripped
from tallyweave.schemas import STATEMENT_KEYS


def snapshot_manifest(headers: DataFrame, tenants: DataFrame) -> DataFrame:
    """The statement headers of the given tenants, by upload time; blank ids are left out."""
    listed = headers.where((F.coalesce("record_type", F.lit("statement")) == "statement") & has_text("statement_id"))
    return listed.join(tenants.select("tenant_id").distinct(), "tenant_id", "left_semi").orderBy("tenant_id", "uploaded_at")


def write_snapshot(tables: dict[str, DataFrame], tenants: DataFrame, folder: str) -> None:
    """One folder per table, partitioned by tenant, with the rows of the given tenants."""
    wanted = tenants.select("tenant_id").distinct()
    for name, table in tables.items():
        rows = table.join(wanted, "tenant_id", "left_semi")
        rows.write.mode("overwrite").partitionBy("tenant_id").parquet(f"{folder}/{name}")


def read_snapshot(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def restore_plan(manifest: DataFrame, files: DataFrame, run: str) -> DataFrame:
    """Old and new id of each statement in a manifest, and why a statement is not restored.

    New ids are derived from the run and the old id, so a repeated task gives the same ones.
    """
    present = files.select(*STATEMENT_KEYS).distinct().withColumn("present", F.lit(True))
    joined = manifest.join(present, STATEMENT_KEYS, "left")
    restored = F.col("present").isNotNull() & has_text("contact_id")
    return joined.select(
        "tenant_id",
        F.col("statement_id").alias("old_statement_id"),
        F.when(restored, F.sha2(F.concat_ws("|", F.lit(run), "tenant_id", "statement_id"), 256)).alias("new_statement_id"),
        restored.alias("restored"),
        F.when(~restored, "missing-file-or-contact").alias("skip_reason"),
        stripped("contact_id").alias("contact_id"),
        stripped("contact_name").alias("contact_name"),
    )


def restored_headers(plan: DataFrame, restored_at) -> DataFrame:
    """Fresh statement headers of the restored statements."""
    return plan.where("restored").select(
        "tenant_id",
        F.col("new_statement_id").alias("statement_id"),
        "contact_id",
        "contact_name",
        F.lit(restored_at).cast("timestamp").alias("uploaded_at"),
        F.lit(False).alias("completed"),
        F.lit("statement").alias("record_type"),
    )
