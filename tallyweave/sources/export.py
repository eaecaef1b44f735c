"""Flat export of reconciled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.operators.comparison import export_lines
from tallyweave.schemas import STATEMENT_KEYS


def _csv_field(value: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.rlike('[",\\r\\n]'), quoted).otherwise(F.coalesce(value, F.lit("")))


def export_reconciliation(rows: DataFrame, folder: str) -> None:
    """CSV lines per statement: its heading, then its items in order.

    Statements differ in their columns, so a line is one text column next to its statement and item
    number. Files are grouped by tenant and sorted by statement and item.
    """
    lines = export_lines(rows).withColumn("value", F.array_join(F.transform("line", _csv_field), ","))
    (
        lines.repartitionByRange("tenant_id", "statement_id", "item_seq")
        .sortWithinPartitions(*STATEMENT_KEYS, "item_seq")
        .select("tenant_id", "statement_id", "item_seq", "value")
        .write.mode("overwrite")
        .partitionBy("tenant_id")
        .option("header", True)
        .csv(folder)
    )
