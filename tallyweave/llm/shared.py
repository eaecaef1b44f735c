"""What the operators of this folder share on the driver: the shared folder, tables that cut lineage, input columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyweave.session import checkpoint_folder, configure

BATCH_BYTES = 8 << 20  # of an Arrow batch; long texts would make batches of a fixed number of rows large


def configured(spark: SparkSession) -> SparkSession:
    """A session with the settings that tasks over texts expect."""
    configure(spark).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """The rows as a table in the shared folder; later steps read it and lost executors cost no recomputation.

    With ``by``, a condition, rows are kept apart by it (column ``apart``), so that either kind is read alone.
    """
    folder = scratch(df.sparkSession, name)
    if by is None:
        df.write.parquet(folder)
        return df.sparkSession.read.schema(df.schema).parquet(folder)
    df.withColumn("apart", F.expr(by)).write.partitionBy("apart").parquet(folder)
    return df.sparkSession.read.schema(StructType(df.schema.fields).add("apart", "boolean")).parquet(folder)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of all texts."""
    return df.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0


def parts_for(total: int, each: int, least: int = 1) -> int:
    """How many parts of about ``each`` bytes ``total`` bytes make."""
    return max(least, -(-total // each))


def remainder(column: Column, by: int) -> Column:
    """crc32 of a value as text, modulo ``by``; null stays null."""
    return F.crc32(column.cast("string").cast("binary")) % by
