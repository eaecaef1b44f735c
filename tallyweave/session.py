"""Session settings the operators rely on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings; all of them can be set on a session that already exists.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # Statement headers may repeat; the later column wins.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # One statement, contact or tenant may hold a large part of all rows: split it even where that
    # costs another shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Rows shuffled by statement stay in place for joins on the statement and more.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A union that asks its inputs how they are dealt fails where one of them is a join that AQE has split for skew.
    "spark.sql.unionOutputPartitioning": "false",
}

# Whether shuffle files go when a query has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Ranges that a table is cut into however small they are asked for; more only where a range would exceed its usual size.
MOST_SMALL_RANGES = 256


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings every operator expects to a running session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for checkpoints and stream state.

    A cluster names it in ``spark.checkpoint.dir``. Only a session on this machine alone, as in
    tests, may leave that unset; it gets a temporary folder.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tallyweave-")
    context.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table of the checkpoint folder, made once and without lineage; unlike a checkpoint's, its columns are packed.

    What was shuffled to make them goes at once, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path, kept = f"{checkpoint_folder(spark)}/stored-{uuid.uuid4().hex}", spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, kept)
    return spark.read.schema(df.schema).parquet(path)


def ranges_of(rows: int, rows_per_range: int, usual: int) -> int:
    """How many ranges to cut a table into: each has a task, a file and a sample that goes to the driver.

    Ranges of fewer rows than ``usual`` are a wish that holds for ``MOST_SMALL_RANGES`` of them; a larger table has larger ranges.
    """
    wanted = -(-rows // rows_per_range)
    return max(1, min(wanted, max(MOST_SMALL_RANGES, -(-rows // max(usual, rows_per_range)))))


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallyweave")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
    )
    return configure(builder.getOrCreate())
