"""Streams built from the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyweave.operators import flags, tokens
from tallyweave.operators.ledger import upsert_ledger

# Ids of processed events are spread over this many folders.
PROCESSED_BUCKETS = 64


def flag_stream(items: DataFrame) -> DataFrame:
    """Flag items as they land; the rules look at single rows, so there is no state."""
    return flags.flag_items(items)


def dedupe_event_stream(events: DataFrame, key: str = "event_id") -> DataFrame:
    """First delivery of each event, however late it comes and however much later it is repeated.

    The ids of all events are kept in the stream's state, which grows with them; ``stream_unique_events`` keeps
    them in a table instead. Events without an id pass.
    """
    keyed = events.where(F.col(key).isNotNull()).dropDuplicates([key])
    return keyed.unionByName(events.where(F.col(key).isNull()))


def _id_bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(PROCESSED_BUCKETS)).cast("int")


def _processed(spark: SparkSession, folder: str, key: str, kind: str) -> DataFrame:
    return spark.read.schema(f"{key} {kind}, batch bigint, bucket int").parquet(f"{folder}/processed")


def unique_batch(folder: str, key: str = "event_id", order: str = "received_at") -> Callable[[DataFrame, int], None]:
    """Handler for ``foreachBatch``: keep the events of a batch that no batch before it had, and note their ids.

    Ids lie in buckets by hash, sorted; a batch reads only buckets of its own ids, and joins on them. Of
    an event repeated within the batch the first by ``order`` is kept; events without an id all are. The
    batch's events and ids go to folders of its number, and ids of its own number are not looked at, so a batch that runs again after
    a failure gives the same. The stream itself has no state.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark, kind = batch.sparkSession, dict(batch.dtypes)[key]
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/processed")
        firsts = tokens.dedupe_events(batch.where(F.col(key).isNotNull()), key, order).withColumn("bucket", _id_bucket(key))
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            buckets = [r[0] for r in firsts.select("bucket").distinct().collect()]  # no more than there are buckets
            known = _processed(spark, folder, key, kind).where((F.col("batch") < batch_id) & F.col("bucket").isin(buckets))
            firsts = firsts.join(known.select("bucket", key), ["bucket", key], "left_anti")
        kept = firsts.select(*batch.columns).unionByName(batch.where(F.col(key).isNull()))
        kept.write.mode("overwrite").parquet(f"{folder}/events/batch={batch_id}")
        written = spark.read.schema(batch.schema).parquet(f"{folder}/events/batch={batch_id}").where(F.col(key).isNotNull())
        ids = written.select(key, _id_bucket(key).alias("bucket")).repartition("bucket").sortWithinPartitions("bucket", key)
        ids.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/processed/batch={batch_id}")

    return handle


def stream_unique_events(events: DataFrame, folder: str, checkpoint: str, key: str = "event_id", order: str = "received_at") -> StreamingQuery:
    """First deliveries to ``<folder>/events``, ids of all events so far to ``<folder>/processed``."""
    return (
        events.writeStream.foreachBatch(unique_batch(folder, key, order))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def fold_processed(spark: SparkSession, folder: str, key: str = "event_id", kind: str = "string") -> None:
    """Rewrite the ids of all batches but the last as those of the first, a file per bucket, so that a batch opens few files.

    Run it between batches. The folded ids stand in a folder of their own before the old ones go.
    """
    rows = _processed(spark, folder, key, kind)
    batches = sorted(r[0] for r in rows.select("batch").distinct().collect())
    if len(batches) < 3:
        return
    folded = rows.where(F.col("batch") < batches[-1]).select(key, "bucket").repartition("bucket").sortWithinPartitions("bucket", key)
    folded.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/folding")
    system = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    at = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    # The folded ids are a batch before the first until the old ones are gone: ids that stand there twice do no harm.
    system.rename(at("folding"), at("processed/batch=-1"))
    for b in batches[:-1]:
        system.delete(at(f"processed/batch={b}"), True)
    system.rename(at("processed/batch=-1"), at(f"processed/batch={batches[0]}"))


def error_alert_stream(logs: DataFrame, width: str = "1 minute", late: str = "1 minute", threshold: int = 1) -> DataFrame:
    """Windows with at least ``threshold`` errors, emitted once they can no longer change."""
    errors = logs.where(F.col("level") == "ERROR").withWatermark("ts", late)
    counted = errors.groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("errors"))
    return counted.where(F.col("errors") >= threshold).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "errors"
    )


def latest_state_stream(events: DataFrame, keys: list[str], values: list[str], order: list[str]) -> DataFrame:
    """Latest values per key, in update mode: sync progress, processing stages, subscriptions."""
    latest = events.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("latest"))
    return latest.select(*keys, "latest.*")


def append_batch(folder: str) -> Callable[[DataFrame, int], None]:
    """Handler for ``foreachBatch``: keep a batch of changed rows under its number.

    A batch that runs again after a failure overwrites its own folder. A source that fails raises
    and fails the batch, so missing rows are never taken for an empty data set.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return handle


def read_current_ledger(spark: SparkSession, folder: str, key: str, order: str = "load_seq") -> DataFrame:
    """The ledger after all batches: per key the latest row of the latest batch; keyless rows are kept.

    Writing a batch costs what the batch holds, not what the ledger holds. ``compact_ledger`` folds
    the batches from time to time.
    """
    rows = spark.read.parquet(folder).withColumn("arrival", F.struct("batch", order))
    return upsert_ledger(rows.limit(0), rows, key, "arrival").drop("arrival", "batch")


def compact_ledger(spark: SparkSession, folder: str, target: str, key: str, order: str = "load_seq") -> None:
    """Write the current ledger as batch 0 of a new folder, for later batches to follow."""
    read_current_ledger(spark, folder, key, order).write.mode("overwrite").parquet(f"{target}/batch=0")


def stream_upsert_ledger(deltas: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keep a ledger current from a stream of changed rows; what was read is in the checkpoint."""
    return (
        deltas.writeStream.foreachBatch(append_batch(folder))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
