"""Contact bundles kept current while the ledger streams in: a batch rewrites only the buckets it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyweave.functions.text import has_text
from tallyweave.operators.ledger import bundle_by_contact
from tallyweave.schemas import CONTACT_KEYS
from tallyweave.sources.ledger_files import contact_bucket

# Record ids are spread over this many folders of the index from records to contacts.
ID_BUCKETS = 256

_ID = ["tenant_id", "is_payment", "record_id"]
_VERSIONS = "tables string, bucket int, version bigint"


def ledger_records(docs: DataFrame, payments: DataFrame) -> DataFrame:
    """Documents and payments as rows of one kind, which one stream can carry."""

    def records(rows: DataFrame, is_payment: bool, record_id: str) -> DataFrame:
        whole = F.struct(*[c for c in rows.columns if c not in CONTACT_KEYS]).alias("payment" if is_payment else "doc")
        return rows.select(*CONTACT_KEYS, F.lit(is_payment).alias("is_payment"), F.col(record_id).alias("record_id"), F.col("load_seq").cast("bigint").alias("load_seq"), whole)

    return records(docs, False, "doc_id").unionByName(records(payments, True, "payment_id"), allowMissingColumns=True)


def _id_bucket() -> Column:
    return F.pmod(F.xxhash64(*_ID), F.lit(ID_BUCKETS)).cast("int")


def _versions(spark: SparkSession, folder: str, before: int | None = None) -> dict[str, dict[int, int]]:
    """Which version of each bucket holds, as the last whole batch (before a given one) left it: at most a row per bucket."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/versions")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return {"bundles": {}, "contacts": {}}
    rows = spark.read.schema(f"{_VERSIONS}, batch bigint").parquet(f"{folder}/versions")
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    last = rows.agg(F.max("batch")).first()[0]
    out: dict[str, dict[int, int]] = {"bundles": {}, "contacts": {}}
    for r in rows.where(F.col("batch") == last).collect() if last is not None else []:
        out[r["tables"]][r["bucket"]] = r["version"]
    return out


def _buckets(spark: SparkSession, folder: str, table: str, versions: dict[int, int], wanted: set[int] | None = None) -> DataFrame | None:
    """The rows of a table's buckets, each in its version; null if none of them holds rows."""
    paths = [f"{folder}/{table}/batch={v}/bucket={b}" for b, v in sorted(versions.items()) if wanted is None or b in wanted]
    return spark.read.option("basePath", f"{folder}/{table}").parquet(*paths).drop("batch", "bucket") if paths else None


def _written(rows: DataFrame, folder: str, table: str, batch: int) -> dict[int, int]:
    """Write a batch's buckets of a table; which ones hold rows."""
    target = f"{folder}/{table}/batch={batch}"
    rows.write.mode("overwrite").partitionBy("bucket").parquet(target)
    return {r["bucket"]: batch for r in rows.sparkSession.read.schema(rows.schema).parquet(target).select("bucket").distinct().collect()}


def _unbundled(bundles: DataFrame) -> DataFrame:
    """The records that bundles are made of."""
    docs = bundles.select(*CONTACT_KEYS, F.explode(F.concat("invoices", "credit_notes")).alias("doc"))
    payments = bundles.select(*CONTACT_KEYS, F.explode("payments").alias("payment"))
    docs = docs.select(*CONTACT_KEYS, F.lit(False).alias("is_payment"), F.col("doc.doc_id").alias("record_id"), "doc")
    payments = payments.select(*CONTACT_KEYS, F.lit(True).alias("is_payment"), F.col("payment.payment_id").alias("record_id"), "payment")
    return docs.unionByName(payments, allowMissingColumns=True)


def _distinct_buckets(rows: DataFrame, bucket: Column) -> set[int]:
    return {r[0] for r in rows.select(bucket.alias("b")).distinct().collect()}


def bundle_batch(folder: str, **options) -> Callable[[DataFrame, int], None]:
    """Handler for ``foreachBatch`` over ``ledger_records``: lay a batch over the bundles.

    Of rows that repeat an id in a batch the one with the last ``load_seq`` counts, as in ``upsert_ledger``; rows without an
    id are all added. An index by record id tells which contact had a record before, so a
    record that moves leaves its old contact. Only buckets of contacts that gain or lose a record are read and written
    anew, under the batch's number; a version table, one file written last, says which version of each bucket counts.
    A batch that runs again starts from the versions before it. ``options`` go to ``bundle_by_contact``.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        versions = _versions(spark, folder, before=batch_id)
        keyed = F.coalesce(F.col("record_id"), F.lit("")) != ""
        others = [c for c in batch.columns if c not in _ID]
        latest = batch.where(keyed).groupBy(*_ID).agg(F.max_by(F.struct(*others), "load_seq").alias("r")).select(*_ID, "r.*")
        changes = latest.unionByName(batch.where(~keyed).select(*latest.columns))
        changes.write.mode("overwrite").parquet(f"{folder}/changes/batch={batch_id}")
        changes = spark.read.schema(changes.schema).parquet(f"{folder}/changes/batch={batch_id}")

        ids = changes.where(keyed).select(*_ID, "contact_id")
        touched_ids = _distinct_buckets(ids, _id_bucket())
        known = _buckets(spark, folder, "contacts", versions["contacts"], touched_ids)
        index, touched = ids, changes.where(has_text("contact_id")).select(*CONTACT_KEYS)
        if known is not None:
            moved = known.join(ids.select(*_ID), _ID, "left_semi")
            touched = touched.unionByName(moved.where(has_text("contact_id")).select(*CONTACT_KEYS))
            index = known.join(ids.select(*_ID), _ID, "left_anti").unionByName(ids)
        # A bucket is in one task, so that each is a file and not one per task.
        now = {"contacts": _written(index.withColumn("bucket", _id_bucket()).repartition("bucket"), folder, "contacts", batch_id)}

        wanted = _distinct_buckets(touched, contact_bucket())
        records = changes.drop("load_seq")
        before = _buckets(spark, folder, "bundles", versions["bundles"], wanted)
        if before is not None:
            gone = ids.select(*_ID)
            kept = _unbundled(before)
            records = kept.join(gone, _ID, "left_anti").unionByName(records, allowMissingColumns=True)
            # Bundling reads them several times.
            records.write.mode("overwrite").parquet(f"{folder}/records/batch={batch_id}")
            records = spark.read.schema(records.schema).parquet(f"{folder}/records/batch={batch_id}")
        docs = records.where(~F.col("is_payment")).select(*CONTACT_KEYS, "doc.*")
        payments = records.where("is_payment").select(*CONTACT_KEYS, "payment.*")
        bundles = bundle_by_contact(docs, payments, **options).withColumn("bucket", contact_bucket())
        ordered = bundles.repartitionByRange("bucket", *CONTACT_KEYS, "part").sortWithinPartitions("bucket", *CONTACT_KEYS, "part")
        now["bundles"] = _written(ordered, folder, "bundles", batch_id)

        rewritten = {"contacts": touched_ids, "bundles": wanted}
        rows = [(t, b, v) for t in now for b, v in ({b: v for b, v in versions[t].items() if b not in rewritten[t]} | now[t]).items()]
        spark.createDataFrame(rows, _VERSIONS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/versions/batch={batch_id}")

    return handle


def stream_contact_bundles(records: DataFrame, folder: str, checkpoint: str, **options) -> StreamingQuery:
    """Keep the contact bundles current from a stream of ``ledger_records``."""
    return (
        records.writeStream.foreachBatch(bundle_batch(folder, **options))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_bundles(spark: SparkSession, folder: str, contacts: DataFrame | None = None) -> DataFrame:
    """The bundles as the last whole batch left them; those of some ``contacts`` read these contacts' buckets alone."""
    versions = _versions(spark, folder)["bundles"]
    wanted = None if contacts is None else _distinct_buckets(contacts.where(F.col("contact_id").isNotNull()), contact_bucket())
    found = _buckets(spark, folder, "bundles", versions, wanted)
    if found is None:
        raise ValueError(f"{folder} holds no bundles of these contacts")
    return found if contacts is None else found.join(contacts.select(*CONTACT_KEYS).distinct(), CONTACT_KEYS, "left_semi")
