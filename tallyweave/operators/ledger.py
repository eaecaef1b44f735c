"""The ledger tables: keeping them current, grouping them, and checking them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.text import has_text, stripped
from tallyweave.schemas import CONTACT_KEYS

# The key of each data set.
LEDGER_KEYS = {
    "contacts": "contact_id",
    "credit_notes": "credit_note_id",
    "payments": "payment_id",
    "invoices": "invoice_id",
}

# A bundle row holds at most this many documents; a contact with more gets several rows.
BUNDLE_SIZE = 5_000


def _latest(rows: DataFrame, keys: Sequence[str], order: Column, first: bool = False) -> DataFrame:
    """One row per key by partial aggregation: a key repeated very often costs no extra."""
    pick = F.min_by if first else F.max_by
    others = [c for c in rows.columns if c not in keys]
    return (
        rows.groupBy(*keys)
        .agg(pick(F.struct(*others), order).alias("row"))
        .select(*[F.col(c) if c in keys else F.col(f"row.{c}").alias(c) for c in rows.columns])
    )


def upsert_ledger(existing: DataFrame, delta: DataFrame, key: str, order: str = "load_seq") -> DataFrame:
    """Existing rows with the delta's laid over them by (tenant, key); later rows of a side win.

    Rows without a key are all kept. Nothing is ever removed, so a document that later drops out
    of the source keeps its last copy.
    """
    both = existing.withColumn("from_delta", F.lit(0)).unionByName(
        delta.withColumn("from_delta", F.lit(1)), allowMissingColumns=True
    )
    keyed = F.coalesce(F.col(key), F.lit("")) != ""
    latest = _latest(both.where(keyed), ["tenant_id", key], F.struct("from_delta", order))
    return latest.unionByName(both.where(~keyed)).drop("from_delta")


def dedupe_pages(rows: DataFrame, key: str, keep: str, order: str = "load_seq") -> DataFrame:
    """Rows of all pages with one row per (tenant, key): the first or the last one seen.

    With ``keep='first'`` (contacts) rows without a key are dropped; with 'last' they are kept.
    """
    keyed = F.coalesce(F.col(key), F.lit("")) != ""
    unique = _latest(rows.where(keyed), ["tenant_id", key], F.col(order), first=keep == "first")
    return unique if keep == "first" else unique.unionByName(rows.where(~keyed))


def bundle_by_contact(docs: DataFrame, payments: DataFrame, bundle_size: int = BUNDLE_SIZE) -> DataFrame:
    """Invoices, credit notes and payments of each contact as arrays; rows without a contact are left out.

    A contact is one row as long as it has at most about ``bundle_size`` records. A larger one is
    spread over ``parts`` rows by record id, or by ``load_seq`` where records have no id, so no
    contact has to fit into one row or one task.
    """

    def spread_by(rows: DataFrame, record_id: str) -> Column:
        order = F.col("load_seq") if "load_seq" in rows.columns else F.lit(0)
        return F.when(F.col(record_id).isNull(), F.xxhash64(order)).otherwise(F.xxhash64(record_id)).alias("spread")

    doc_rows = docs.where(has_text("contact_id")).select(
        *CONTACT_KEYS,
        F.col("doc_kind").alias("kind"),
        F.col("doc_id").alias("record_id"),
        spread_by(docs, "doc_id"),
        F.struct(*[c for c in docs.columns if c not in CONTACT_KEYS]).alias("doc"),
    )
    payment_rows = payments.where(has_text("contact_id")).select(
        *CONTACT_KEYS,
        F.lit("payment").alias("kind"),
        F.col("payment_id").alias("record_id"),
        spread_by(payments, "payment_id"),
        F.struct(*[c for c in payments.columns if c not in CONTACT_KEYS]).alias("payment"),
    )
    records = doc_rows.unionByName(payment_rows, allowMissingColumns=True)
    sizes = records.groupBy(*CONTACT_KEYS).agg(F.ceil(F.count("*") / bundle_size).cast("int").alias("parts"))
    spread = records.join(sizes, CONTACT_KEYS).withColumn("part", F.pmod("spread", F.col("parts")).cast("int")).drop("spread")

    def listed(kind: str, column: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("record_id", column))))

    grouped = spread.groupBy(*CONTACT_KEYS, "part", "parts").agg(
        listed("invoice", "doc").alias("invoices"),
        listed("credit_note", "doc").alias("credit_notes"),
        listed("payment", "payment").alias("payments"),
    )
    return grouped.select(
        *CONTACT_KEYS,
        "part",
        "parts",
        F.transform("invoices", lambda r: r["doc"]).alias("invoices"),
        F.transform("credit_notes", lambda r: r["doc"]).alias("credit_notes"),
        F.transform("payments", lambda r: r["payment"]).alias("payments"),
    )


def duplicate_ids(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Ids that occur more than once, most frequent first."""
    return (
        docs.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count("*").alias("occurrences"))
        .where("occurrences > 1")
        .orderBy(F.desc("occurrences"), key)
    )


def id_summary(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows, missing ids and distinct ids."""
    counted = docs.groupBy(key).agg(F.count("*").alias("n"))
    return counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0)).alias("missing"),
        F.count(key).alias("unique_ids"),
        F.count_if(F.col(key).isNotNull() & (F.col("n") > 1)).alias("repeated_ids"),
    )


def order_ledger(rows: DataFrame, kind: str) -> DataFrame:
    """The list order of a data set: contacts by name, invoices by number, the others by id."""
    keys = {
        "contacts": F.lower(F.coalesce("name", F.lit(""))) if "name" in rows.columns else F.lit(""),
        "invoices": F.lower(F.coalesce("number", F.lit(""))) if "number" in rows.columns else F.lit(""),
        "credit_notes": F.coalesce("doc_id", F.lit("")) if "doc_id" in rows.columns else F.lit(""),
        "payments": F.coalesce("payment_id", F.lit("")) if "payment_id" in rows.columns else F.lit(""),
    }
    return rows.orderBy("tenant_id", keys[kind])


def guard_existing(candidates: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates without a live counterpart, and the live counterparts of the others to retire.

    A candidate meets existing documents of its contact and kind by number; without a number, by
    reference. Deleted and voided ones do not count. Drafts and submitted ones become DELETED, the
    others VOIDED.
    """
    status = F.upper(stripped("status"))
    live = docs.where(~status.isin("DELETED", "VOIDED"))
    scope = [*CONTACT_KEYS, "doc_kind"]
    numbers = candidates.where(has_text("number")).select(*scope, "number").distinct()
    references = candidates.where(~has_text("number") & has_text("reference")).select(*scope, "reference").distinct()
    hit = live.join(numbers, [*scope, "number"], "left_semi").unionByName(
        live.join(references, [*scope, "reference"], "left_semi")
    )
    retire = (
        hit.select("tenant_id", "doc_id", "doc_kind", "status")
        .distinct()
        .withColumn("next_status", F.when(status.isin("DRAFT", "SUBMITTED"), "DELETED").otherwise("VOIDED"))
    )
    unseen_number = candidates.where(has_text("number")).join(live.select(*scope, "number").distinct(), [*scope, "number"], "left_anti")
    no_number = candidates.where(~has_text("number"))
    unseen_reference = no_number.join(live.select(*scope, "reference").distinct(), [*scope, "reference"], "left_anti")
    create = unseen_number.unionByName(unseen_reference.select(*unseen_number.columns))
    return create.select(*candidates.columns), retire
