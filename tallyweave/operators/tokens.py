"""The token ledger: balances, reservations, settlements and what they cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.text import stripped
from tallyweave.operators.values import price_purchases, tier_table
from tallyweave.schemas import STATEMENT_KEYS
from tallyweave.session import checkpoint_folder, ranges_of

# Entries, about, that a task orders for running balances.
ROWS_PER_SLICE = 250_000

# Entry types and sources of the ledger.
RESERVE, RELEASE, CONSUME, ADJUSTMENT = "RESERVE", "RELEASE", "CONSUME", "ADJUSTMENT"
SOURCE_SUBSCRIPTION = "subscription"
SOURCE_WELCOME = "welcome-grant"
SOURCE_MANUAL = "manual-script"
SOURCE_CHECKOUT = "checkout"
WELCOME_TOKENS = 5


def token_balances(ledger: DataFrame) -> DataFrame:
    """Balance of each tenant and its last mutation, folded from the ledger.

    Settlements that consume a reservation change nothing and are not the last mutation.
    """
    moved = F.col("entry_type") != CONSUME
    last = F.max_by(
        F.when(moved, F.struct("entry_id", "entry_type", "source", "created_at")),
        F.when(moved, F.struct("created_at", "entry_id")),
    )
    return (
        ledger.groupBy("tenant_id")
        .agg(F.coalesce(F.sum("token_delta"), F.lit(0)).cast("bigint").alias("token_balance"), last.alias("last"))
        .select(
            "tenant_id",
            "token_balance",
            F.col("last.entry_id").alias("last_entry_id"),
            F.col("last.entry_type").alias("last_mutation_type"),
            F.col("last.source").alias("last_mutation_source"),
            F.col("last.created_at").alias("updated_at"),
        )
    )


def balance_audit(snapshot: DataFrame, ledger: DataFrame) -> DataFrame:
    """Tenants whose stored balance differs from their folded ledger; a missing side counts as 0."""
    folded = token_balances(ledger).select("tenant_id", F.col("token_balance").alias("ledger_balance"))
    stored = snapshot.select("tenant_id", F.col("token_balance").alias("snapshot_balance"))
    both = stored.join(folded, "tenant_id", "full_outer").na.fill(0, ["snapshot_balance", "ledger_balance"])
    return both.where(F.col("snapshot_balance") != F.col("ledger_balance"))


def tokens_credited_by_source(ledger: DataFrame) -> DataFrame:
    """Tokens added per source, with a subtotal per tenant and the grand total (null columns)."""
    return (
        ledger.where(F.col("token_delta") > 0)
        .rollup("tenant_id", "source")
        .agg(F.sum("token_delta").cast("bigint").alias("tokens"), F.count("*").alias("entries"))
    )


def ledger_running_balance(ledger: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Add ``running_balance`` after each entry and ``overdrawn`` where an entry takes it below zero.

    A running total over a whole tenant would order all of its entries in one task. Instead the ledger is cut in ranges of
    (tenant, time, entry) of about ``rows_per_slice`` rows: the window runs inside a slice, which starts from the
    sums of the tenant's slices before it, one row per tenant and slice. A tenant whose entries all
    have one time is many slices too. A long ledger has larger slices than asked for, not tens of thousands of them.
    """
    checkpoint_folder(ledger.sparkSession)
    slices = ranges_of(ledger.count(), rows_per_slice, ROWS_PER_SLICE)
    # Written once: the number of a slice is that of its task.
    sliced = ledger.repartitionByRange(slices, "tenant_id", "created_at", "entry_id").withColumn("slice", F.spark_partition_id()).checkpoint()
    sums = sliced.groupBy("tenant_id", "slice").agg(F.sum("token_delta").alias("moved"))
    before = Window.partitionBy("tenant_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    opening = sums.withColumn("opening", F.coalesce(F.sum("moved").over(before), F.lit(0))).drop("moved")
    inside = (
        Window.partitionBy("tenant_id", "slice")
        .orderBy("created_at", "entry_id")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        sliced.join(opening, ["tenant_id", "slice"])
        .withColumn("running_balance", (F.col("opening") + F.sum("token_delta").over(inside)).cast("bigint"))
        .withColumn("overdrawn", (F.col("running_balance") < 0) & (F.col("token_delta") < 0))
        .drop("slice", "opening")
    )


def first_overdraft(ledger: DataFrame) -> DataFrame:
    """The first entry of each tenant that overdraws its balance."""
    entry = F.struct("created_at", "entry_id")
    return (
        ledger_running_balance(ledger)
        .where("overdrawn")
        .groupBy("tenant_id")
        .agg(F.min_by(F.struct("entry_id", "created_at", "token_delta", "running_balance"), entry).alias("first"))
        .select("tenant_id", "first.*")
    )


def settle_reservations(headers: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Ledger entries that settle reserved statements; the first outcome of a statement counts.

    Success consumes the reservation and moves nothing; failure returns its pages.
    """
    first = outcomes.groupBy(*STATEMENT_KEYS).agg(
        F.min_by(F.struct("succeeded", "finished_at", "source"), F.struct("finished_at", "outcome_id")).alias("o")
    )
    reserved = headers.where(
        (F.lower(stripped("reservation_status")) == "reserved") & (stripped("reservation_entry_id") != "")
    )
    done = F.col("o.succeeded")
    return reserved.join(first, STATEMENT_KEYS).select(
        "tenant_id",
        F.concat(F.when(done, "consume#").otherwise("release#"), F.col("statement_id")).alias("entry_id"),
        F.when(done, CONSUME).otherwise(RELEASE).alias("entry_type"),
        F.when(done, 0).otherwise(F.col("pdf_page_count")).cast("bigint").alias("token_delta"),
        F.col("o.finished_at").alias("created_at"),
        F.col("o.source").alias("source"),
        "statement_id",
        F.col("reservation_entry_id").alias("settles_entry_id"),
        F.when(done, "consumed").otherwise("released").alias("next_status"),
    )


def upload_preflight(uploads: DataFrame, balances: DataFrame) -> DataFrame:
    """Pages and tokens of each tenant's batch, and whether it can be submitted.

    ``uploads`` has ``page_count`` and ``file_error``; a tenant without a balance has 0 tokens.
    """
    batches = uploads.groupBy("tenant_id").agg(
        F.sum(F.coalesce("page_count", F.lit(0))).cast("bigint").alias("total_pages"),
        F.bool_or(F.col("file_error").isNotNull()).alias("has_errors"),
    )
    joined = batches.join(balances.select("tenant_id", "token_balance"), "tenant_id", "left").withColumn(
        "available_tokens", F.coalesce("token_balance", F.lit(0)).cast("bigint")
    )
    enough = F.col("total_pages") <= F.col("available_tokens")
    return joined.select(
        "tenant_id",
        "total_pages",
        "available_tokens",
        F.greatest(F.col("total_pages") - F.col("available_tokens"), F.lit(0)).cast("bigint").alias("shortfall"),
        enough.alias("is_sufficient"),
        (enough & ~F.col("has_errors")).alias("can_submit"),
    )


def resolve_contacts(contacts: DataFrame) -> DataFrame:
    """Lookup of active contacts by name; of contacts that share a name the last in list order counts."""
    active = contacts.where(F.upper(stripped("contact_status")) == "ACTIVE")
    return active.groupBy("tenant_id", "name").agg(F.max_by("contact_id", "load_seq").alias("contact_id"))


def resolve_tier(lines: DataFrame, price_tiers: DataFrame, by: str = "invoice_id") -> DataFrame:
    """Tier of each paid invoice from its lines.

    ``lines`` have (pos, price_id, amount, proration); ``price_tiers`` maps price ids to tiers and is
    broadcast by Spark only while its size allows. Lines that credit a proration only count when no other line has a tier.
    """
    credit = F.coalesce("proration", F.lit(False)) & (F.coalesce("amount", F.lit(0)) < 0)
    known = lines.join(price_tiers.select("price_id", "tier_id"), "price_id")
    return known.groupBy(by).agg(F.min_by("tier_id", F.struct(credit.alias("credit"), F.col("pos"))).alias("tier_id"))


def subscription_credits(paid: DataFrame) -> DataFrame:
    """Tokens each paid invoice credits: the tier's allocation less what its period already had.

    ``paid`` has (tenant_id, invoice_id, tier_id, period_end, paid_at); an invoice counts once. The
    credited amount is kept per (tenant, period), so an update that announces the next period
    early does not swallow the renewal.
    """
    others = [c for c in paid.columns if c not in ("tenant_id", "invoice_id")]
    once = paid.groupBy("tenant_id", "invoice_id").agg(F.min_by(F.struct(*others), "paid_at").alias("p")).select(
        "tenant_id", "invoice_id", "p.*"
    )
    tiers = tier_table(paid.sparkSession).select("tier_id", "tokens_per_month")
    period = Window.partitionBy("tenant_id", "period_end").orderBy("paid_at", "invoice_id")
    credited = F.coalesce(F.max("tokens_per_month").over(period.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        once.join(F.broadcast(tiers), "tier_id")
        .withColumn("already_credited", credited)
        .withColumn("tokens_credited", F.greatest(F.col("tokens_per_month") - F.col("already_credited"), F.lit(0)))
        .withColumn("entry_id", F.concat(F.lit("subscription#"), "invoice_id"))
        .drop("tokens_per_month")
    )


def subscription_state(events: DataFrame) -> DataFrame:
    """Current subscription of each tenant: the latest update, unless it was deleted since."""
    latest = events.groupBy("tenant_id").agg(
        F.max_by(F.struct("event_type", "tier_id", "status", "period_end"), F.struct("received_at", "event_id")).alias("e")
    )
    return latest.where(F.col("e.event_type") != "deleted").select("tenant_id", "e.tier_id", "e.status", "e.period_end")


def dedupe_events(events: DataFrame, key: str = "event_id", order: str = "received_at") -> DataFrame:
    """The first delivery of each event."""
    others = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("e")).select(key, "e.*")


def checkout_credits(sessions: DataFrame) -> DataFrame:
    """Ledger entries of paid checkout sessions, once per session, with the effective price."""
    once = dedupe_events(sessions, "session_id", "completed_at")
    return price_purchases(once).select(
        "tenant_id",
        F.concat(F.lit("purchase#"), "session_id").alias("entry_id"),
        F.lit(ADJUSTMENT).alias("entry_type"),
        F.col("tokens").cast("bigint").alias("token_delta"),
        F.col("completed_at").alias("created_at"),
        F.lit(SOURCE_CHECKOUT).alias("source"),
        F.col("rate_pence").alias("price_per_token_pence"),
    )


def resource_progress(progress_events: DataFrame) -> DataFrame:
    """Latest status and counts of each (tenant, resource), and the tenant's last heartbeat."""
    return progress_events.groupBy("tenant_id", "resource").agg(
        F.max_by(F.struct("status", "records_fetched", "record_total"), F.struct("updated_at", "event_id")).alias("p"),
        F.max("updated_at").alias("updated_at"),
    ).select("tenant_id", "resource", "p.*", "updated_at")


def stage_lifecycle(stage_events: DataFrame) -> DataFrame:
    """Current stage of each statement; progress such as '3/10' exists only while extracting."""
    latest = stage_events.groupBy(*STATEMENT_KEYS).agg(
        F.max_by(F.struct("stage", "done_sections", "total_sections"), F.struct("at", "event_id")).alias("s")
    )
    extracting = F.col("s.stage") == "extracting"
    return latest.select(
        *STATEMENT_KEYS,
        F.col("s.stage").alias("processing_stage"),
        F.when(extracting, F.concat_ws("/", F.col("s.done_sections"), F.col("s.total_sections"))).alias("processing_progress"),
        F.when(extracting, F.col("s.total_sections")).alias("processing_total_sections"),
    )


def error_rate_alerts(log_events: DataFrame, width: str = "1 minute", threshold: int = 1) -> DataFrame:
    """Windows with at least ``threshold`` errors; windows without events raise no alert."""
    errors = log_events.where(F.col("level") == "ERROR")
    counted = errors.groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("errors"))
    return counted.where(F.col("errors") >= threshold).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "errors"
    )


def reservation_open(column: Column | str = "reservation_status") -> Column:
    return F.lower(stripped(column)) == "reserved"
