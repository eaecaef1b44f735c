"""Rules of a tenant's life: sync progress, retries, outcomes, erasure and back-fills.

All are functions of the tenant's row and a given time; a table of tenants is one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.text import stripped
from tallyweave.operators.tokens import SOURCE_WELCOME, WELCOME_TOKENS, reservation_open
from tallyweave.schemas import RESOURCES, STATEMENT_KEYS

# Tenant states, and when a sync without heartbeat counts as crashed.
FREE, SYNCING, LOADING, INCOMPLETE, ERASED = "FREE", "SYNCING", "LOADING", "LOAD_INCOMPLETE", "ERASED"
TENANT_STATES = (FREE, SYNCING, LOADING, INCOMPLETE, ERASED)
STALE_AFTER_MS = 5 * 60 * 1000

# Days until erasure that a leaving tenant may choose.
ERASURE_DAYS = (0, 14, 365)
DAY_MS = 86_400_000

FETCHED = RESOURCES[:4]
INDEX = RESOURCES[4]


def tenant_state(column: Column | str = "status") -> Column:
    """A known state in upper case; anything else means FREE."""
    state = F.upper(stripped(column))
    return F.when(state.isin(*TENANT_STATES), state).otherwise(FREE)


def _status(resource: str) -> Column:
    given = F.col(f"{resource}.status")
    return F.when(F.coalesce(given, F.lit("")) != "", given).otherwise("pending")


def _live(now_ms: int) -> Column:
    fresh = F.col("last_heartbeat_ms") + STALE_AFTER_MS >= now_ms
    return tenant_state().isin(LOADING, SYNCING) & F.coalesce(fresh, F.lit(False))


def tenant_progress(tenants: DataFrame, now_ms: int) -> DataFrame:
    """Per resource: status, counts and percent; whether a sync is live and statements can be opened.

    Percent is unknown without a total, except that a completed resource shows 100.
    """

    def resource(name: str) -> Column:
        fetched, total = F.col(f"{name}.records_fetched"), F.col(f"{name}.record_total")
        percent = F.least(F.greatest(F.floor(fetched / total * 100), F.lit(0)), F.lit(100))
        return F.struct(
            F.lit(name).alias("resource"),
            _status(name).alias("status"),
            fetched.alias("records_fetched"),
            total.alias("record_total"),
            F.when(fetched.isNotNull() & (total > 0), percent)
            .when(_status(name) == "complete", 100)
            .cast("int")
            .alias("percent"),
        )

    return tenants.select(
        "tenant_id",
        tenant_state().alias("status"),
        F.col("reconcile_ready_ms").isNotNull().alias("reconcile_ready"),
        _live(now_ms).alias("is_live_sync"),
        "last_sync_ms",
        F.array(*[resource(r) for r in FETCHED]).alias("resources"),
        _status(INDEX).alias("per_contact_index_status"),
    )


def tenant_flags(progress: DataFrame) -> DataFrame:
    """What a tenant's progress means: failed, complete, heavy phase, finalising, incremental."""
    all_fetched = F.forall("resources", lambda r: r["status"] == "complete")
    contacts_done = F.exists("resources", lambda r: (r["resource"] == "contacts") & (r["status"] == "complete"))
    index = F.col("per_contact_index_status")
    failed = F.exists("resources", lambda r: r["status"] == "failed") | (index == "failed")
    return (
        progress.withColumn("has_failure", ~F.col("is_live_sync") & failed)
        .withColumn("all_complete", F.col("reconcile_ready") & (index == "complete") & all_fetched)
        .withColumn("in_heavy_phase", ~F.col("reconcile_ready") & contacts_done)
        .withColumn("is_finalising", all_fetched & ~index.isin("complete", "failed"))
        .withColumn(
            "is_incremental_syncing",
            F.col("is_live_sync")
            & (F.col("status") == SYNCING)
            & F.col("reconcile_ready")
            & ~F.col("has_failure")
            & ~F.col("is_finalising"),
        )
    )


def retry_recommended(tenants: DataFrame, now_ms: int) -> DataFrame:
    """Add ``retry_recommended``: incomplete, or not live with a failed or abandoned resource."""
    stale = F.coalesce(F.col("last_heartbeat_ms") + STALE_AFTER_MS < now_ms, F.lit(False))
    broken = F.lit(False)
    for name in RESOURCES:
        given = F.coalesce(F.col(f"{name}.status"), F.lit(""))
        broken = broken | (given == "failed") | ((given == "in_progress") & stale)
    return tenants.withColumn(
        "retry_recommended", (tenant_state() == INCOMPLETE) | (~_live(now_ms) & broken)
    )


def retry_resources(tenants: DataFrame) -> DataFrame:
    """Add ``retry_resources``: those missing, pending, failed or in progress."""
    wanted = F.array(*[F.when(_status(r).isin("pending", "failed", "in_progress"), r) for r in RESOURCES])
    return tenants.withColumn("retry_resources", F.filter(wanted, lambda r: r.isNotNull()))


def acquirable(tenants: DataFrame, now_ms: int) -> DataFrame:
    """Add ``acquirable``: whether a sync may start now."""
    silent = F.coalesce(F.col("last_heartbeat_ms") < now_ms - STALE_AFTER_MS, F.lit(True))
    state = F.col("status")
    return tenants.withColumn(
        "acquirable",
        state.isNull() | state.isin(FREE, INCOMPLETE) | (state.isin(LOADING, SYNCING) & silent),
    )


def stale_syncs(tenants: DataFrame, now_ms: int) -> DataFrame:
    """Tenants whose sync stopped sending heartbeats."""
    running = F.col("status").isin(LOADING, SYNCING)
    return acquirable(tenants, now_ms).where(running & F.col("acquirable")).drop("acquirable")


def sync_outcome(tenants: DataFrame, runs: DataFrame, now_ms: int) -> DataFrame:
    """Tenant rows after their runs.

    ``runs`` has one row per tenant: operation ('LOADING' or 'SYNCING'), started_ms, and one
    boolean per resource (null where it was skipped as done). A failed run of a tenant that was
    ready before leaves it FREE without a sync time; otherwise it is LOAD_INCOMPLETE.
    """
    ok = F.lit(True)
    for name in RESOURCES:
        ok = ok & F.coalesce(f"{name}_ok", F.lit(True))
    joined = tenants.join(runs, "tenant_id")
    was_ready = F.col("reconcile_ready_ms").isNotNull()
    excused = ~F.col("all_ok") & (F.col("operation") == SYNCING) & was_ready
    return joined.withColumn("all_ok", ok).select(
        "tenant_id",
        F.when(F.col("all_ok") | excused, FREE).otherwise(INCOMPLETE).alias("next_status"),
        F.when(F.col("all_ok"), F.col("started_ms"))
        .when(excused, F.lit(None))
        .otherwise(F.col("last_sync_ms"))
        .cast("bigint")
        .alias("last_sync_ms"),
        F.when(F.col("all_ok") & ~was_ready, now_ms).otherwise(F.col("reconcile_ready_ms")).cast("bigint").alias("reconcile_ready_ms"),
        F.when(F.col("all_ok") & ~was_ready, now_ms).otherwise(F.col("last_full_load_ms")).cast("bigint").alias("last_full_load_ms"),
    )


def load_required(connecting: DataFrame, tenants: DataFrame, tenants_with_data: DataFrame) -> DataFrame:
    """What happens to tenants that connect: full load or not, welcome tokens, erasure called off."""
    known = tenants.select(
        "tenant_id", tenant_state().alias("state"), "erase_at_ms", F.lit(True).alias("known")
    )
    stored = tenants_with_data.select("tenant_id").distinct().withColumn("has_data", F.lit(True))
    joined = connecting.select("tenant_id").distinct().join(known, "tenant_id", "left").join(stored, "tenant_id", "left")
    is_new = F.col("known").isNull()
    empty = (F.col("state") == FREE) & F.col("has_data").isNull()
    load = is_new | F.col("state").isin(ERASED, INCOMPLETE) | empty
    return joined.select(
        "tenant_id",
        load.alias("load_required"),
        F.when(load, LOADING).otherwise(F.col("state")).alias("next_status"),
        F.when(is_new, WELCOME_TOKENS).otherwise(0).cast("bigint").alias("welcome_tokens"),
        F.when(is_new, SOURCE_WELCOME).alias("grant_source"),
        F.col("erase_at_ms").isNotNull().alias("erasure_cancelled"),
    )


def erasure_transition(tenants: DataFrame, days: int, now_ms: int) -> DataFrame:
    """Tenant rows after they leave: a safe resting state and the time of erasure."""
    if days not in ERASURE_DAYS:
        raise ValueError(f"erasure days must be one of {ERASURE_DAYS}")
    state = tenant_state()
    return tenants.withColumn(
        "next_status",
        F.when(state == LOADING, INCOMPLETE)
        .when((state == SYNCING) & F.col("reconcile_ready_ms").isNotNull(), FREE)
        .when(state == SYNCING, INCOMPLETE)
        .otherwise(state),
    ).withColumn("erase_at_ms", F.lit(now_ms + days * DAY_MS).cast("bigint"))


def due_for_erasure(tenants: DataFrame, now_ms: int) -> DataFrame:
    return tenants.where(F.col("erase_at_ms") <= now_ms)


def erasure_sweep(
    tenants: DataFrame, tables: dict[str, DataFrame], now_ms: int
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Tenant table and data tables after the erasure of all tenants that are due.

    A tenant in the middle of a sync is passed over.
    """
    due = F.coalesce(F.col("erase_at_ms") <= now_ms, F.lit(False))
    erased = due & ~F.coalesce(F.col("status").isin(LOADING, SYNCING), F.lit(False))
    cleared = tenants.withColumn("gone", erased)
    for column in tenants.columns:
        if column == "status":
            cleared = cleared.withColumn(column, F.when(F.col("gone"), ERASED).otherwise(F.col(column)))
        elif column.endswith("_ms") or column in RESOURCES:
            cleared = cleared.withColumn(column, F.when(~F.col("gone"), F.col(column)))
    ids = cleared.where("gone").select("tenant_id")
    kept = {name: table.join(ids, "tenant_id", "left_anti") for name, table in tables.items()}
    return cleared.drop("gone"), kept


def erasure_counts(tenants: DataFrame, now_ms: int) -> DataFrame:
    """How many tenants a sweep erases and passes over."""
    busy = F.coalesce(F.col("status").isin(LOADING, SYNCING), F.lit(False))
    return due_for_erasure(tenants, now_ms).agg(F.count_if(~busy).alias("erased"), F.count_if(busy).alias("skipped"))


def backfill_reconcile_ready(tenants: DataFrame) -> DataFrame:
    """Rows of idle tenants that synced before the ready mark existed get it, and missing progress.

    Nothing already there is overwritten.
    """
    needed = (
        (F.upper(stripped("status")) == FREE) & F.col("last_sync_ms").isNotNull() & F.col("reconcile_ready_ms").isNull()
    )
    out = tenants.where(needed)
    for name in RESOURCES:
        done = F.struct(
            F.lit("complete").alias("status"),
            F.lit(None).cast("bigint").alias("records_fetched"),
            F.lit(None).cast("bigint").alias("record_total"),
            F.col("last_sync_ms").alias("updated_at"),
        )
        out = out.withColumn(name, F.coalesce(F.col(name), done))
    return out.withColumn("reconcile_ready_ms", F.col("last_sync_ms")).withColumn(
        "last_full_load_ms", F.coalesce("last_full_load_ms", "last_sync_ms")
    )


def backfill_processing_stage(headers: DataFrame) -> DataFrame:
    """Add ``action`` and ``new_stage`` for statement headers without a stage."""
    status = F.lower(stripped("reservation_status"))
    has_stage = F.coalesce("processing_stage", F.lit("")) != ""
    stage = F.when(status == "consumed", "complete").when(status == "released", "failed")
    return headers.where(F.col("record_type") == "statement").withColumn(
        "action", F.when(has_stage, "skip-has-stage").when(stage.isNull(), "skip-reserved").otherwise("update")
    ).withColumn("new_stage", F.when(F.col("action") == "update", stage))


def tenant_status_or_default(tenants: DataFrame, requested: DataFrame) -> DataFrame:
    """State of each requested tenant; unknown tenants and states are FREE."""
    wanted = requested.select("tenant_id").where(stripped("tenant_id") != "").distinct()
    return wanted.join(tenants.select("tenant_id", "status"), "tenant_id", "left").select(
        "tenant_id", tenant_state().alias("status")
    )


def start_of_run(tenants: DataFrame, resources: tuple[str, ...] = RESOURCES) -> DataFrame:
    """Progress of the given resources set back to pending; the others stay."""
    pending = F.struct(
        F.lit("pending").alias("status"),
        F.lit(None).cast("bigint").alias("records_fetched"),
        F.lit(None).cast("bigint").alias("record_total"),
        F.lit(None).cast("bigint").alias("updated_at"),
    )
    out = tenants
    for name in resources:
        out = out.withColumn(name, pending)
    return out


def stage_repair(headers: DataFrame, statement_files: DataFrame) -> DataFrame:
    """Add ``shown_stage``: headers without a statement file are processing, or failed once released.

    A failed one loses its progress.
    """
    present = statement_files.select(*STATEMENT_KEYS).distinct().withColumn("present", F.lit(True))
    joined = headers.join(present, STATEMENT_KEYS, "left")
    failed = F.col("present").isNull() & (F.lower(stripped("reservation_status")) == "released")
    return (
        joined.withColumn(
            "shown_stage",
            F.when(failed, "failed").when(F.col("present").isNull(), "processing").otherwise("ready"),
        )
        .withColumn("processing_stage", F.when(failed, "failed").otherwise(F.col("processing_stage")))
        .withColumn("processing_progress", F.when(~failed, F.col("processing_progress")))
        .withColumn("processing_total_sections", F.when(~failed, F.col("processing_total_sections")))
        .drop("present")
    )


def clear_tenants(table: DataFrame, tenants: DataFrame) -> DataFrame:
    """A table without the rows of the given tenants."""
    return table.join(tenants.select("tenant_id").distinct(), "tenant_id", "left_anti")


def delete_statements(table: DataFrame, headers: DataFrame, statements: DataFrame) -> DataFrame:
    """A table without the rows of the given statements, except those still reserved."""
    held = headers.where(reservation_open()).select(*STATEMENT_KEYS)
    doomed = statements.select(*STATEMENT_KEYS).distinct().join(held, STATEMENT_KEYS, "left_anti")
    return table.join(doomed, STATEMENT_KEYS, "left_anti")
