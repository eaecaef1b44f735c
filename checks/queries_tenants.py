"""Tenant life cycle, clean-up, and statement stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.derive import NOW_MS, with_tables
from checks.registry import query
from tallyweave.operators import tenants
from tallyweave.schemas import RESOURCES

TEN = ("tenants_flat",)
STALE = tenants.STALE_AFTER_MS
LIVE = f"(status IN ('LOADING', 'SYNCING') AND last_heartbeat_ms IS NOT NULL AND last_heartbeat_ms + {STALE} >= {NOW_MS})"
OLD = f"(last_heartbeat_ms IS NOT NULL AND last_heartbeat_ms + {STALE} < {NOW_MS})"
FETCHED = RESOURCES[:4]


def _status(resource: str) -> str:
    return f"coalesce({resource}_status, 'pending')"


def _percent(r: str) -> str:
    # Counts exist only where the resource has a progress record.
    return f"""CASE WHEN {r}_status IS NOT NULL AND {r}_fetched IS NOT NULL AND {r}_total > 0 THEN CAST(greatest(0, least(100, floor({r}_fetched / {r}_total * 100))) AS INTEGER)
      WHEN {r}_status = 'complete' THEN 100 END"""


@query(
    "tenant_progress",
    with_tables(
        TEN,
        f"""SELECT tenant_id, {LIVE} AS live, reconcile_ready_ms IS NOT NULL AS ready, {_status("per_contact_index")} AS index_status, {", ".join(f"{_status(r)} AS {r}, {_percent(r)} AS {r}_percent" for r in FETCHED)} FROM tenants_flat""",
    ),
)
def tenant_progress(t):
    out = tenants.tenant_progress(t.tenants(), NOW_MS)
    each = [
        x for i, r in enumerate(FETCHED) for x in (F.col("resources")[i]["status"].alias(r), F.col("resources")[i]["percent"].alias(f"{r}_percent"))
    ]
    return out.select(
        "tenant_id", F.col("is_live_sync").alias("live"), F.col("reconcile_ready").alias("ready"), F.col("per_contact_index_status").alias("index_status"), *each
    )


_FETCHED_DONE = " AND ".join(f"{_status(r)} = 'complete'" for r in FETCHED)
_ANY_FAILED = " OR ".join(f"{_status(r)} = 'failed'" for r in RESOURCES)
_READY = "reconcile_ready_ms IS NOT NULL"
_INDEX = _status("per_contact_index")


@query(
    "tenant_flags",
    with_tables(
        TEN,
        f"""SELECT tenant_id, NOT {LIVE} AND ({_ANY_FAILED}) AS has_failure, {_READY} AND {_INDEX} = 'complete' AND {_FETCHED_DONE} AS all_complete, NOT ({_READY}) AND {_status("contacts")} = 'complete' AS in_heavy_phase,
            {_FETCHED_DONE} AND {_INDEX} NOT IN ('complete', 'failed') AS is_finalising, {LIVE} AND status = 'SYNCING' AND {_READY} AND NOT ({_FETCHED_DONE} AND {_INDEX} NOT IN ('complete', 'failed')) AS is_incremental_syncing FROM tenants_flat""",
    ),
)
def tenant_flags(t):
    out = tenants.tenant_flags(tenants.tenant_progress(t.tenants(), NOW_MS))
    return out.select("tenant_id", "has_failure", "all_complete", "in_heavy_phase", "is_finalising", "is_incremental_syncing")


@query(
    "retry_recommended",
    with_tables(
        TEN,
        f"""SELECT tenant_id, status = 'LOAD_INCOMPLETE' OR (NOT {LIVE} AND ({" OR ".join(f"coalesce({r}_status, '') = 'failed' OR (coalesce({r}_status, '') = 'in_progress' AND {OLD})" for r in RESOURCES)})) AS retry_recommended FROM tenants_flat""",
    ),
)
def retry_recommended(t):
    return tenants.retry_recommended(t.tenants(), NOW_MS).select("tenant_id", "retry_recommended")


@query(
    "retry_resources",
    with_tables(TEN, "SELECT tenant_id, concat_ws(',', " + ", ".join(f"CASE WHEN {_status(r)} <> 'complete' THEN '{r}' END" for r in RESOURCES) + ") AS resources FROM tenants_flat"),
)
def retry_resources(t):
    return tenants.retry_resources(t.tenants()).select("tenant_id", F.array_join("retry_resources", ",").alias("resources"))


@query(
    "acquirable_tenants",
    with_tables(
        TEN,
        f"SELECT tenant_id, status IN ('FREE', 'LOAD_INCOMPLETE') OR (status IN ('LOADING', 'SYNCING') AND (last_heartbeat_ms IS NULL OR last_heartbeat_ms < {NOW_MS - STALE})) AS acquirable FROM tenants_flat",
    ),
)
def acquirable_tenants(t):
    return tenants.acquirable(t.tenants(), NOW_MS).select("tenant_id", "acquirable")


@query(
    "stale_syncs",
    with_tables(TEN, f"SELECT tenant_id FROM tenants_flat WHERE status IN ('LOADING', 'SYNCING') AND (last_heartbeat_ms IS NULL OR last_heartbeat_ms < {NOW_MS - STALE})"),
)
def stale_syncs(t):
    return tenants.stale_syncs(t.tenants(), NOW_MS).select("tenant_id")


@query(
    "sync_outcomes",
    with_tables(
        TEN,
        f"""SELECT tenant_id, CASE WHEN ok OR (op = 'SYNCING' AND {_READY}) THEN 'FREE' ELSE 'LOAD_INCOMPLETE' END AS next_status,
            CASE WHEN ok THEN {NOW_MS} - k WHEN op = 'SYNCING' AND {_READY} THEN NULL ELSE last_sync_ms END AS last_sync_ms, CASE WHEN ok AND NOT ({_READY}) THEN {NOW_MS} ELSE reconcile_ready_ms END AS reconcile_ready_ms
            FROM (SELECT *, k % 4 <> 0 AND k % 6 <> 1 AS ok, CASE WHEN k % 2 = 0 THEN 'SYNCING' ELSE 'LOADING' END AS op FROM tenants_flat) q""",
    ),
)
def sync_outcomes(t):
    runs = t.derive("tenants_flat").select(
        "tenant_id",
        F.when(F.col("k") % 2 == 0, "SYNCING").otherwise("LOADING").alias("operation"),
        (F.lit(NOW_MS) - F.col("k")).alias("started_ms"),
        (F.col("k") % 4 != 0).alias("contacts_ok"),
        (F.col("k") % 6 != 1).alias("invoices_ok"),
        *[F.lit(None).cast("boolean").alias(f"{r}_ok") for r in RESOURCES[2:]],
    )
    return tenants.sync_outcome(t.tenants(), runs, NOW_MS).select("tenant_id", "next_status", "last_sync_ms", "reconcile_ready_ms")


@query(
    "load_required",
    with_tables(
        TEN,
        """SELECT c.tenant_id, load AS load_required, CASE WHEN load THEN 'LOADING' ELSE status END AS next_status, CASE WHEN known THEN 0 ELSE 5 END AS welcome_tokens, erase AS erasure_cancelled FROM (
           SELECT tenant_id, status, k % 10 <> 0 AS known, (k % 10 = 0) OR status IN ('ERASED', 'LOAD_INCOMPLETE') OR (status = 'FREE' AND k % 4 = 0) AS load, k % 10 <> 0 AND erase_at_ms IS NOT NULL AS erase FROM tenants_flat) c""",
    ),
)
def load_required(t):
    everyone = t.tenants()
    out = tenants.load_required(everyone, everyone.where("k % 10 <> 0"), everyone.where("k % 4 <> 0"))
    return out.select("tenant_id", "load_required", "next_status", "welcome_tokens", "erasure_cancelled")


@query(
    "erasure_transitions",
    with_tables(
        TEN,
        f"""SELECT tenant_id, CASE WHEN status = 'LOADING' THEN 'LOAD_INCOMPLETE' WHEN status = 'SYNCING' AND {_READY} THEN 'FREE' WHEN status = 'SYNCING' THEN 'LOAD_INCOMPLETE' ELSE status END AS next_status, {NOW_MS} + 14 * 86400000 AS erase_at_ms FROM tenants_flat""",
    ),
)
def erasure_transitions(t):
    return tenants.erasure_transition(t.tenants(), 14, NOW_MS).select("tenant_id", "next_status", "erase_at_ms")


_DUE = f"erase_at_ms <= {NOW_MS}"


@query(
    "swept_tenants",
    with_tables(
        TEN,
        f"""SELECT tenant_id, CASE WHEN gone THEN 'ERASED' ELSE status END AS status, CASE WHEN NOT gone THEN erase_at_ms END AS erase_at_ms, CASE WHEN NOT gone THEN last_sync_ms END AS last_sync_ms, (NOT gone AND contacts_status IS NOT NULL) AS has_contacts
            FROM (SELECT *, coalesce({_DUE}, false) AND status NOT IN ('LOADING', 'SYNCING') AS gone FROM tenants_flat) q""",
    ),
)
def swept_tenants(t):
    swept, _ = tenants.erasure_sweep(t.tenants(), {}, NOW_MS)
    return swept.select("tenant_id", "status", "erase_at_ms", "last_sync_ms", F.col("contacts").isNotNull().alias("has_contacts"))


@query(
    "rows_after_sweep",
    with_tables(
        ("tenants_flat", "ledger_docs"),
        f"""SELECT doc_id FROM ledger_docs WHERE replace(contact_id, 'C', 'U') NOT IN (SELECT tenant_id FROM tenants_flat WHERE {_DUE} AND status NOT IN ('LOADING', 'SYNCING'))""",
    ),
)
def rows_after_sweep(t):
    docs = t.derive("ledger_docs").withColumn("tenant_id", F.replace("contact_id", F.lit("C"), F.lit("U")))
    _, kept = tenants.erasure_sweep(t.tenants(), {"docs": docs}, NOW_MS)
    return kept["docs"].select("doc_id")


@query(
    "erasure_counts",
    with_tables(
        TEN,
        f"SELECT count(CASE WHEN status NOT IN ('LOADING', 'SYNCING') THEN 1 END) AS erased, count(CASE WHEN status IN ('LOADING', 'SYNCING') THEN 1 END) AS skipped FROM tenants_flat WHERE {_DUE}",
    ),
)
def erasure_counts(t):
    return tenants.erasure_counts(t.tenants(), NOW_MS)


@query(
    "backfilled_ready_marks",
    with_tables(
        TEN,
        f"""SELECT tenant_id, last_sync_ms AS reconcile_ready_ms, coalesce(last_full_load_ms, last_sync_ms) AS last_full_load_ms, coalesce(invoices_status, 'complete') AS invoices, coalesce(per_contact_index_status, 'complete') AS per_contact_index
            FROM tenants_flat WHERE status = 'FREE' AND last_sync_ms IS NOT NULL AND reconcile_ready_ms IS NULL""",
    ),
)
def backfilled_ready_marks(t):
    out = tenants.backfill_reconcile_ready(t.tenants())
    return out.select(
        "tenant_id", "reconcile_ready_ms", "last_full_load_ms", F.col("invoices.status").alias("invoices"), F.col("per_contact_index.status").alias("per_contact_index")
    )


@query(
    "backfilled_stages",
    with_tables(
        ("headers",),
        """SELECT action, new_stage, count(*) AS statements FROM (SELECT CASE WHEN processing_stage IS NOT NULL THEN 'skip-has-stage' WHEN reservation_status IN ('consumed', 'released') THEN 'update' ELSE 'skip-reserved' END AS action,
           CASE WHEN processing_stage IS NULL AND reservation_status = 'consumed' THEN 'complete' WHEN processing_stage IS NULL AND reservation_status = 'released' THEN 'failed' END AS new_stage FROM headers WHERE record_type = 'statement') q GROUP BY 1, 2""",
    ),
)
def backfilled_stages(t):
    return tenants.backfill_processing_stage(t.headers()).groupBy("action", "new_stage").agg(F.count("*").alias("statements"))


@query(
    "tenant_states",
    with_tables(
        TEN,
        """SELECT DISTINCT concat('U', CAST(l_orderkey AS VARCHAR)) AS tenant_id, coalesce(t.status, 'FREE') AS status FROM lineitem LEFT JOIN tenants_flat t ON t.k = l_orderkey""",
    ),
)
def tenant_states(t):
    requested = t.base("lineitem").select(F.concat(F.lit("U"), F.col("l_orderkey").cast("string")).alias("tenant_id"))
    lower_case = t.tenants().withColumn("status", F.concat(F.lit(" "), F.lower("status")))
    return tenants.tenant_status_or_default(lower_case, requested)


@query(
    "restarted_progress",
    with_tables(TEN, "SELECT tenant_id, 'pending' AS invoices, payments_status AS payments FROM tenants_flat"),
)
def restarted_progress(t):
    out = tenants.start_of_run(t.tenants(), ("contacts", "invoices"))
    return out.select("tenant_id", F.col("invoices.status").alias("invoices"), F.col("payments.status").alias("payments"))


@query(
    "repaired_stages",
    with_tables(
        ("headers", "statement_files"),
        """SELECT h.statement_id, CASE WHEN f.statement_id IS NOT NULL THEN 'ready' WHEN lower(reservation_status) = 'released' THEN 'failed' ELSE 'processing' END AS shown_stage,
           CASE WHEN f.statement_id IS NULL AND lower(reservation_status) = 'released' THEN 'failed' ELSE processing_stage END AS processing_stage,
           CASE WHEN f.statement_id IS NULL AND lower(reservation_status) = 'released' THEN NULL ELSE processing_progress END AS processing_progress FROM headers h LEFT JOIN statement_files f USING (statement_id)""",
    ),
)
def repaired_stages(t):
    return tenants.stage_repair(t.headers(), t.derive("statement_files")).select("statement_id", "shown_stage", "processing_stage", "processing_progress")


@query(
    "cleared_tenants",
    with_tables(("items_flat",), "SELECT k FROM items_flat WHERE ck % 25 NOT IN (1, 7)"),
)
def cleared_tenants(t):
    doomed = t.derive("contacts").where(F.col("tenant_id").isin("T1", "T7"))
    return tenants.clear_tenants(t.derive("items_flat"), doomed).select("k")


@query(
    "after_statement_deletion",
    with_tables(
        ("items_flat", "headers"),
        "SELECT i.k FROM items_flat i JOIN headers h USING (statement_id) WHERE NOT (ck % 4 = 1 AND lower(coalesce(reservation_status, '')) <> 'reserved')",
    ),
)
def after_statement_deletion(t):
    headers = t.headers()
    return tenants.delete_statements(t.derive("items_flat"), headers, headers.where("k % 4 = 1")).select("k")
