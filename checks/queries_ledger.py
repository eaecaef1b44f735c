"""Ledger tables, the token ledger, billing events and statement lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.derive import with_tables
from checks.registry import iso, money, money_sql, query
from tallyweave.operators import ledger, listing, tokens
from tallyweave.sources import snapshots


# --- ledger tables -----------------------------------------------------------------------------


@query(
    "upserted_ledger",
    with_tables(
        ("ledger_docs",),
        f"""SELECT doc_id, {money_sql("CASE WHEN load_seq % 5 = 0 THEN total + 10 ELSE total END")} AS total FROM ledger_docs WHERE load_seq % 5 <> 1 AND load_seq % 7 <> 0
            UNION ALL SELECT NULL, {money_sql("total")} FROM ledger_docs WHERE load_seq % 5 <> 1 AND load_seq % 7 = 0
            UNION ALL SELECT NULL, {money_sql("total + 10")} FROM ledger_docs WHERE load_seq % 5 = 0 AND load_seq % 7 = 0""",
    ),
)
def upserted_ledger(t):
    docs = t.derive("ledger_docs").withColumn("doc_id", F.when(F.col("load_seq") % 7 != 0, F.col("doc_id")))
    existing = docs.where("load_seq % 5 <> 1")
    delta = docs.where("load_seq % 5 = 0").withColumn("total", (F.col("total") + 10).cast("decimal(20,4)"))
    twice = existing.unionByName(existing.where("doc_id is not null").withColumn("load_seq", F.col("load_seq") - 1_000_000))
    return ledger.upsert_ledger(twice, delta, "doc_id").select("doc_id", money("total").alias("total"))


@query(
    "deduplicated_pages",
    with_tables(
        ("ledger_docs",),
        """SELECT 'last' AS keep, tenant_id, contact_id, max(load_seq) AS load_seq FROM ledger_docs GROUP BY 2, 3 UNION ALL
           SELECT 'first', tenant_id, contact_id, min(load_seq) FROM ledger_docs GROUP BY 2, 3""",
    ),
)
def deduplicated_pages(t):
    rows = t.derive("ledger_docs").select("tenant_id", "contact_id", "load_seq", "number")
    last = ledger.dedupe_pages(rows, "contact_id", "last").withColumn("keep", F.lit("last"))
    first = ledger.dedupe_pages(rows, "contact_id", "first").withColumn("keep", F.lit("first"))
    return last.unionByName(first).select("keep", "tenant_id", "contact_id", "load_seq")


@query(
    "contact_bundles",
    with_tables(
        ("ledger_docs", "payments"),
        """SELECT contact_id, count(CASE WHEN kind = 'invoice' THEN 1 END) AS invoices, count(CASE WHEN kind = 'credit_note' THEN 1 END) AS credit_notes, count(CASE WHEN kind = 'payment' THEN 1 END) AS payments
           FROM (SELECT contact_id, doc_kind AS kind FROM ledger_docs UNION ALL SELECT contact_id, 'payment' FROM payments) q GROUP BY contact_id""",
    ),
)
def contact_bundles(t):
    bundles = ledger.bundle_by_contact(t.derive("ledger_docs"), t.derive("payments"), bundle_size=6)
    return bundles.groupBy("contact_id").agg(*[F.sum(F.size(k)).cast("bigint").alias(k) for k in ("invoices", "credit_notes", "payments")])


@query(
    "duplicate_ids",
    with_tables(("ledger_docs",), "SELECT contact_id AS doc_id, count(*) AS occurrences FROM ledger_docs GROUP BY 1 HAVING count(*) > 1"),
)
def duplicate_ids(t):
    return ledger.duplicate_ids(t.derive("ledger_docs").withColumn("doc_id", F.col("contact_id")))


@query(
    "id_summary",
    with_tables(
        ("ledger_docs",),
        """SELECT count(*) AS total, count(*) - count(id) AS missing, count(DISTINCT id) AS unique_ids, (SELECT count(*) FROM (SELECT contact_id FROM ledger_docs WHERE load_seq % 9 <> 0 GROUP BY 1 HAVING count(*) > 1) r) AS repeated_ids
           FROM (SELECT CASE WHEN load_seq % 9 <> 0 THEN contact_id END AS id FROM ledger_docs) q""",
    ),
)
def id_summary(t):
    docs = t.derive("ledger_docs").withColumn("doc_id", F.when(F.col("load_seq") % 9 != 0, F.col("contact_id")))
    return ledger.id_summary(docs)


def _ordered_sql(kind: str, table: str, key: str, order: str) -> str:
    return f"SELECT '{kind}' AS kind, {key} AS id, CAST(row_number() OVER (PARTITION BY tenant_id ORDER BY {order}) AS BIGINT) AS place FROM {table}"


@query(
    "ordered_ledger",
    with_tables(
        ("ledger_docs", "payments", "contacts"),
        " UNION ALL ".join([
            _ordered_sql("invoices", "ledger_docs", "doc_id", "lower(number)"), _ordered_sql("credit_notes", "ledger_docs", "doc_id", "doc_id"),
            _ordered_sql("payments", "payments", "payment_id", "payment_id"), _ordered_sql("contacts", "contacts", "contact_id", "lower(name || contact_id)"),
        ]),
    ),
)
def ordered_ledger(t):
    """Every kind in its order, as places within the tenant."""
    docs, contacts = t.derive("ledger_docs"), t.derive("contacts").withColumn("name", F.concat("name", "contact_id"))
    out = None
    for kind, rows, key in (("invoices", docs, "doc_id"), ("credit_notes", docs, "doc_id"), ("payments", t.derive("payments"), "payment_id"), ("contacts", contacts, "contact_id")):
        ordered = ledger.order_ledger(rows, kind).select("tenant_id", F.col(key).alias("id"), F.monotonically_increasing_id().alias("at"))
        place = F.row_number().over(Window.partitionBy("tenant_id").orderBy("at")).cast("bigint")
        ordered = ordered.select(F.lit(kind).alias("kind"), "id", place.alias("place"))
        out = ordered if out is None else out.unionByName(ordered)
    return out


@query(
    "snapshot_manifest",
    with_tables(
        ("headers",),
        """SELECT tenant_id, statement_id, contact_id, CAST(uploaded_at AS DATE)::VARCHAR AS uploaded FROM headers WHERE tenant_id IN ('T1', 'T2', 'T3') AND coalesce(record_type, 'statement') = 'statement'""",
    ),
)
def snapshot_manifest(t):
    wanted = t.derive("contacts").where(F.col("tenant_id").isin("T1", "T2", "T3")).select("tenant_id").distinct()
    manifest = snapshots.snapshot_manifest(t.headers(), wanted)
    return manifest.select("tenant_id", "statement_id", "contact_id", iso(F.col("uploaded_at").cast("date")).alias("uploaded"))


@query(
    "restored_statements",
    with_tables(
        ("headers", "statement_files"),
        """SELECT statement_id AS old_statement_id, (f.statement_id IS NOT NULL AND k % 10 <> 0) AS restored, CASE WHEN f.statement_id IS NULL OR k % 10 = 0 THEN 'missing-file-or-contact' END AS skip_reason
           FROM headers h LEFT JOIN statement_files f USING (statement_id) WHERE coalesce(record_type, 'statement') = 'statement'""",
    ),
)
def restored_statements(t):
    headers = t.headers().withColumn("contact_id", F.when(F.col("k") % 10 != 0, F.col("contact_id")).otherwise(" "))
    manifest = snapshots.snapshot_manifest(headers, headers.select("tenant_id").distinct())
    return snapshots.restore_plan(manifest, t.derive("statement_files"), "r1").select("old_statement_id", "restored", "skip_reason")


# --- token ledger ------------------------------------------------------------------------------


@query(
    "token_balances",
    with_tables(
        ("token_ledger",),
        """SELECT tenant_id, CAST(sum(token_delta) AS BIGINT) AS token_balance, arg_max(entry_id, created_at) FILTER (entry_type <> 'CONSUME') AS last_entry_id,
           arg_max(source, created_at) FILTER (entry_type <> 'CONSUME') AS last_mutation_source FROM token_ledger GROUP BY tenant_id""",
    ),
)
def token_balances(t):
    return tokens.token_balances(t.token_ledger()).select("tenant_id", "token_balance", "last_entry_id", "last_mutation_source")


@query(
    "balance_audit",
    with_tables(
        ("token_ledger",),
        """SELECT tenant_id, CAST(sum(token_delta) + 1 AS BIGINT) AS snapshot_balance, CAST(sum(token_delta) AS BIGINT) AS ledger_balance FROM token_ledger GROUP BY tenant_id HAVING max(event_id) % 4 = 0""",
    ),
)
def balance_audit(t):
    entries = t.token_ledger()
    stored = entries.groupBy("tenant_id").agg(
        (F.sum("token_delta") + F.when(F.max("event_id") % 4 == 0, 1).otherwise(0)).cast("bigint").alias("token_balance")
    )
    return tokens.balance_audit(stored, entries)


@query(
    "tokens_by_source",
    with_tables(
        ("token_ledger",),
        "SELECT tenant_id, source, CAST(sum(token_delta) AS BIGINT) AS tokens, count(*) AS entries FROM token_ledger WHERE token_delta > 0 GROUP BY ROLLUP (tenant_id, source)",
    ),
)
def tokens_by_source(t):
    return tokens.tokens_credited_by_source(t.token_ledger())


_RUNNING = "SELECT *, CAST(sum(token_delta) OVER (PARTITION BY tenant_id ORDER BY created_at, entry_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_balance FROM token_ledger"


@query(
    "running_balances",
    with_tables(("token_ledger",), f"SELECT entry_id, running_balance, running_balance < 0 AND token_delta < 0 AS overdrawn FROM ({_RUNNING}) r"),
)
def running_balances(t):
    return tokens.ledger_running_balance(t.token_ledger(), rows_per_slice=500).select("entry_id", "running_balance", "overdrawn")


@query(
    "first_overdrafts",
    with_tables(
        ("token_ledger",),
        f"SELECT tenant_id, arg_min(entry_id, created_at) AS entry_id, arg_min(running_balance, created_at) AS running_balance FROM ({_RUNNING}) r WHERE running_balance < 0 AND token_delta < 0 GROUP BY tenant_id",
    ),
)
def first_overdrafts(t):
    return tokens.first_overdraft(t.token_ledger()).select("tenant_id", "entry_id", "running_balance")


def _outcomes(t):
    """Two outcomes for most statements, the second one the opposite of the first."""
    flat = t.derive("statements_flat").where("k % 9 <> 0")
    first = flat.select("tenant_id", "statement_id", (F.col("k") % 2 == 0).alias("succeeded"), F.timestamp_seconds(F.col("k") * 60).alias("finished_at"), F.concat(F.lit("a"), "statement_id").alias("outcome_id"), F.lit("worker").alias("source"))
    second = first.withColumns({"succeeded": ~F.col("succeeded"), "finished_at": F.col("finished_at") + F.expr("interval 1 hour"), "outcome_id": F.concat(F.lit("b"), "statement_id")})
    return first.unionByName(second)


@query(
    "settled_reservations",
    with_tables(
        ("headers",),
        """SELECT concat(CASE WHEN k % 2 = 0 THEN 'consume#' ELSE 'release#' END, statement_id) AS entry_id, CASE WHEN k % 2 = 0 THEN 'CONSUME' ELSE 'RELEASE' END AS entry_type,
           CAST(CASE WHEN k % 2 = 0 THEN 0 ELSE pdf_page_count END AS BIGINT) AS token_delta, reservation_entry_id AS settles_entry_id, CASE WHEN k % 2 = 0 THEN 'consumed' ELSE 'released' END AS next_status
           FROM headers WHERE lower(reservation_status) = 'reserved' AND k % 9 <> 0""",
    ),
)
def settled_reservations(t):
    return tokens.settle_reservations(t.headers(), _outcomes(t)).select("entry_id", "entry_type", "token_delta", "settles_entry_id", "next_status")


@query(
    "upload_preflight",
    with_tables(
        ("uploads",),
        """SELECT tenant_id, total_pages, available_tokens, greatest(total_pages - available_tokens, 0) AS shortfall, total_pages <= available_tokens AS is_sufficient, total_pages <= available_tokens AND errors = 0 AS can_submit
           FROM (SELECT tenant_id, CAST(sum(coalesce(page_count, 0)) AS BIGINT) AS total_pages, count(file_error) AS errors, CAST(coalesce(max(b), 0) AS BIGINT) AS available_tokens
           FROM uploads LEFT JOIN (SELECT concat('T', CAST(n_nationkey AS VARCHAR)) AS tenant_id, n_nationkey * 30 AS b FROM nation WHERE n_nationkey % 5 <> 0) n USING (tenant_id) GROUP BY tenant_id) q""",
    ),
)
def upload_preflight(t):
    balances = t.base("nation").where("n_nationkey % 5 <> 0").select(
        F.concat(F.lit("T"), F.col("n_nationkey").cast("string")).alias("tenant_id"), (F.col("n_nationkey") * 30).alias("token_balance")
    )
    return tokens.upload_preflight(t.derive("uploads"), balances)


@query(
    "resolved_tiers",
    """SELECT l_orderkey AS invoice_id, arg_min(tier, CASE WHEN proration AND amount < 0 THEN 100 ELSE 0 END + l_linenumber) AS tier_id FROM (SELECT l_orderkey, l_linenumber, l_partkey % 2 = 0 AS proration, l_quantity - 25 AS amount,
       CASE l_suppkey % 5 WHEN 0 THEN 'tier_50' WHEN 1 THEN 'tier_200' WHEN 2 THEN 'tier_500' END AS tier FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice, l_partkey, l_suppkey) = 1) q WHERE tier IS NOT NULL GROUP BY l_orderkey""",
)
def resolved_tiers(t):
    # Dealt out first: a task that reads would sort all its rows to find least structs, though hardly any line repeats.
    dealt = t.base("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey", "l_quantity").repartition("l_orderkey", "l_linenumber")
    lines = dealt.groupBy("l_orderkey", "l_linenumber").agg(
        F.min(F.struct("l_extendedprice", "l_partkey", "l_suppkey", "l_quantity")).alias("x")
    )
    lines = lines.select(
        F.col("l_orderkey").alias("invoice_id"),
        F.col("l_linenumber").alias("pos"),
        F.concat(F.lit("price_"), (F.col("x.l_suppkey") % 5).cast("string")).alias("price_id"),
        (F.col("x.l_quantity") - 25).alias("amount"),
        (F.col("x.l_partkey") % 2 == 0).alias("proration"),
    )
    prices = t.spark.createDataFrame([("price_0", "tier_50"), ("price_1", "tier_200"), ("price_2", "tier_500")], "price_id string, tier_id string")
    return tokens.resolve_tier(lines, prices)


_PAID_ONCE = """SELECT tenant_id, invoice_id, arg_min(tier_id, received_at) AS tier_id, arg_min(period_end, received_at) AS period_end, min(received_at) AS paid_at FROM billing_events WHERE event_type = 'paid' GROUP BY tenant_id, invoice_id"""


@query(
    "subscription_credits",
    with_tables(
        ("billing_events",),
        f"""SELECT tenant_id, invoice_id, CAST(greatest(alloc - before, 0) AS BIGINT) AS tokens_credited, concat('subscription#', invoice_id) AS entry_id FROM (SELECT *,
            coalesce(max(alloc) OVER (PARTITION BY tenant_id, period_end ORDER BY paid_at, invoice_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM (SELECT *, CASE tier_id WHEN 'tier_50' THEN 50 WHEN 'tier_200' THEN 200 ELSE 500 END AS alloc FROM ({_PAID_ONCE}) p) a) q""",
    ),
)
def subscription_credits(t):
    paid = t.derive("billing_events").where("event_type = 'paid'").withColumnRenamed("received_at", "paid_at").drop("event_id", "event_type", "seq")
    return tokens.subscription_credits(paid).select("tenant_id", "invoice_id", "tokens_credited", "entry_id")


@query(
    "subscription_states",
    with_tables(
        ("billing_events",),
        """SELECT tenant_id, tier_id, CAST(period_end AS VARCHAR) AS period_end FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY received_at DESC, event_id DESC) AS rn FROM billing_events WHERE event_type IN ('updated', 'deleted', 'paid')) q
           WHERE rn = 1 AND event_type <> 'deleted'""",
    ),
)
def subscription_states(t):
    events = t.derive("billing_events").where("event_type <> 'other'").withColumn("status", F.lit("active"))
    return tokens.subscription_state(events).select("tenant_id", "tier_id", iso("period_end").alias("period_end"))


@query(
    "deduplicated_events",
    with_tables(("billing_events",), "SELECT invoice_id AS event_id, arg_min(tier_id, seq) AS tier_id, min(seq) AS seq FROM billing_events GROUP BY invoice_id"),
)
def deduplicated_events(t):
    events = t.derive("billing_events").drop("event_id").withColumnRenamed("invoice_id", "event_id")
    return tokens.dedupe_events(events, "event_id", "seq").select("event_id", "tier_id", "seq")


@query(
    "checkout_credits",
    with_tables(
        ("billing_events",),
        """SELECT concat('purchase#', invoice_id) AS entry_id, CAST(n AS BIGINT) AS token_delta, CAST(round_even((least(n, 499) * 10 + least(greatest(n - 499, 0), 500) * 9 + greatest(n - 999, 0) * 8) / n, 2) AS DOUBLE) AS rate
           FROM (SELECT invoice_id, min(seq) % 1500 + 10 AS n FROM billing_events WHERE event_type = 'paid' GROUP BY invoice_id) q""",
    ),
)
def checkout_credits(t):
    sessions = t.derive("billing_events").where("event_type = 'paid'").select(
        F.col("invoice_id").alias("session_id"), "tenant_id", (F.col("seq") % 1500 + 10).alias("tokens"), F.col("received_at").alias("completed_at")
    )
    return tokens.checkout_credits(sessions).select("entry_id", "token_delta", F.col("price_per_token_pence").cast("double").alias("rate"))


@query(
    "current_stages",
    """SELECT concat('S', CAST(user_id AS VARCHAR)) AS statement_id, arg_max(stage, ts) AS processing_stage, CASE WHEN arg_max(stage, ts) = 'extracting' THEN arg_max(d, ts) || '/10' END AS processing_progress FROM
       (SELECT user_id, ts, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'chunking' WHEN 'click' THEN 'extracting' WHEN 'error' THEN 'failed' ELSE 'complete' END AS stage, CAST(event_id % 10 AS VARCHAR) AS d FROM events) q GROUP BY user_id""",
)
def current_stages(t):
    stage = F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "view", "chunking").when(F.col("event_type") == "click", "extracting").when(F.col("event_type") == "error", "failed").otherwise("complete")
    events = t.base("events").select(
        F.lit("T").alias("tenant_id"), F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("statement_id"), stage.alias("stage"),
        (F.col("event_id") % 10).cast("string").alias("done_sections"), F.lit("10").alias("total_sections"), F.col("ts").alias("at"), "event_id",
    )
    return tokens.stage_lifecycle(events).select("statement_id", "processing_stage", "processing_progress")


@query(
    "resource_progress",
    """SELECT user_id AS tenant_id, event_type AS resource, arg_max(CAST(value * 10 AS BIGINT), ts) AS records_fetched, CAST(max(ts) AS DATE)::VARCHAR AS updated FROM (SELECT *, floor(value) AS v FROM events) q GROUP BY user_id, event_type""".replace("CAST(value * 10 AS BIGINT)", "CAST(v AS BIGINT)"),
)
def resource_progress(t):
    events = t.base("events").select(
        F.col("user_id").alias("tenant_id"), F.col("event_type").alias("resource"), F.lit("in_progress").alias("status"), F.floor("value").alias("records_fetched"),
        F.lit(None).cast("bigint").alias("record_total"), F.col("ts").alias("updated_at"), "event_id",
    )
    return tokens.resource_progress(events).select("tenant_id", "resource", "records_fetched", iso(F.col("updated_at").cast("date")).alias("updated"))


@query(
    "error_alerts",
    "SELECT CAST(epoch(date_trunc('minute', ts)) AS BIGINT) AS window_start, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY 1",
)
def error_alerts(t):
    logs = t.base("events").select(F.upper("event_type").alias("level"), F.col("ts").cast("timestamp").alias("ts"))
    return tokens.error_rate_alerts(logs).select(F.unix_seconds("window_start").alias("window_start"), "errors")


# --- lists -------------------------------------------------------------------------------------


@query(
    "statement_list",
    with_tables(
        ("headers",),
        """SELECT statement_id, row_number() OVER (ORDER BY CASE WHEN trim(contact_name) = '' THEN 1 ELSE 0 END, lower(trim(contact_name)) DESC, statement_id) AS place FROM headers""",
    ),
)
def statement_list(t):
    return listing.numbered(t.headers(), [*listing.list_order("contact", "desc"), "statement_id"]).select("statement_id", "place")


@query("statements_by_upload", with_tables(("headers",), "SELECT statement_id, CAST(uploaded_at AS VARCHAR)[1:10] AS uploaded FROM headers ORDER BY uploaded_at DESC NULLS LAST"))
def statements_by_upload(t):
    return listing.sort_statements(t.headers()).select("statement_id", iso(F.col("uploaded_at").cast("date")).alias("uploaded"))


@query(
    "date_range_labels",
    with_tables(
        ("headers",),
        """SELECT statement_id, CASE WHEN earliest_item_date IS NULL AND latest_item_date IS NULL THEN '—' WHEN earliest_item_date IS NULL THEN latest_item_date::VARCHAR WHEN latest_item_date IS NULL OR latest_item_date = earliest_item_date THEN earliest_item_date::VARCHAR
           ELSE earliest_item_date::VARCHAR || ' - ' || latest_item_date::VARCHAR END AS date_range FROM headers""",
    ),
)
def date_range_labels(t):
    return listing.date_range_label(t.headers()).select("statement_id", "date_range")


@query(
    "statement_page",
    with_tables(("headers",), "SELECT statement_id FROM headers ORDER BY latest_item_date ASC NULLS FIRST, k LIMIT 50 OFFSET 50"),
)
def statement_page(t):
    return listing.paginate(t.headers(), [*listing.list_order("date_range", "asc"), "k"], 2, 40, (25, 50, 100)).select("statement_id")


@query(
    "statement_last_page",
    with_tables(
        ("headers",),
        """SELECT statement_id FROM (SELECT statement_id, row_number() OVER (ORDER BY latest_item_date ASC NULLS FIRST, k) AS place, count(*) OVER () AS n FROM headers) q WHERE place > (n - 1) // 25 * 25""",
    ),
)
def statement_last_page(t):
    index = listing.page_index(t.headers(), [*listing.list_order("date_range", "asc"), "k"], rows_per_range=40)
    return listing.read_page(index, 10**9, 30, (25, 50, 100)).select("statement_id")


@query(
    "statement_counts",
    with_tables(("headers",), "SELECT tenant_id, completed, count(*) AS statements FROM headers WHERE coalesce(record_type, 'statement') = 'statement' GROUP BY 1, 2"),
)
def statement_counts(t):
    return listing.statement_counts(t.headers())


@query(
    "longest_files",
    """SELECT filename, page_count, (SELECT CAST(sum(CAST(ceil(n_chars / 3000.0) AS BIGINT)) AS BIGINT) FROM documents) AS total_pages, (SELECT max(CAST(ceil(n_chars / 3000.0) AS BIGINT)) FROM documents) AS max_pages
       FROM (SELECT concat('d', lpad(CAST(doc_id AS VARCHAR), 12, '0'), '.pdf') AS filename, CAST(ceil(n_chars / 3000.0) AS BIGINT) AS page_count FROM documents) q ORDER BY page_count DESC, filename LIMIT 20""",
)
def longest_files(t):
    files = t.base("documents").select(
        F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".pdf")).alias("filename"), F.ceil(F.col("n_chars") / 3000).alias("page_count")
    )
    return listing.longest_files(files, 20)
