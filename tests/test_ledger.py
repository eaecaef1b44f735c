"""Ledger, tokens, lists and tenants: rules and invariants."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tallyweave.operators import comparison, ledger, listing, quality, tenants, tokens

DOC = "tenant_id string, doc_id string, doc_kind string, contact_id string, number string, load_seq bigint"


def test_upsert_is_idempotent_and_keeps_keyless_rows(spark):
    old = spark.createDataFrame([("T", "a", "invoice", "C", "1", 1), ("T", "b", "invoice", "C", "2", 2), ("T", None, "invoice", "C", "3", 3)], DOC)
    delta = spark.createDataFrame([("T", "b", "invoice", "C", "9", 1), ("T", "c", "invoice", "C", "4", 2)], DOC)
    once = ledger.upsert_ledger(old, delta, "doc_id")
    twice = ledger.upsert_ledger(once, delta, "doc_id")
    want = [("a", "1"), ("b", "9"), ("c", "4"), (None, "3")]
    for out in (once, twice):
        assert sorted(((r.doc_id, r.number) for r in out.collect()), key=str) == sorted(want, key=str)
    assert ledger.upsert_ledger(old, delta.limit(0), "doc_id").count() == 3


def test_large_contacts_are_spread_over_bundles(spark):
    docs = spark.range(100).select(F.lit("T").alias("tenant_id"), F.col("id").cast("string").alias("doc_id"), F.lit("invoice").alias("doc_kind"), F.when(F.col("id") < 95, "HOT").otherwise("C").alias("contact_id"), F.col("id").alias("load_seq"))
    payments = spark.createDataFrame([("T", "p1", "HOT", 1), ("T", "p2", None, 2)], "tenant_id string, payment_id string, contact_id string, load_seq bigint")
    out = ledger.bundle_by_contact(docs, payments, bundle_size=10).collect()
    hot = [r for r in out if r.contact_id == "HOT"]
    assert len(hot) > 5 and max(len(r.invoices) for r in hot) < 40
    assert sum(len(r.invoices) for r in out) == 100 and sum(len(r.payments) for r in out) == 1


LEDGER = "tenant_id string, entry_id string, entry_type string, token_delta bigint, created_at timestamp, source string"


def entries(spark):
    start = datetime(2024, 1, 1)
    moves = [5, -3, 4, -9, 20, 0, -1]
    kinds = ["ADJUSTMENT", "RESERVE", "RELEASE", "RESERVE", "ADJUSTMENT", "CONSUME", "RESERVE"]
    return spark.createDataFrame([("T", f"e{i}", k, m, start + timedelta(hours=13 * i), "s") for i, (k, m) in enumerate(zip(kinds, moves))], LEDGER)


def test_running_balance_over_slices(spark):
    out = tokens.ledger_running_balance(entries(spark)).orderBy("created_at").collect()
    assert [r.running_balance for r in out] == [5, 2, 6, -3, 17, 17, 16]
    assert tokens.first_overdraft(entries(spark)).first().entry_id == "e3"
    balance = tokens.token_balances(entries(spark)).first()
    assert (balance.token_balance, balance.last_entry_id) == (16, "e6")


def test_running_balance_of_a_tenant_on_one_day(spark):
    start = datetime(2024, 1, 1)
    moves = [(n * 7919 % 41) - 19 for n in range(400)]
    rows = [("H", f"e{n:04}", "ADJUSTMENT", m, start, "s") for n, m in enumerate(moves)] + [("T", f"x{n}", "ADJUSTMENT", 1, start, "s") for n in range(5)]
    ledger = spark.createDataFrame(rows, LEDGER).repartition(5)
    want, total = {}, 0
    for n, m in enumerate(moves):
        total += m
        want[f"e{n:04}"] = (total, total < 0 and m < 0)
    for size in (10, 10**6):
        out = {r.entry_id: (r.running_balance, r.overdrawn) for r in tokens.ledger_running_balance(ledger, rows_per_slice=size).collect()}
        assert {k: v for k, v in out.items() if k[0] == "e"} == want and [out[f"x{n}"][0] for n in range(5)] == [1, 2, 3, 4, 5]
    slices = ledger.repartitionByRange(41, "tenant_id", "created_at", "entry_id").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in slices) < 100


def test_pages_of_an_indexed_list(spark):
    rows = [(n, (n * 37) % 11 if n % 5 else None) for n in range(237)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(4)
    order = [F.col("v").desc_nulls_last(), F.col("k")]
    ordered = [k for k, v in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
    index = listing.page_index(df, order, rows_per_range=30)
    assert index.total == 237 and len(index.before) > 5
    for page in (1, 2, 4, 9, 10, 99):
        bounds = listing.page_bounds(237, page, 25)
        assert [r.k for r in listing.read_page(index, page, 25).collect()] == ordered[bounds.start_index : bounds.end_index]
    places = {r.k: r.place for r in listing.numbered(df, order).collect()}
    assert places == {k: n for n, k in enumerate(ordered, 1)}
    empty = listing.page_index(df.limit(0), order)
    assert empty.total == 0 and listing.read_page(empty, 3, 25).count() == 0 and listing.numbered(df.limit(0), order).count() == 0


def test_deep_pages_go_over_the_index(spark, monkeypatch):
    monkeypatch.setattr(listing, "TOP_ROWS", 50)
    df = spark.range(300).withColumnRenamed("id", "k")
    assert [r.k for r in listing.paginate(df, ["k"], 12, 25).collect()] == list(range(275, 300))
    assert [r.k for r in listing.paginate(df, ["k"], 2, 25).collect()] == list(range(25, 50))


def test_consuming_is_no_last_mutation(spark):
    out = tokens.token_balances(entries(spark).where("entry_id < 'e6'")).first()
    assert (out.token_balance, out.last_entry_id) == (17, "e4")


def test_first_outcome_settles(spark):
    headers = spark.createDataFrame([("T", "S", "reserved", "reserve#S", 8)], "tenant_id string, statement_id string, reservation_status string, reservation_entry_id string, pdf_page_count int")
    at = datetime(2024, 1, 1)
    outcomes = spark.createDataFrame([("T", "S", False, at, "1", "w"), ("T", "S", True, at + timedelta(hours=1), "2", "w")], "tenant_id string, statement_id string, succeeded boolean, finished_at timestamp, outcome_id string, source string")
    out = tokens.settle_reservations(headers, outcomes).collect()
    assert [(r.entry_id, r.token_delta, r.next_status) for r in out] == [("release#S", 8, "released")]


def test_subscription_credits_within_a_period(spark):
    at = datetime(2024, 1, 1)
    rows = [("T", f"i{i}", tier, end, at + timedelta(days=i)) for i, (tier, end) in enumerate([("tier_50", "p1"), ("tier_200", "p1"), ("tier_50", "p1"), ("tier_50", "p2")])]
    paid = spark.createDataFrame(rows, "tenant_id string, invoice_id string, tier_id string, period_end string, paid_at timestamp")
    assert [r.tokens_credited for r in tokens.subscription_credits(paid).orderBy("paid_at").collect()] == [50, 150, 0, 50]


def test_pages():
    assert listing.page_bounds(101, 9, 40, (25, 50, 100)) == (3, 50, 3, 101, 100, 150)
    assert listing.page_bounds(0, 0, 0) == (1, 1, 1, 0, 0, 1)
    assert listing.page_bounds(10, 1, 75, (50, 100)).per_page == 50


def test_blank_names_come_last_both_ways(spark):
    df = spark.createDataFrame([("b",), (" ",), ("A",), (None,)], "contact_name string")
    for direction, want in (("asc", ["A", "b"]), ("desc", ["b", "A"])):
        assert [r.contact_name for r in listing.sort_statements(df, "contact", direction).collect()][:2] == want


def test_replaced_items_keep_completion(spark):
    item = "tenant_id string, statement_id string, statement_item_id string, completed boolean"
    existing = spark.createDataFrame([("T", "S", "S#1", True), ("T", "S", "S#2", False), ("T", "R", "R#1", False)], item)
    headers = spark.createDataFrame([("T", "S", True)], "tenant_id string, statement_id string, completed boolean")
    incoming = spark.createDataFrame([("T", "S", "S#2"), ("T", "S", "S#3"), ("T", "S", "")], "tenant_id string, statement_id string, statement_item_id string")
    out = {r.statement_item_id: r.completed for r in comparison.replace_items(existing, headers, incoming).collect()}
    assert out == {"R#1": False, "S#2": False, "S#3": True}


def test_stale_threshold_is_exclusive(spark):
    now, five = 10_000_000, tenants.STALE_AFTER_MS
    df = spark.createDataFrame([("a", "SYNCING", now - five), ("b", "SYNCING", now - five - 1), ("c", "LOADING", None), ("d", "ERASED", None), ("e", None, None)], "tenant_id string, status string, last_heartbeat_ms bigint")
    assert {r.tenant_id: r.acquirable for r in tenants.acquirable(df, now).collect()} == {"a": False, "b": True, "c": True, "d": False, "e": True}
    assert sorted(r.tenant_id for r in tenants.stale_syncs(df, now).collect()) == ["b", "c"]


def test_diffs(spark):
    schema = "scenario string, item_seq int, date string, number string, reference string, total_amounts map<string,decimal(38,10)>"
    from decimal import Decimal as D

    expected = spark.createDataFrame([("s", 1, "1/1", "A", "x", {"Amount": D("1.00")}), ("s", 2, "1/2", "B", "", {"Amount": D("2.00")})], schema)
    actual = spark.createDataFrame([("s", 1, " 1/1", "A", "y", {"Amount": D("1.01")}), ("s", 2, "1/2", "B", None, {"Amount": D("2.02"), "Other": D("1")})], schema)
    assert [(r.item_seq, r.field) for r in quality.diff_items(expected, actual).collect()] == [(1, "reference")]
    assert sorted((r.item_seq, r.label) for r in quality.diff_totals(expected, actual).collect()) == [(2, "Amount"), (2, "Other")]
    assert [r.field for r in quality.diff_items(expected, actual.where("item_seq = 1")).collect()] == ["item_count"]
