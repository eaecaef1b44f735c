"""Registered queries against their SQL. All of them with CHECK_ALL=1, else a cross-section."""

import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry
from checks.derive import BASE

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")

SOME = (
    "amounts_convert", "amounts_decimal", "dates_by_template", "keys_of_documents", "merged_chunks", "monetary_cells",
    "statement_separators", "displayed_headers", "statement_cells", "flagged_items", "substring_candidates", "compared_cells",
    "reconciliation_summary", "full_reconciliation", "resolved_matches", "guessed_item_types", "token_similarities", "types_by_contained_words", "upserted_ledger", "running_balances",
    "subscription_credits", "tenant_progress", "tenant_flags", "swept_tenants", "streamed_ledger", "exported_files", "unused_documents",
    "landed_folder", "ledger_file_records", "statement_last_page", "ordered_ledger", "dates_epoch", "streamed_token_ledger",
)


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        return round(float(value), 9)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return value


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in BASE:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def test_every_query_is_known_and_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(SOME) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("CHECK_ALL") else SOME)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(str([plain(r[names.index(c)]) for c in columns]) for r in result.fetchall())
    assert sorted(str([plain(r[c]) for c in columns]) for r in df.collect()) == want


def test_full_reconciliation_is_right_every_time(spark):
    """Containment matches must not depend on how stages happen to be laid out; ten runs with CHECK_ALL=1."""
    folder = "/root/testdata/sf0.01"
    connection = duckdb.connect()
    for name in BASE:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    result = connection.execute(entry.oracle_sql()["full_reconciliation"])
    names = [d[0] for d in result.description]
    want = sorted(str([plain(r[names.index(c)]) for c in sorted(names)]) for r in result.fetchall())
    for _ in range(10 if os.environ.get("CHECK_ALL") else 2):
        df = entry.queries()["full_reconciliation"](spark, folder)
        assert sorted(str([plain(r[c]) for c in sorted(names)]) for r in df.collect()) == want
