"""Queries that once left rows out give every row of their table."""

import duckdb
import pytest
from test_queries import FOLDER, plain

import __spark_entry__ as entry
from checks.derive import BASE

TYPED = ("types_with_evidence", "types_by_contained_words", "types_by_keywords", "derived_documents", "guessed_item_types")


@pytest.mark.parametrize(("name", "table"), [("snapshot_rows", "snapshot_rows"), ("statement_list", "statements_by_upload"), *((name, "amount_hints") for name in TYPED)])
def test_every_row_is_there(spark, name, table):
    connection = duckdb.connect()
    for base in BASE:
        connection.execute(f"CREATE VIEW {base} AS SELECT * FROM '{FOLDER}/{base}.parquet'")
    rows = entry.queries()[name](spark, FOLDER)
    result = connection.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    want = sorted(str([plain(v) for v in r]) for r in result.fetchall())
    got = sorted(str([plain(r[c]) for c in columns]) for r in rows.collect())
    source = entry.oracle_sql()[table]  # a query that gives every row of the table
    assert got == want and len(got) == len(connection.execute(source).fetchall()) > 40
