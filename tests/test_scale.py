"""Faults that only larger tables showed, on small rows of their own."""

import pytest
from pyspark.sql import functions as F

from checks import queries_ledger, queries_rows  # noqa: F401
from checks.derive import Tables
from checks.registry import QUERIES
from tallyweave.functions import amounts, dates
from tallyweave.functions.arrays import bound
from tallyweave.operators import listing, shaping, tokens, values
from tallyweave.session import MOST_SMALL_RANGES, SHUFFLE_CLEANUP, ranges_of, stored
from tallyweave.streaming import bundles


def test_a_union_of_split_joins_runs(spark):
    """UnionExec asked a join split for skew how its rows are dealt, which failed."""
    assert spark.conf.get("spark.sql.unionOutputPartitioning") == "false"


def test_ranges_stay_few(spark):
    """a range is a task, a folder and a sample for the driver, so small ones are not made by the thousand."""
    assert ranges_of(0, 40, 100_000) == 1 and ranges_of(100, 40, 100_000) == 3
    assert ranges_of(5_400_000, 40, 100_000) == MOST_SMALL_RANGES
    assert ranges_of(36_000_000, 500, 250_000) == MOST_SMALL_RANGES
    assert ranges_of(1_000_000_000, 500, 250_000) == 4000
    df = spark.range(2000).select(F.col("id").alias("k"))
    index = listing.page_index(df, ["k"], rows_per_range=2)
    assert len(index.before) == MOST_SMALL_RANGES + 1 and index.total == 2000
    assert [r.k for r in listing.read_page(index, 10**9, 30).collect()] == list(range(1980, 2000))
    ledger = df.select(F.lit("T").alias("tenant_id"), F.col("k").cast("string").alias("entry_id"), F.lit(1).alias("token_delta"), F.timestamp_seconds("k").alias("created_at"))
    out = tokens.ledger_running_balance(ledger, rows_per_slice=2)
    assert out.where(F.col("running_balance") != F.unix_seconds("created_at") + 1).count() == 0


def test_bound_values_are_made_once(spark):
    once = spark.range(20).select(bound(F.rand(), lambda v: F.array(v, v, v)).alias("x"))
    assert once.where((F.col("x")[0] != F.col("x")[1]) | (F.col("x")[1] != F.col("x")[2])).count() == 0


def test_headers_bind_the_mapping(spark):
    """F1, F5, F11, F12, F14, F16, F19: the mapping was made anew for each header, by as many tasks as files hold statements."""
    rows = [("T", "S", ["Date", "Total", "Ref"], {"date": "date", "TOTAL ": "total", "ref": "reference"})]
    df = spark.createDataFrame(rows, "tenant_id string, statement_id string, column_order array<string>, header_mapping map<string, string>")
    plan = shaping.display_headers(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map_from_entries") == 1
    row = shaping.display_headers(df).first()
    assert [h.field for h in row.headers] == ["date", "reference", "total"] and row.number_header == "Ref"


@pytest.mark.parametrize("text, want", [("", None), ("abc", None), (".", None), ("１２", 12), ("1e2", 100), ("-7.5", -7.5), (None, None)])
def test_amounts_without_digits(one, text, want):
    assert one([text], amounts.coerce_amount(F.col("v")))[0] == want


@pytest.mark.parametrize("text, want", [("2024-02-03", "2024-02-03"), ("#2024-2-3", "2024-02-03"), ("x", None), ("2024-02-31", None)])
def test_dates_that_do_not_fit(one, text, want):
    assert str(one([text], dates.generic_date(F.col("v")))[0]) == str(want)


def test_monetary_cells_by_place(spark):
    """F8: named columns by their first place, blank ones settle nothing; null keys are judged by their own text."""
    cells = [
        ("T", "A", 1, 0, "Debit", "1.50"), ("T", "A", 1, 1, " debit", "2.50"), ("T", "A", 1, 2, "x", "3.50"),
        ("T", "B", 1, 0, "Debit", " "), ("T", "B", 1, 1, "x", "4.50"), ("T", "B", 1, 2, "Date", "5.50"), ("T", "B", 1, 3, None, "6.50"),
        (None, "C", 1, 0, "Debit", "7.50"),
    ]
    cells = spark.createDataFrame(cells, "tenant_id string, statement_id string, item_seq int, header_pos int, header string, value string")
    named = cells.where("tenant_id IS NOT NULL").select("tenant_id", "statement_id", F.lit("debit").alias("header"))
    excluded = named.withColumn("header", F.lit("Date"))
    assert sorted(r.value for r in shaping.monetary_values(cells, named, excluded).collect()) == ["1.50", "4.50", "6.50", "7.50"]
    assert sorted(r.value for r in shaping.monetary_values(cells, named).collect()) == ["1.50", "4.50", "5.50", "6.50", "7.50"]


def test_picked_amounts_bind_the_cells(spark):
    """the raw cells were made anew for each token."""
    df = spark.createDataFrame([("0", ["nothing", "Total"], "1,234.50"), ("5", ["Total"], "9"), ("0", [], "9")], "own string, tokens array<string>, cell string")
    df = df.withColumn("raw", F.create_map(F.lit("total"), F.upper("cell")))
    out = values.pick_amount(df, "own", "tokens")
    assert [float(r.amount) for r in out.collect()] == [1234.5, 5.0, 0.0]


def test_item_rows_are_dealt_over_tasks_before_their_maps_are_made(spark, tmp_path):
    """a file of one row group was one task for all values of its rows."""
    orders = spark.range(50).selectExpr("id AS o_orderkey", "id % 5 AS o_custkey", "'F' AS o_orderstatus", "id + 0.5D AS o_totalprice", "TIMESTAMP '1995-01-01' AS o_orderdate")
    orders.unionByName(orders.where("o_orderkey = 1")).write.parquet(f"{tmp_path}/orders.parquet")
    items = Tables(spark, str(tmp_path)).items()
    assert sorted(r.k for r in items.select("k").collect()) == sorted([k for k in range(50) if k % 7] + [1])
    plan = items._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan[plan.rindex("map(") :]


def test_cells_are_compared_by_forms_made_once_a_row(spark):
    """the forms of headers were made anew for each token and cell."""
    items = spark.createDataFrame([(1, {"Debit ": "5.00", "A-B": "(2)"}, ["debit", "ab"], "0"), (2, {}, None, "x")], "k int, raw map<string,string>, tokens array<string>, own string")
    out = values.pick_amount(items, "own", "tokens")
    assert {r.k: r.amount for r in out.collect()} == {1: 5, 2: None}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^\\p{L}\\p{N}]") == 2


def test_lines_are_dealt_before_they_are_sorted(spark, tmp_path):
    """a task that reads sorted all its rows."""
    lines = [(1, 1, 2, 0, 10.0, 5.0), (1, 2, 3, 1, 10.0, 9.0), (1, 2, 3, 1, 10.0, 9.0), (2, 1, 3, 4, 10.0, 9.0), (None, None, 3, 2, 30.0, 9.0)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    tiers = QUERIES["resolved_tiers"](spark, str(tmp_path))
    assert {r.invoice_id: r.tier_id for r in tiers.collect()} == {1: "tier_200", None: "tier_500"}
    plan = tiers._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan[plan.rindex("partial_min(struct(") :]


def test_a_bucket_of_the_contacts_is_one_file(spark, tmp_path):
    """each task wrote a file in every bucket."""
    docs = spark.range(3000).selectExpr("'T' AS tenant_id", "concat('C', id % 7) AS contact_id", "'invoice' AS doc_kind", "concat('D', id) AS doc_id", "id AS load_seq").repartition(8)
    paid = spark.createDataFrame([], "tenant_id string, contact_id string, payment_id string, load_seq bigint")
    folder, records = str(tmp_path / "bundles"), bundles.ledger_records(docs, paid)
    for n in range(2):  # the second batch moves every record
        bundles.bundle_batch(folder)(records.withColumn("contact_id", F.concat("contact_id", F.lit("m" * n))), n)
    files = [len(list(d.glob("*.parquet"))) for d in (tmp_path / "bundles" / "contacts").glob("batch=*/bucket=*")]
    assert len(files) > 256 and set(files) == {1}
    kept = bundles.read_bundles(spark, folder).select("contact_id", F.explode("invoices").alias("d"))
    assert kept.count() == 3000 and kept.where(~F.col("contact_id").endswith("m")).count() == 0


def test_the_reconciliation_makes_its_items_once(spark, tmp_path):
    """F2 of round 4: items were made again for the evidence, and shuffled anew for matches and for their status behind the scores of words."""
    orders = spark.range(60).selectExpr("id AS o_orderkey", "id % 5 AS o_custkey", "if(id % 2 = 0, 'F', 'O') AS o_orderstatus", "id + 0.5D AS o_totalprice", "TIMESTAMP '1995-01-01' AS o_orderdate")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(5).selectExpr("id AS c_custkey", "concat('Name ', id) AS c_name").write.parquet(f"{tmp_path}/customer.parquet")
    out = QUERIES["full_reconciliation"](spark, str(tmp_path))
    assert out.agg(F.sum("rows")).first()[0] == 51 and out.count() == 5
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 2  # the items and the statements


def test_stored_rows_are_the_same_and_leave_settings_alone(spark):
    df = spark.createDataFrame([(1, "a", [1.5]), (1, "a", [1.5]), (None, None, None)], "i int, s string, a array<double>").repartition("i")
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    kept = stored(df)
    assert kept.schema == df.schema and spark.conf.get(SHUFFLE_CLEANUP) == before
    assert sorted(map(str, kept.collect())) == sorted(map(str, df.collect())) == sorted(map(str, df.collect()))
