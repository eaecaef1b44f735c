"""Chunks, dates, separators and headers: golden vectors and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import shaping
from tallyweave.plans.ingest import ingest_chunks

CHUNK = "tenant_id string, statement_id string, chunk_index int, column_order array<string>, rows array<array<string>>"


def strip_overlap(existing, incoming):
    if not existing or not incoming:
        return incoming
    start = max(0, len(existing) - len(incoming))
    place = next((i for i in range(start, len(existing)) if existing[i] == incoming[0]), None)
    if place is None:
        return incoming
    n = len(existing) - place
    return incoming[n:] if n <= len(incoming) and existing[place:] == incoming[:n] else incoming


def merged(chunks):
    out = []
    for chunk in chunks:
        out += strip_overlap(out, chunk)
    return out


def test_merge_equals_brute_force(spark):
    rng = random.Random(7)
    statements = {}
    for s in range(60):
        rows, chunks = [], []
        for _ in range(rng.randint(1, 6)):
            overlap = rows[-rng.randint(1, 4):] if rows and rng.random() < 0.7 else []
            chunk = overlap + [rng.choice("abcd") for _ in range(rng.randint(0, 5))]
            chunks.append(chunk)
            rows += chunk
        statements[f"S{s}"] = chunks
    data = [("T", s, i, ["number"], [[x] for x in chunk]) for s, chunks in statements.items() for i, chunk in enumerate(chunks)]
    out = shaping.merge_chunks(spark.createDataFrame(data, CHUNK)).select("statement_id", "chunk_index", "row_pos", "number").collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.statement_id, r.chunk_index, r.row_pos)):
        got.setdefault(r.statement_id, []).append(r.number)
    assert got == {s: merged(c) for s, c in statements.items() if merged(c)}


def test_overlaps_that_reach_over_many_chunks(spark):
    rng = random.Random(8)
    statements = {}
    for s in range(12):
        rows, chunks = [], []
        for n in range(60):
            overlap = rows[-rng.randint(1, 3 + n % 9):] if rows and rng.random() < 0.8 else []
            chunk = overlap + [rng.choice("ab") for _ in range(rng.randint(0, 2))]
            chunks.append(chunk)
            rows = merged(chunks)
        statements[f"S{s}"] = chunks
    statements["same"] = [["x"] * (1 + n % 7) for n in range(80)]
    data = [("T", s, i, ["number"], [[x] for x in chunk]) for s, chunks in statements.items() for i, chunk in enumerate(chunks)]
    out = shaping.merge_chunks(spark.createDataFrame(data, CHUNK)).select("statement_id", "chunk_index", "row_pos", "number").collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.statement_id, r.chunk_index, r.row_pos)):
        got.setdefault(r.statement_id, []).append(r.number)
    assert got == {s: merged(c) for s, c in statements.items()}


def test_short_rows_are_padded_and_extra_cells_ignored(spark):
    df = spark.createDataFrame([("T", "S", 0, ["date", "Amount"], [["1/2"], ["1/3", "5", "extra"]])], CHUNK)
    out = shaping.reconstruct_items(df).orderBy("row_pos").collect()
    assert [(r.date, r.number, r.total) for r in out] == [("1/2", "", {"Amount": ""}), ("1/3", "", {"Amount": "5"})]


def test_header_mapping_last_duplicate_wins(spark):
    df = spark.createDataFrame([(["Date", "Ref", "Ref", "More"], ["date", "number", "Debit"])], "detected_headers array<string>, column_order array<string>")
    assert shaping.build_header_mapping(df).first().header_mapping == {"Date": "date", "Ref": "total"}


def test_page_chunks(spark):
    df = spark.createDataFrame([("T", "A", 25), ("T", "B", 10), ("T", "C", 1), ("T", "D", 0), ("T", "E", 11)], "tenant_id string, statement_id string, pages int")
    got = {}
    for r in shaping.plan_page_chunks(df).orderBy("statement_id", "chunk_index").collect():
        got.setdefault(r.statement_id, []).append((r.start_page, r.end_page))
    assert got == {"A": [(1, 10), (10, 19), (19, 25)], "B": [(1, 10)], "C": [(1, 1)], "E": [(1, 10), (10, 11)]}


DATES = "tenant_id string, statement_id string, date string, date_format string"


@pytest.mark.parametrize(
    "given, fmt, confidence, confirmed",
    [
        (["15/01/2024", "02/03/2024"], "MM/DD/YYYY", "high", "DD/MM/YYYY"),
        (["01/15/2024"], "DD/MM/YYYY", "high", "MM/DD/YYYY"),
        (["01/02/2024", "03/04/2024"], "DD/MM/YYYY", "low", ""),
        (["15/01/2024", "01/15/2024"], "DD/MM/YYYY", "high", ""),
        (["5 Mar 2024"], "D MMM YYYY", "high", "D MMM YYYY"),
        (["01/xx/2024"], "DD/MM/YYYY", "high", ""),
        (["", None], "DD/MM/YYYY", "low", ""),
        (["0102"], "DDMM", "high", ""),
    ],
)
def test_date_order(spark, given, fmt, confidence, confirmed):
    df = spark.createDataFrame([("T", "S", d, fmt) for d in given], DATES)
    assert shaping.date_confidence(df).first().date_confidence == confidence
    assert shaping.disambiguate_date_format(df).first().confirmed_format == confirmed


@pytest.mark.parametrize(
    "given, proposed, want",
    [
        (["1,234.56", "99.10"], (".", ","), (".", ",")),
        (["1.234,56"], (".", ","), (",", ".")),
        (["1 234,56"], (".", ","), (",", " ")),
        (["1'234.50"], (".", ","), (".", "'")),
        (["99,10"], (".", ","), (",", ".")),
        (["1,234"], (".", ","), (".", ",")),
        (["1,234"], (",", "."), (".", ",")),
        (["12"], (",", "."), (",", ".")),
        (["1,234", "12,50"], (".", ","), (".", ",")),
        (["(1,234.56)", "R 5.00"], (",", "."), (".", ",")),
        (["1,234,567"], (",", "."), (".", ",")),
    ],
)
def test_separators(spark, given, proposed, want):
    df = spark.createDataFrame([("S", v) for v in given], "statement_id string, value string")
    out = shaping.disambiguate_separators(df, ["statement_id"], *proposed).first()
    assert (out.decimal_separator, out.thousands_separator) == want


def test_common_formats_show_digits_as_letters(spark):
    df = spark.createDataFrame([(1, "01/02/2024"), (2, "5 Mar"), (3, "03/02/2024")], "i int, v string")
    assert [(r.pattern, r.samples) for r in shaping.common_formats(df, "v", "i").collect()] == [("AA/AA/AAAA", 2), ("A AAA", 1)]


def test_display_headers(spark):
    def shown(order, mapping):
        df = spark.createDataFrame([("T", "S", order, mapping)], "tenant_id string, statement_id string, column_order array<string>, header_mapping map<string,string>")
        row = shaping.display_headers(df).first()
        return [h.header for h in row.headers], row.number_header

    mapping = {"Date": "date", "Invoice  No.": "number", "Debit": "total", "Balance": "total", "Doc": "other"}
    assert shown(["Balance", "Debit", "number", "DATE", "doc", "Unmapped"], mapping) == (["DATE", "number", "doc", "Debit"], "number")
    assert shown(["Balance", "Net Total", "reference"], {"Balance": "total", "Net Total": "total"}) == (["reference", "Net Total"], "reference")
    assert shown(["Balance"], {"balance": "total"}) == (["Balance"], None)
    assert shown(["Misc"], {"Misc": "total"}) == ([], None)


def test_ingest_chunks(spark):
    rows = [
        ("T", "S", 0, ["Date", "Invoice No.", "Amount"], ["date", "number", "Amount"], [["15/01/2024", "INV-001", "1,234.56"], ["20/01/2024", "INV-002", "789.00"]], "DD/MM/YYYY", 100, 50),
        ("T", "S", 1, ["Date", "Invoice No.", "Amount"], ["date", "number", "Amount"], [["20/01/2024", "INV-002", "789.00"], ["21/01/2024", "", "abc"]], "MM/DD/YYYY", 80, 30),
    ]
    schema = "tenant_id string, statement_id string, chunk_index int, detected_headers array<string>, column_order array<string>, rows array<array<string>>, date_format string, input_tokens bigint, output_tokens bigint"
    chunks = spark.createDataFrame(rows, schema)
    statements, items = ingest_chunks(chunks, ["DD/MM/YYYY"])
    s = statements.first()
    assert (s.input_tokens, s.output_tokens, s.date_confidence, str(s.earliest_item_date), str(s.latest_item_date)) == (180, 80, "high", "2024-01-15", "2024-01-21")
    got = [(r.statement_item_id, r.number, r.issues) for r in items.orderBy("item_seq").collect()]
    assert got == [("S#item-0001", "INV-001", []), ("S#item-0002", "INV-002", []), ("S#item-0003", "", ["missing-number"])]
    assert [r.chunk_index for r in shaping.chunk_metadata_audit(chunks).collect()] == [1]
    assert [r.text for r in shaping.conversion_failures(items).collect()] == ["abc"]
    assert items.agg(F.count("*")).first()[0] == 3
