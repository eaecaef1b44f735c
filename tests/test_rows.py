"""Flags, classification and comparison: golden vectors."""

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import classification, comparison, flags

ITEM = "i int, number string, reference string"


def test_flags(spark):
    rows = [(1, "", "Balance brought forward"), (2, "INV-100", "Widgets"), (3, "Balance", ""), (4, "Balance 2024", ""), (5, "forward balance 9 8", None)]
    out = flags.flag_items(spark.createDataFrame(rows, ITEM)).orderBy("i").collect()
    assert [list(r.issues) for r in out] == [["missing-number", "keyword-reference"], [], ["keyword-number"], [], ["keyword-number"]]
    assert [list(r["flags"]) for r in out] == [["ml-outlier"], [], ["ml-outlier"], [], ["ml-outlier"]]
    assert [d.keyword for d in out[0].flag_details] == [None, "brought forward"]
    assert out[4].flag_details[0].keyword == "balance forward"


def test_drop_flagged(spark):
    rows = [(1, "", "Balance forward"), (2, "INV-200", "Parts")]
    assert [r.i for r in flags.drop_flagged(spark.createDataFrame(rows, ITEM)).collect()] == [2]


TYPES = [
    ({"Description": "Widgets"}, {"Debit": "100"}, "invoice"),
    ({}, {"Credit": "50"}, "payment"),
    ({"Description": "Credit note 123"}, {"Credit": "50"}, "credit_note"),
    ({"Reference": "Invoice INV-42"}, {"Debit": "100", "Credit": "20"}, "invoice"),
    ({"Description": "Invoice 123"}, {"Credit": "25"}, "payment"),
    ({}, {"Credit": "(10.00)"}, "payment"),
    ({"Description": "Payment credit note"}, {"Credit": "10"}, "payment"),
    ({"Reference": "CR 123"}, {"Credit": "10"}, "credit_note"),
    ({"Reference": "XYZ"}, {"Credit": "10"}, "payment"),
    ({"Description": "SUBSCRIPTION bill"}, {"Other": "10"}, "credit_note"),
    ({"Description": "Paymnt thanks"}, {"Credit": "10"}, "payment"),
    ({"Description": "Crdit nte 5"}, {"Credit": "10"}, "credit_note"),
]


def test_guessed_types(spark):
    df = spark.createDataFrame([(i, raw, total) for i, (raw, total, _) in enumerate(TYPES)], "i int, raw map<string,string>, total map<string,string>")
    out = classification.guess_item_type(df).orderBy("i").collect()
    assert [r.guessed_type for r in out] == [want for _, _, want in TYPES]


def test_token_similarity(spark):
    df = spark.createDataFrame([(["P"],), (["CRE"],), (["BOLL"],), ([],)], "t array<string>")
    out = [r.s for r in df.select(classification.token_similarity(F.col("t")).alias("s")).collect()]
    assert out[0].payment == 0.9
    assert out[1].credit_note == 0.9
    assert out[2].invoice == pytest.approx(0.75)
    assert tuple(out[3]) == (0.0, 0.0, 0.0)


def test_texts_equal(spark):
    pairs = [("PO-12", "SO-12", True), ("12", "abc", False), ("Abc ", "abC", True), ("1,000.00", "1000", True), ("", "", True), ("126.50-", "126.50-", True)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert all(r.ok == r.want for r in df.select("want", comparison.texts_equal(F.col("a"), F.col("b")).alias("ok")).collect())


def test_ids_agree(spark):
    pairs = [("Invoice # INV-001", "INV001", True), ("INV-1", "", False), ("A1", "B1", False)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert all(r.ok == r.want for r in df.select("want", comparison.ids_agree(F.col("a"), F.col("b")).alias("ok")).collect())


def test_row_state_prefers_anomaly(spark):
    df = spark.createDataFrame([(1, [" ml-outlier "], True), (2, ["invalid-date"], False), (3, ["x"], True), (4, None, False)], "i int, flags array<string>, row_match boolean")
    assert [r.state for r in flags.row_state(df).orderBy("i").collect()] == ["anomaly", "anomaly", "match", "mismatch"]


def test_description_keywords(spark):
    rows = [("EFT 123", {}), ("thank you for all", {}), ("Refund", {}), ("Sales order 12", {}), ("", {"Description": "Bank transfer"}), ("", {"Amount": "1"})]
    df = spark.createDataFrame([(i, ref, raw, {}) for i, (ref, raw) in enumerate(rows)], "i int, reference string, raw map<string,string>, total map<string,string>")
    out = classification.classify_by_keywords(df).orderBy("i").collect()
    assert [r.entry_type for r in out] == ["payment", "payment", "credit_note", "invoice", "payment", "invoice"]
