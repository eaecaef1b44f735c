"""Golden vectors of the value rules."""

from datetime import date, datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import amounts, dates, text
from tallyweave.operators import values


def numbers(out):
    return [None if x is None else float(x) for x in out]


def test_convert_amount(one):
    given = ["(126.50)", "126.50-", "1.234,56", "1 234,56", "R1,234.56", "-R5", "(R 5.00)", "1.5 USD", "abc", "Inv 12", "1.234", "0.125", "1'234.50", "- 5", ""]
    want = [-126.5, -126.5, 1234.56, 1234.56, 1234.56, None, None, None, None, 12.0, 1234.0, 125.0, 1234.5, -5.0, None]
    assert numbers(one(given, amounts.convert_amount("v"))) == want


def test_display_amount_never_sees_parentheses(one):
    given = ["(126.50)", "126.50-", "1.234", "PO-12", "1.234.56", "-", ".", "", None, "12,5"]
    want = [126.5, -126.5, 1234.0, -12.0, None, None, None, None, None, 12.5]
    assert numbers(one(given, amounts.display_amount("v"))) == want


def test_compare_amount_only_drops_commas(one):
    assert numbers(one(["126.50-", "1.234,56", "PO-12", "1,234"], amounts.compare_amount("v"))) == [None, 1.23456, -12.0, 1234.0]


def test_evidence_amount(one):
    given = ["(10.00)", "12..5", "-", "", None, "0.00", "R 5"]
    assert numbers(one(given, amounts.evidence_amount("v"))) == [-10.0, 12.5, None, None, None, 0.0, 5.0]
    assert one(given, amounts.has_amount("v")) == [True, True, False, False, False, False, True]


def test_marked_amount(one):
    given = ["R 1,234.56", "(R 1,234.56)", "+5", "-5", "abc", "1e3"]
    assert numbers(one(given, amounts.marked_amount("v"))) == [1234.56, -1234.56, 5.0, -5.0, None, 1000.0]


def test_render_amount(one):
    assert one(["1234.5", "abc", "", None, "-0.001", "2.5"], amounts.render_amount("v")) == ["1,234.50", "abc", "", "", "-1.00", "2.50"]


@pytest.mark.parametrize(
    "value, template, want",
    [
        ("15/03/2024", "DD/MM/YYYY", date(2024, 3, 15)),
        ("5 march 2024", "D MMMM YYYY", date(2024, 3, 5)),
        ("1st Sept 2024", "Do MMM YYYY", date(2024, 9, 1)),
        ("31/02/2024", "DD/MM/YYYY", None),
        ("15/03/24", "DD/MM/YY", date(2024, 3, 15)),
        ("15 Foo 2024", "D MMM YYYY", None),
        ("15/03/2024", "%d/%m/%Y", date(2024, 3, 15)),
        ("15/03/2024", "DD/MM[/YYYY]", date(2024, 3, 15)),
        ("15/03", "DD/MM[/YYYY]", None),
        ("03 March 03 2024", "MM MMMM DD YYYY", date(2024, 3, 3)),
        ("04 March 03 2024", "MM MMMM DD YYYY", None),
        ("Monday  4 March 2024", "dddd D MMMM YYYY", date(2024, 3, 4)),
    ],
)
def test_parse_date(one, value, template, want):
    assert one([value], dates.parse_date("v", template)) == [want]


def test_strict_dialect_minds_case_spaces_and_brackets(one):
    assert one(["15 MAR 2024"], dates.parse_date("v", "D MMM YYYY", lenient=False)) == [date(2024, 3, 15)]
    assert one(["1ST Mar 2024", "1st Mar 2024"], dates.parse_date("v", "Do MMM YYYY", lenient=False)) == [None, date(2024, 3, 1)]
    assert one(["5  Mar 2024"], dates.parse_date("v", "D MMM YYYY", lenient=False)) == [None]
    assert one(["15/03/2024"], dates.parse_date("v", "DD/MM[/YYYY]", lenient=False)) == [None]


def test_render_date(one):
    day = F.lit(date(2024, 3, 22))
    assert one([""], dates.render_date(day, "Do MMMM YYYY")) == ["22nd March 2024"]
    assert one([""], dates.render_date(day, "dddd D MMM YY")) == ["Friday 22 Mar 24"]
    assert one([""], dates.render_date(day, "YYYY[-MM]")) == ["2024-03"]
    assert one([""], dates.render_date(F.lit(date(2024, 3, 12)), "Do")) == ["12th"]


def test_generic_loose_and_epoch_dates(one):
    given = ["2024-01-05T10:00:00Z", "2024-1-5", "20240105", "2024010512", "2024-01-05 junk"]
    assert one(given, dates.generic_date("v")) == [date(2024, 1, 5)] * 3 + [None, date(2024, 1, 5)]
    given = ["5/6/24", "5/6/2024", "2024/6/5", "5-6-2024", "5/6/99", "junk"]
    assert one(given, dates.loose_date("v", None)) == [date(2024, 6, 5)] * 4 + [date(1999, 6, 5), None]
    assert one(["5 September 2024", "5/6/24"], dates.loose_date("v", "dd/mm/yy")) == [date(2024, 9, 5), date(2024, 6, 5)]
    given = ["1700000000", "1700000000000", "2024-01-05T10:00:00Z", "x"]
    moment = datetime(2023, 11, 14, 22, 13, 20)
    assert one(given, dates.epoch_timestamp("v")) == [moment, moment, datetime(2024, 1, 5, 10), None]


def test_hundreds_of_templates_are_read_and_written_by_one_expression(spark):
    fixed = [("15/03/2024", "DD/MM/YYYY"), ("5 Mar 2024", "D MMM YYYY"), ("31/02/2024", "DD/MM/YYYY"), ("1st May 2024", "Do MMMM YYYY"), (None, "DD"), ("x", None)]
    many = [(f"07/08/2023 ({i})", f"MM/DD/YYYY ({i})") for i in range(400)]
    df = spark.createDataFrame(fixed + many, "v string, t string").coalesce(1)
    templates = dates.templates_of(df, "t")
    assert len(templates) == 404
    parsed = dates.parse_by_template("v", "t", templates)
    out = df.select(parsed.alias("d"), dates.render_by_template(parsed, "t", templates).alias("r"), dates.loose_by_template("v", "t", templates).alias("l")).collect()
    assert [r.d for r in out] == [date(2024, 3, 15), date(2024, 3, 5), None, date(2024, 5, 1), None, None] + [date(2023, 7, 8)] * 400
    assert [r.r for r in out] == ["15/03/2024", "5 Mar 2024", None, "1st May 2024", None, None] + [v for v, _ in many]
    assert [r.l for r in out][:2] == [date(2024, 3, 15), date(2024, 3, 5)] and [r.l for r in out][6:] == [date(2023, 7, 8)] * 400


def test_keys(one):
    assert one(["Due Date!", None], text.label_key("v")) == ["duedate", ""]
    assert one(["  Invoice   No. "], text.header_key("v")) == ["invoice no."]
    assert one(["inv-00 1/a"], text.id_key("v")) == ["INV001A"]
    assert one(["ref INV 1234/56 x", "none"], text.document_number("v")) == ["INV1234/56", None]
    assert one(["credit_note", "other_kind", " ", None], text.item_type_label("v")) == ["CRN", "OTHER KIND", "", ""]


def test_purchase_prices(spark):
    df = spark.createDataFrame([(499,), (500,), (999,), (1000,)], "tokens int")
    assert [r.total_pence for r in values.price_purchases(df).orderBy("tokens").collect()] == [4990, 4999, 9490, 9498]
    assert values.price_subscriptions(spark.createDataFrame([("tier_50",)], "tier_id string")).first().monthly_price_pence == 450


def test_raw_lookups(spark):
    raw = {"Due Date": " 05/06/2024 ", "debit": "12", "Blank": " "}
    df = spark.createDataFrame([(raw, "0", ["credit", "DEBIT"], "due_date")], "raw map<string,string>, total string, tokens array<string>, h string")
    out = values.pick_date_from_raw(values.pick_from_raw(values.pick_amount(df, "total", "tokens"), "h", "cell"), "due_date", "due", "DD/MM/YYYY").first()
    assert (out.amount, out.cell, out.due) == (D("12.0000000000"), "05/06/2024", date(2024, 6, 5))
