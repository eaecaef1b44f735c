"""Value normalisation over whole tables, pricing, and amounts and dates looked up in raw cells."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import amounts, dates
from tallyweave.functions.arrays import bound
from tallyweave.functions.text import KEY_RULES, _col, has_text, label_key, strip, stripped

# Pay-as-you-go price bands (tokens in the band, pence per token); the last is open.
PRICE_BANDS = ((499, 10), (500, 9), (None, 8))

# Subscription tiers (id, name, tokens per month, pence per token).
SUBSCRIPTION_TIERS = (
    ("tier_50", "50 Pages/mo", 50, 9),
    ("tier_200", "200 Pages/mo", 200, 8),
    ("tier_500", "500 Pages/mo", 500, 7),
)

# Normalised header names that may carry a date.
DATE_SYNONYMS = {
    "due_date": ("duedate", "due", "datedue"),
    "date": ("date", "transactiondate", "docdate"),
}


def normalise_amounts(df: DataFrame, column: str, rule: str = "decimal") -> DataFrame:
    """Add ``<column>_amount`` under a rule, and ``<column>_ok``.

    A value is not ok when it has text that the rule cannot read; the text itself stays in place.
    """
    return df.withColumn(f"{column}_amount", amounts.AMOUNT_RULES[rule](column)).withColumn(
        f"{column}_ok", ~has_text(column) | F.col(f"{column}_amount").isNotNull()
    )


def render_amounts(df: DataFrame, column: str) -> DataFrame:
    """Add ``<column>_text``, the display form of an amount cell."""
    return df.withColumn(f"{column}_text", amounts.render_amount(column))


def normalise_dates(
    df: DataFrame,
    column: str,
    template_column: str | None = None,
    templates: Sequence[str] | None = None,
    rule: str = "template",
    lenient: bool = True,
) -> DataFrame:
    """Add ``<column>_date`` (a TIMESTAMP for rule 'epoch') and ``<column>_ok``.

    Rules: 'template' reads the row's template only, 'coerce' falls back to ISO, 'loose' reads as
    strptime does, 'epoch' reads epoch numbers. When ``templates`` is not given, the distinct ones
    of the table are looked up.
    """
    if rule == "epoch":
        parsed = dates.epoch_timestamp(column)
    else:
        if templates is None and template_column:
            templates = dates.templates_of(df, template_column)
        if template_column is None:
            parsed = dates.loose_date(column, None) if rule == "loose" else dates.generic_date(column)
        elif rule == "loose":
            parsed = dates.loose_by_template(column, template_column, templates)
        else:
            parsed = dates.parse_by_template(column, template_column, templates, lenient)
        if rule == "coerce" and template_column is not None:
            parsed = F.coalesce(parsed, dates.generic_date(column))
    return df.withColumn(f"{column}_date", parsed).withColumn(
        f"{column}_ok", ~has_text(column) | F.col(f"{column}_date").isNotNull()
    )


def render_dates(
    df: DataFrame, date_column: str, template_column: str, templates: Iterable[str], lenient: bool = True
) -> DataFrame:
    """Add ``<date_column>_text``, a DATE written in the row's template."""
    return df.withColumn(
        f"{date_column}_text",
        dates.render_by_template(F.col(date_column), template_column, templates, lenient),
    )


def normalise_keys(df: DataFrame, column: str, rule: str) -> DataFrame:
    """Add ``<column>_key`` under one of the label, header, id, text, tokens or document rules."""
    return df.withColumn(f"{column}_key", KEY_RULES[rule](column))


def failure_profile(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """Rows and unreadable values per group, for a column normalised before."""
    return df.groupBy(*by).agg(
        F.count("*").alias("values"), F.count_if(~F.col(f"{column}_ok")).alias("failures")
    )


def type_map_values(df: DataFrame, map_column: str) -> DataFrame:
    """Blank entries dropped; numeric ones also in ``<map>_numbers`` as decimals."""
    kept = F.map_filter(F.col(map_column), lambda _, v: has_text(v))
    trimmed = F.transform_values(kept, lambda _, v: strip(v))
    numbers = F.map_filter(
        F.transform_values(trimmed, lambda _, v: F.translate(v, ",", "").try_cast(amounts.AMOUNT_TYPE)),
        lambda _, v: v.isNotNull(),
    )
    return df.withColumn(map_column, trimmed).withColumn(f"{map_column}_numbers", numbers)


def price_purchases(purchases: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Banded price of a token purchase, and the effective rate in pence."""
    remaining = F.col(tokens).cast("bigint")
    total: Column = F.lit(0).cast("bigint")
    for size, pence in PRICE_BANDS:
        taken = remaining if size is None else F.least(remaining, F.lit(size).cast("bigint"))
        total = total + taken * pence
        remaining = F.greatest(remaining - taken, F.lit(0).cast("bigint"))
    priced = purchases.withColumn("total_pence", total)
    return priced.withColumn(
        "rate_pence",
        F.when(F.col(tokens) > 0, F.bround(F.col("total_pence") / F.col(tokens), 2)).cast("decimal(10,2)"),
    )


def tier_table(spark, tiers=SUBSCRIPTION_TIERS) -> DataFrame:
    """The subscription tiers as a table; a handful of fixed rows."""
    return spark.createDataFrame(
        tiers, "tier_id string, tier_name string, tokens_per_month bigint, rate_pence bigint"
    )


def price_subscriptions(subscriptions: DataFrame) -> DataFrame:
    """Monthly price of the tier in ``tier_id``; unknown tiers stay without a price."""
    tiers = tier_table(subscriptions.sparkSession).withColumn(
        "monthly_price_pence", F.col("tokens_per_month") * F.col("rate_pence")
    )
    return subscriptions.join(F.broadcast(tiers), "tier_id", "left")


def from_raw(raw: Column | str, header: Column | str) -> Column:
    """Non-blank cell of a header: exact name, then ignoring case, then ignoring punctuation."""
    return bound(_known_entries(F.map_entries(_col(raw))), lambda known: _from_known(known, _col(header)))


def _known_entries(entries: Column) -> Column:
    """The non-blank cells, with the forms of their headers that names are compared with."""
    filled = F.filter(entries, lambda e: has_text(e["value"]))
    return F.transform(
        filled,
        lambda e: F.struct(e["key"].alias("key"), F.lower(stripped(e["key"])).alias("lower"), label_key(e["key"]).alias("label"), e["value"].alias("value")),
    )


def _from_known(known: Column, name: Column) -> Column:
    def first(form: str, wanted: Column) -> Column:
        # The wanted form is made once, not once for each cell.
        return bound(wanted, lambda w: strip(F.get(F.filter(known, lambda e: e[form] == w), 0)["value"]))

    forms = (first("key", name), first("lower", F.lower(stripped(name))), first("label", label_key(name)))
    return F.when(has_text(name), F.coalesce(*forms))


def pick_from_raw(items: DataFrame, header: str, output: str) -> DataFrame:
    """Add the cell of a header (a column holding its name) as ``output``."""
    return items.withColumn(output, from_raw("raw", header))


def pick_amount_expr(total: Column, raw: Column, tokens: Column) -> Column:
    """Total if it is not zero, else the first non-zero amount among the tokens, else the total.

    A token is an amount itself or the name of a raw header.
    """

    def amount(known: Column, token: Column) -> Column:
        found = F.coalesce(amounts.marked_amount(token), bound(_from_known(known, token), amounts.marked_amount))
        return bound(found, lambda a: F.when(a != 0, a))

    # Bound, the raw cells are made once a row, not once for each token; tokens after the first amount are not looked up.
    named = bound(
        _known_entries(F.map_entries(raw)),
        lambda known: F.aggregate(tokens, F.lit(None).cast(amounts.AMOUNT_TYPE), lambda found, t: F.coalesce(found, amount(known, t))),
    )
    return bound(amounts.marked_amount(total), lambda own: F.coalesce(F.when(own != 0, own), named, own))


def pick_amount(items: DataFrame, total: str, tokens: str, raw: str = "raw") -> DataFrame:
    """Add ``amount`` for a document made from the row."""
    return items.withColumn("amount", pick_amount_expr(F.col(total), F.col(raw), F.col(tokens)))


def date_from_raw(raw: Column | str, field: str, template: str | None, mapped: Column | None = None) -> Column:
    """Date of a raw row: the mapped header first, then the first header named like the field."""
    synonyms = DATE_SYNONYMS.get(field, (field,))

    def is_synonym(key: Column) -> Column:
        name = label_key(key)
        hit = F.lit(False)
        for word in synonyms:
            hit = hit | name.contains(word)
        return hit

    parsed = F.transform(
        F.filter(F.map_entries(_col(raw)), lambda e: is_synonym(e["key"]) & has_text(e["value"])),
        lambda e: dates.loose_date(strip(e["value"]), template),
    )
    named = F.get(F.filter(parsed, lambda d: d.isNotNull()), 0)
    if mapped is None:
        return named
    return F.coalesce(dates.loose_date(from_raw(raw, mapped), template), named)


def pick_date_from_raw(
    items: DataFrame, field: str, output: str, template: str | None, mapped_header: str | None = None
) -> DataFrame:
    """Add the date of ``field`` found among the raw cells as ``output``."""
    mapped = F.col(mapped_header) if mapped_header else None
    return items.withColumn(output, date_from_raw("raw", field, template, mapped))


def statement_row_link(rows: DataFrame, credit_note_base: str, invoice_base: str) -> DataFrame:
    """Add ``link``: the credit note's page, else the invoice's, else ''."""
    return rows.withColumn(
        "link",
        F.when(has_text("credit_note_id"), F.concat(F.lit(credit_note_base), strip("credit_note_id")))
        .when(has_text("invoice_id"), F.concat(F.lit(invoice_base), strip("invoice_id")))
        .otherwise(""),
    )
