"""The whole reconciliation of all statements of all tenants as one plan."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from tallyweave.functions import dates
from tallyweave.operators import classification, comparison, flags, matching, shaping
from tallyweave.session import stored


def reconciled_rows(
    statements: DataFrame,
    items: DataFrame,
    docs: DataFrame,
    payments: DataFrame,
    item_status: DataFrame,
    templates: Iterable[str] | None = None,
) -> DataFrame:
    """Every statement row beside its ledger document: cells, type, match, flags, completion, state.

    ``docs`` carry ``doc_ord`` (see ``matching.matchable_docs``). ``templates`` are the date formats
    in use; looked up when not given.
    """
    templates = dates.templates_of(statements, "date_format") if templates is None else list(templates)
    rows = flags.flag_items(shaping.prepare_display(statements, items, templates))
    reachable = matching.contact_rows(docs, statements)
    keys = matching.row_keys(rows)
    matches = stored(matching.match_statements(rows, reachable, keys))
    paid = matching.payments_by_invoice_number(docs, payments)
    # Items are shuffled once, by statement. Joins come before the scores of words: Spark does not know how rows are dealt that come from Python.
    beside = comparison.attach_matches(comparison.attach_item_status(rows, item_status), matches)
    typed = classification.classify_items(beside, matches, paid, keys)
    compared = comparison.row_matches(comparison.compare_cells(comparison.ledger_cells(typed, templates)))
    return flags.row_state(compared)


def exact_reconciliation(
    statements: DataFrame, items: DataFrame, docs: DataFrame, item_status: DataFrame, templates: Iterable[str]
) -> DataFrame:
    """The same without containment matching and types: a single lazy plan of equi-joins."""
    templates = list(templates)
    rows = flags.flag_items(shaping.prepare_display(statements, items, templates))
    matches = matching.exact_matches(rows, docs)
    beside = comparison.ledger_cells(comparison.attach_matches(rows, matches), templates)
    compared = comparison.row_matches(comparison.compare_cells(beside))
    return flags.row_state(comparison.attach_item_status(compared, item_status))
