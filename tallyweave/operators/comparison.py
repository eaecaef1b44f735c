"""Ledger values beside statement values, cell by cell, and the summary of the outcome."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import amounts, dates
from tallyweave.functions.arrays import unfold
from tallyweave.functions.text import id_key, item_type_label, stripped
from tallyweave.schemas import ITEM_KEYS, STATEMENT_KEYS

_MATCH_FIELDS = ["doc_id", "doc_kind", "type", "date", "due_date", "reference", "total", "matched_number", "match_type"]


def attach_matches(rows: DataFrame, matches: DataFrame) -> DataFrame:
    """Add ``match``, the matched document of the row's key; null where there is none."""
    found = matches.select(*STATEMENT_KEYS, "row_key", F.struct(*_MATCH_FIELDS).alias("match"))
    return rows.join(found, [*STATEMENT_KEYS, "row_key"], "left")


def ledger_cells(rows: DataFrame, templates: Iterable[str]) -> DataFrame:
    """Add ``ledger``, the document's value for every cell shown.

    Amounts appear only where the statement has one, and a statement zero stays zero. Dates follow
    the statement's format. The document's texts are made once per row, the cells only pick.
    """
    blank = F.lit("")
    date_format, templates = F.col("date_format"), list(templates)
    texts = {
        "total": amounts.format_amount(F.col("match.total")),
        "date": dates.render_by_template(F.col("match.date"), date_format, templates),
        "due_date": dates.render_by_template(F.col("match.due_date"), date_format, templates),
        "number": F.col("match.matched_number"),
        "reference": F.col("match.reference"),
    }
    rows = rows.withColumn("doc_text", F.struct(*[F.coalesce(t, blank).alias(f) for f, t in texts.items()]))

    def pick(cell: Column) -> Column:
        total = F.when(stripped(cell["value"]) == "", blank).otherwise(
            F.when(amounts.display_amount(cell["value"]) == 0, "0.00").otherwise(F.col("doc_text.total"))
        )
        out = F.when(cell["field"] == "total", total)
        for field in texts:
            if field != "total":
                out = out.when(cell["field"] == field, F.col(f"doc_text.{field}"))
        return out.otherwise(blank)

    return rows.withColumn("ledger", F.transform("cells", pick)).drop("doc_text")


def texts_equal(left: Column, right: Column) -> Column:
    """Equal as numbers if either side reads as one, else as trimmed text ignoring case."""
    a, b = amounts.compare_amount(left), amounts.compare_amount(right)
    as_text = F.lower(stripped(left)) == F.lower(stripped(right))
    return F.when(a.eqNullSafe(b), as_text | a.isNotNull()).otherwise(False)


def ids_agree(left: Column, right: Column) -> Column:
    """Normalised ids are both present and one contains the other."""
    a, b = id_key(left), id_key(right)
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a))


def compare_cells(rows: DataFrame) -> DataFrame:
    """Add ``comparisons``: both values of every cell and whether they agree."""

    def compare(cell: Column, i: Column) -> Column:
        right = F.get("ledger", i)
        return F.struct(
            cell["header"].alias("header"),
            cell["field"].alias("canonical_field"),
            cell["value"].alias("statement_value"),
            right.alias("ledger_value"),
            F.when(cell["field"] == "number", ids_agree(cell["value"], right))
            .otherwise(texts_equal(cell["value"], right))
            .alias("matches"),
        )

    return rows.withColumn("comparisons", F.transform("cells", compare))


def explode_comparisons(rows: DataFrame) -> DataFrame:
    """The long form of ``comparisons``."""
    return unfold(rows, ITEM_KEYS, "comparisons", "c", "header_pos").select(*ITEM_KEYS, "header_pos", "c.*")


def row_matches(rows: DataFrame) -> DataFrame:
    """Add ``row_match``: the row's key has a match; without a key column, all cells agree."""
    return rows.withColumn(
        "row_match",
        F.when(F.col("number_header").isNotNull(), F.col("match").isNotNull()).otherwise(
            F.forall("comparisons", lambda c: c["matches"])
        ),
    )


def attach_item_status(items: DataFrame, item_status: DataFrame) -> DataFrame:
    """Add ``is_completed`` by item id; false where nothing is recorded.

    An item id starts with its statement's id, so the join is by statement as well and the items
    need not be shuffled anew.
    """
    recorded = (
        item_status.withColumn("statement_id", F.substring_index("statement_item_id", "#item-", 1))
        .groupBy("tenant_id", "statement_id", "statement_item_id")
        .agg(F.bool_or("completed").alias("is_completed"))
    )
    return items.join(recorded, ["tenant_id", "statement_id", "statement_item_id"], "left").withColumn(
        "is_completed", F.coalesce("is_completed", F.lit(False))
    )


def replace_items(existing: DataFrame, headers: DataFrame, incoming: DataFrame) -> DataFrame:
    """All item rows after the statements in ``incoming`` were extracted again.

    Their old rows go. An id that was there keeps its completion, a new one takes the statement's;
    incoming rows without an id are dropped.
    """
    kept = existing.join(incoming.select(*STATEMENT_KEYS).distinct(), STATEMENT_KEYS, "left_anti")
    before = existing.groupBy("tenant_id", "statement_item_id").agg(F.bool_or("completed").alias("before"))
    whole = headers.select(*STATEMENT_KEYS, F.col("completed").alias("whole"))
    fresh = (
        incoming.where(F.coalesce("statement_item_id", F.lit("")) != "")
        .drop("completed")
        .join(before, ["tenant_id", "statement_item_id"], "left")
        .join(whole, STATEMENT_KEYS, "left")
        .withColumn("completed", F.coalesce("before", "whole", F.lit(False)))
    )
    return kept.unionByName(fresh.select(*kept.columns), allowMissingColumns=True)


def completion_counts(rows: DataFrame) -> DataFrame:
    """Completed and open rows per statement, and whether it has payments."""
    return rows.groupBy(*STATEMENT_KEYS).agg(
        F.count_if("is_completed").alias("completed_count"),
        F.count_if(~F.col("is_completed")).alias("incomplete_count"),
        F.coalesce(F.bool_or(F.col("item_type") == "payment"), F.lit(False)).alias("has_payment_rows"),
    )


def reconciliation_summary(rows: DataFrame, by: Sequence[str] = ("tenant_id", "contact_id"), more: Sequence[Column] = ()) -> DataFrame:
    """Rows per group in each of the six states: match, mismatch, anomaly; open or completed. ``more`` are further aggregates."""
    done = F.col("is_completed")
    return rows.groupBy(*by).agg(
        F.count("*").alias("rows"),
        *[
            F.count_if((F.col("state") == state) & flag).alias(name)
            for state in ("match", "mismatch", "anomaly")
            for flag, name in ((~done, state), (done, f"{state}_completed"))
        ],
        *more,
    )


def export_lines(rows: DataFrame) -> DataFrame:
    """Flat export: per statement a heading line and one line per item, as arrays of texts.

    Columns are the type, the statement's cells, the ledger's cells, a link mark and the completion.
    Statements differ in their columns, so a line is an array in column order; writing them by
    ``sources.export`` needs no pivot over all headers there are.
    """

    def label(header: Column) -> Column:
        text = stripped(F.replace(header, F.lit("_"), F.lit(" ")))
        return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))

    def prefixed(prefix: str) -> Column:
        return F.transform("comparisons", lambda c: F.concat(F.lit(prefix), label(c["header"])))

    heading = F.concat(
        F.array(F.lit("Type")), prefixed("Statement "), prefixed("Ledger "), F.array(F.lit("Ledger Link"), F.lit("Status"))
    )
    line = F.concat(
        F.array(item_type_label("item_type")),
        F.transform("comparisons", lambda c: c["statement_value"]),
        F.transform("comparisons", lambda c: c["ledger_value"]),
        F.array(
            F.when(F.coalesce(F.col("match.doc_id"), F.lit("")) != "", "Link").otherwise(""),
            F.when(F.coalesce("statement_item_id", F.lit("")) == "", "")
            .when(F.col("is_completed"), "Completed")
            .otherwise("Incomplete"),
        ),
    )
    lines = rows.select(*ITEM_KEYS, line.alias("line"))
    headings = rows.groupBy(*STATEMENT_KEYS).agg(F.min_by(heading, "item_seq").alias("line"))
    return headings.select(*STATEMENT_KEYS, F.lit(0).alias("item_seq"), "line").unionByName(lines)
