"""Column expressions for labels, identifiers and free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters removed at both ends of a cell.
BLANKS = " \t\n\r\f\x0b"

# Words that mark a row as a payment.
PAYMENT_WORDS = ("payment", "paid", "remittance", "receipt")

# Short labels of the three item types.
ITEM_TYPE_LABELS = {"credit_note": "CRN", "invoice": "INV", "payment": "PMT"}

# Fixed value: the shape of a document number inside a longer text.
DOCUMENT_NUMBER = r"(?i)([A-Z]{2,6}[- ]?\d{2,}(?:[-/]\d{1,4})?)"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    """Remove white space at both ends."""
    return F.btrim(_col(value), F.lit(BLANKS))


def stripped(value: Column | str) -> Column:
    """Like ``strip``, with '' for null."""
    return strip(F.coalesce(_col(value), F.lit("")))


def has_text(value: Column | str) -> Column:
    return stripped(value) != ""


def label_key(value: Column | str) -> Column:
    """Lower-case letters and digits only: 'Due Date' and 'due_date' agree."""
    return F.regexp_replace(F.lower(F.coalesce(_col(value), F.lit(""))), r"[^\p{L}\p{N}]", "")


def header_key(value: Column | str) -> Column:
    """Lower-case header with runs of white space collapsed."""
    return F.lower(strip(F.regexp_replace(F.coalesce(_col(value), F.lit("")), r"\s+", " ")))


def id_key(value: Column | str) -> Column:
    """Upper-case letters and digits only, for loose identifier matching."""
    return F.regexp_replace(F.upper(stripped(value)), r"[^\p{L}\p{N}]", "")


def plain_text(value: Column | str) -> Column:
    """Lower-case ASCII words separated by single spaces."""
    lowered = F.lower(F.coalesce(_col(value), F.lit("")))
    return F.trim(F.regexp_replace(lowered, r"[^a-z0-9]+", " "))


def words(value: Column | str) -> Column:
    """The words of ``plain_text`` as an array; empty for blank text."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(value), F.lit(""))), F.lit(r"[a-z0-9]+"), F.lit(0))


def upper_tokens(value: Column | str) -> Column:
    """Upper-case alphanumeric tokens."""
    return F.regexp_extract_all(F.upper(F.coalesce(_col(value), F.lit(""))), F.lit(r"[A-Z0-9]+"), F.lit(0))


def document_number(value: Column | str) -> Column:
    """First document-number-shaped piece of a text, without spaces; null if there is none."""
    found = F.regexp_extract(F.coalesce(_col(value), F.lit("")), DOCUMENT_NUMBER, 1)
    return F.when(found != "", F.replace(found, F.lit(" "), F.lit("")))


def is_payment_reference(value: Column | str) -> Column:
    return F.lower(F.coalesce(_col(value), F.lit(""))).rlike("|".join(PAYMENT_WORDS))


def item_type_label(value: Column | str) -> Column:
    kind = F.lower(stripped(value))
    label = F.upper(F.replace(kind, F.lit("_"), F.lit(" ")))
    for name, short in ITEM_TYPE_LABELS.items():
        label = F.when(kind == name, F.lit(short)).otherwise(label)
    return label


def unique_texts(values: Column | str) -> Column:
    """Trimmed, non-blank, first occurrence of each; order kept."""
    trimmed = F.transform(F.coalesce(_col(values), F.array().cast("array<string>")), strip)
    return F.array_distinct(F.filter(trimmed, lambda x: x.isNotNull() & (x != "")))


KEY_RULES = {
    "label": label_key,
    "header": header_key,
    "id": id_key,
    "compact": id_key,
    "text": plain_text,
    "tokens": upper_tokens,
    "document_number": document_number,
}
