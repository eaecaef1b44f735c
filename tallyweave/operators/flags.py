"""Row flags and the predicates that select rows, documents, uploads and statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.text import KEY_RULES, _col, has_text, is_payment_reference, stripped, unique_texts, words
from tallyweave.schemas import STATEMENT_KEYS

# Fixed value: the flag set on rows that are no transactions.
OUTLIER_FLAG = "ml-outlier"

# Flags that make a row an anomaly.
ANOMALY_FLAGS = ("ml-outlier", "invalid-date")

# Words that must all occur, in order of precedence; a rule's label is its words,
# except where a label is given.
KEYWORD_RULES = (
    (("brought", "forward"), "brought forward"),
    (("carried", "forward"), "carried forward"),
    (("balance", "forward"), "balance forward"),
    (("forward", "balance"), "forward balance"),
    (("balance", "b", "f"), "balance b/f"),
    (("balance", "c", "f"), "balance c/f"),
    (("balance", "bf"), "balance bf"),
    (("balance", "cf"), "balance cf"),
    (("closing", "balance"), "closing balance"),
    (("opening", "balance"), "opening balance"),
    (("previous", "balance"), "previous balance"),
    (("statement", "balance"), "statement balance"),
    (("statement", "total"), "statement total"),
    (("outstanding", "balance"), "outstanding balance"),
    (("ending", "balance"), "ending balance"),
    (("final", "balance"), "final balance"),
    (("amount", "due"), "amount due"),
    (("balance", "brought"), "balance brought"),
    (("balance", "carried"), "balance carried"),
    (("summary",), "summary"),
    (("balance",), "balance"),
)

# Marks of rows that must not become documents.
SKIP_MARKS = ("no match", "no-match", "nomatch", "balance forward")

# What the ledger offers for matching.
BILL_TYPE, CREDIT_TYPE = "ACCPAY", "ACCPAYCREDIT"
OPEN_BILL_STATUSES = ("DRAFT", "SUBMITTED", "AUTHORISED", "PAID")


def keyword_label(tokens: Column | str) -> Column:
    """Label of the first rule whose words all occur among the tokens; null if none does.

    'summary' and 'balance' alone only count in texts of up to three words, 'balance' moreover
    only without a number.
    """
    tokens = _col(tokens)
    short = F.size(tokens) <= 3
    extra = {
        ("summary",): short,
        ("balance",): short & ~F.exists(tokens, lambda t: t.rlike(r"^\d+$")),
    }
    hits = []
    for required, label in KEYWORD_RULES:
        hit = extra.get(required, F.lit(True))
        for word in required:
            hit = hit & F.array_contains(tokens, word)
        hits.append(F.when(hit, label))
    return F.coalesce(*hits)


def flag_items(items: DataFrame) -> DataFrame:
    """Add ``issues``, ``flag_details`` and the outlier flag to rows that look like no transaction."""
    # The words are columns of their own, so that each text is split once.
    items = items.withColumns({"number_words": words("number"), "reference_words": words("reference")})
    items = items.withColumns(
        {"number_word": keyword_label("number_words"), "reference_word": keyword_label("reference_words")}
    )
    number_word, reference_word = F.col("number_word"), F.col("reference_word")

    def detail(field: str, issue: str, keyword: Column | None, value: Column | None) -> Column:
        null = F.lit(None).cast("string")
        return F.struct(
            F.lit(field).alias("field"),
            F.lit(issue).alias("issue"),
            (null if keyword is None else keyword).alias("keyword"),
            (null if value is None else value).alias("value"),
        )

    found = F.array(
        F.when(
            ~has_text("number"),
            F.struct(F.lit("missing-number").alias("name"), detail("number", "missing", None, None).alias("detail")),
        ).when(
            number_word.isNotNull(),
            F.struct(
                F.lit("keyword-number").alias("name"),
                detail("number", "keyword", number_word, F.col("number")).alias("detail"),
            ),
        ),
        F.when(
            has_text("reference") & reference_word.isNotNull(),
            F.struct(
                F.lit("keyword-reference").alias("name"),
                detail("reference", "keyword", reference_word, F.col("reference")).alias("detail"),
            ),
        ),
    )
    flagged = items.withColumn("found", F.filter(found, lambda f: f.isNotNull()))
    old = F.coalesce("flags", F.array().cast("array<string>")) if "flags" in items.columns else F.array().cast("array<string>")
    marked = F.when(
        (F.size("found") > 0) & ~F.array_contains(old, OUTLIER_FLAG), F.array_append(old, F.lit(OUTLIER_FLAG))
    ).otherwise(old)
    return flagged.withColumns(
        {
            "issues": F.transform("found", lambda f: f["name"]),
            "flag_details": F.transform("found", lambda f: f["detail"]),
            "flags": marked,
        }
    ).drop("found", "number_words", "reference_words", "number_word", "reference_word")


def drop_flagged(items: DataFrame) -> DataFrame:
    """Remove the rows ``flag_items`` would flag."""
    return flag_items(items).where(F.size("issues") == 0)


def flag_summary(items: DataFrame) -> DataFrame:
    """Rows, flagged rows and rows per issue, per statement (on the result of ``flag_items``)."""
    return items.groupBy(*STATEMENT_KEYS).agg(
        F.count("*").alias("total"),
        F.count_if(F.size("issues") > 0).alias("flagged"),
        *[
            F.count_if(F.array_contains("issues", issue)).alias(issue.replace("-", "_"))
            for issue in ("missing-number", "keyword-number", "keyword-reference")
        ],
    )


def unique_flags(items: DataFrame, column: str = "flags") -> DataFrame:
    return items.withColumn(column, unique_texts(column))


def payment_references(items: DataFrame, column: str) -> DataFrame:
    return items.where(is_payment_reference(column))


def active_contacts(contacts: DataFrame) -> DataFrame:
    """Active contacts by name, ignoring case."""
    return contacts.where(F.upper(stripped("contact_status")) == "ACTIVE").orderBy(F.lower(F.coalesce("name", F.lit(""))))


def eligible_ledger_docs(docs: DataFrame, modified_since=None) -> DataFrame:
    """Bills in a live status and all supplier credit notes, optionally changed since a time."""
    wanted = (
        (F.col("doc_kind") == "invoice") & (F.col("type") == BILL_TYPE) & F.col("status").isin(*OPEN_BILL_STATUSES)
    ) | ((F.col("doc_kind") == "credit_note") & (F.col("type") == CREDIT_TYPE))
    if modified_since is not None:
        wanted = wanted & (F.col("updated_at") >= F.lit(modified_since))
    return docs.where(wanted)


def item_view(rows: DataFrame, view: str | None = "incomplete", show_payments: bool = True) -> DataFrame:
    """Rows of one tab; an unknown view means the incomplete rows."""
    view = (view or "incomplete").strip().lower()
    if view == "completed":
        rows = rows.where("is_completed")
    elif view != "all":
        rows = rows.where(~F.col("is_completed"))
    if not show_payments:
        rows = rows.where(~F.col("item_type").eqNullSafe(F.lit("payment")))
    return rows


def statements_by_completion(headers: DataFrame, completed: bool) -> DataFrame:
    """Statement headers (not other record types) with the given completion."""
    return headers.where(
        (F.coalesce("record_type", F.lit("statement")) == "statement") & (F.col("completed") == F.lit(completed))
    )


def row_text(reference: Column, raw: Column) -> Column:
    """Reference and first non-blank description of a row, normalised for word search."""
    described = F.coalesce(
        *[F.when(has_text(F.try_element_at(raw, F.lit(k))), F.try_element_at(raw, F.lit(k))) for k in ("Description", "description")]
    )
    return KEY_RULES["header"](F.concat_ws(" ", F.when(F.coalesce(reference, F.lit("")) != "", reference), described))


def is_non_document(reference: Column, raw: Column) -> Column:
    return row_text(reference, raw).rlike("|".join(SKIP_MARKS))


def skip_non_documents(items: DataFrame) -> DataFrame:
    """Rows that may become documents."""
    return items.where(~is_non_document(F.col("reference"), F.col("raw")))


def row_state(rows: DataFrame) -> DataFrame:
    """Add ``state``: anomaly before match before mismatch."""
    odd = F.arrays_overlap(unique_texts("flags"), F.array(*[F.lit(f) for f in ANOMALY_FLAGS]))
    return rows.withColumn(
        "state", F.when(F.coalesce(odd, F.lit(False)), "anomaly").when(F.col("row_match"), "match").otherwise("mismatch")
    )


def valid_uploads(uploads: DataFrame, contact_lookup: DataFrame) -> DataFrame:
    """Add ``contact_id`` and ``reject_reason`` (null for uploads that can go on).

    ``contact_lookup`` has one row per tenant and contact name (see ``resolve_contacts``).
    """
    named = uploads.withColumn("contact_name", stripped("contact_name")).withColumn(
        "filename", F.coalesce(F.when(has_text("filename"), F.col("filename")), F.lit("Unnamed PDF"))
    )
    joined = named.join(
        contact_lookup.select("tenant_id", F.col("name").alias("contact_name"), "contact_id"), ["tenant_id", "contact_name"], "left"
    )
    return joined.withColumn(
        "reject_reason",
        F.when(F.col("contact_name") == "", F.concat(F.lit("Please select a contact for '"), "filename", F.lit("'.")))
        .when(F.col("file_error").isNotNull(), F.concat("filename", F.lit(": "), "file_error"))
        .when(
            F.col("contact_id").isNull(),
            F.concat(
                F.lit("Contact '"), "contact_name", F.lit("' was not recognised. Please select a contact from the list.")
            ),
        ),
    )
