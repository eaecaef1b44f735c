"""Flags, predicates, matching, comparison and classification."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.derive import DATE_FORMATS, with_tables
from checks.queries_shaping import CELLS
from checks.registry import compare_sql, decimal_sql, format_money_sql, id_key_sql, iso, money, money_sql, query
from checks.similarity import GUESSES, token_scores_sql
from tallyweave.operators import classification, comparison, flags, ledger, matching, shaping
from tallyweave.plans import reconcile
from tallyweave.session import checkpoint_folder, stored
from tallyweave.sources import export

ITEMS = ("items_flat", "ledger_docs")


def keyword_sql(column: str) -> str:
    """The keyword rules in SQL, over the words of a column."""
    words = f"string_split(trim(regexp_replace(lower({column}), '[^a-z0-9]+', ' ', 'g')), ' ')"
    cases = []
    for required, label in flags.KEYWORD_RULES:
        test = " AND ".join(f"list_contains(w, '{word}')" for word in required)
        if required == ("summary",):
            test += " AND len(w) <= 3"
        if required == ("balance",):
            test += " AND len(w) <= 3 AND NOT regexp_matches(array_to_string(w, ' '), '(^| )\\d+( |$)')"
        cases.append(f"WHEN {test} THEN '{label}'")
    return f"(SELECT CASE {' '.join(cases)} END FROM (SELECT {words} AS w) x)"


FLAGGED = f"""SELECT *, CASE WHEN trim(number) = '' THEN 'missing-number' WHEN nk IS NOT NULL THEN 'keyword-number' END AS i1,
  CASE WHEN trim(reference) <> '' AND rk IS NOT NULL THEN 'keyword-reference' END AS i2
  FROM (SELECT *, {keyword_sql("number")} AS nk, {keyword_sql("reference")} AS rk FROM items_flat) a"""


@query(
    "flagged_items",
    with_tables(
        ("items_flat",),
        f"SELECT k, concat_ws(',', i1, i2) AS issues, coalesce(CASE WHEN i2 IS NOT NULL THEN rk END, nk) AS keyword, CASE WHEN i1 IS NOT NULL OR i2 IS NOT NULL THEN 'ml-outlier' ELSE '' END AS flags FROM ({FLAGGED}) f",
    ),
)
def flagged_items(t):
    out = flags.flag_items(t.items())
    return out.select(
        "k",
        F.array_join("issues", ",").alias("issues"),
        F.try_element_at(F.filter(F.transform("flag_details", lambda d: d["keyword"]), lambda x: x.isNotNull()), F.lit(-1)).alias("keyword"),
        F.array_join("flags", ",").alias("flags"),
    )


@query(
    "keyword_labels_of_texts",
    f"""SELECT p_partkey, {keyword_sql("txt")} AS label FROM (SELECT p_partkey, CASE p_partkey % 12 WHEN 0 THEN 'Balance b/f' WHEN 1 THEN 'FORWARD balance 12' WHEN 2 THEN 'Balance' WHEN 3 THEN 'Balance 2024'
        WHEN 4 THEN 'summary of all the rows' WHEN 5 THEN 'Summary:' WHEN 6 THEN 'Amount due ' || p_name WHEN 7 THEN 'balance of account today' WHEN 8 THEN 'Statement-total' WHEN 9 THEN 'carried  forward' ELSE p_name END AS txt FROM part) q""",
)
def keyword_labels_of_texts(t):
    given = ["Balance b/f", "FORWARD balance 12", "Balance", "Balance 2024", "summary of all the rows", "Summary:", None, "balance of account today", "Statement-total", "carried  forward"]
    text = F.col("p_name")
    for i, value in enumerate(given):
        text = F.when(F.col("p_partkey") % 12 == i, F.lit(value) if value else F.concat(F.lit("Amount due "), "p_name")).otherwise(text)
    from tallyweave.functions.text import words

    return t.base("part").select("p_partkey", flags.keyword_label(words(text)).alias("label"))


@query("unflagged_items", with_tables(("items_flat",), f"SELECT k FROM ({FLAGGED}) f WHERE i1 IS NULL AND i2 IS NULL"))
def unflagged_items(t):
    return flags.drop_flagged(t.items()).select("k")


@query(
    "flag_summaries",
    with_tables(
        ("items_flat",),
        f"""SELECT statement_id, count(*) AS total, count(coalesce(i1, i2)) AS flagged, count(CASE WHEN i1 = 'missing-number' THEN 1 END) AS missing_number,
            count(CASE WHEN i1 = 'keyword-number' THEN 1 END) AS keyword_number, count(i2) AS keyword_reference FROM ({FLAGGED}) f GROUP BY statement_id""",
    ),
)
def flag_summaries(t):
    return flags.flag_summary(flags.flag_items(t.items())).drop("tenant_id")


@query(
    "unique_flags",
    "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type || ',ml-outlier' ELSE event_type END AS flags FROM events",
)
def unique_flags(t):
    marks = F.array(
        F.concat(F.lit(" "), "event_type"), F.lit("  "), F.when(F.col("event_id") % 2 == 0, "ml-outlier "), F.col("event_type"), F.when(F.col("event_id") % 2 == 0, "ml-outlier")
    )
    out = flags.unique_flags(t.base("events").withColumn("flags", marks))
    return out.select("event_id", F.array_join("flags", ",").alias("flags"))


@query(
    "payment_references",
    with_tables(("items_flat",), "SELECT k FROM items_flat WHERE regexp_matches(lower(description || number_text), 'payment|paid|remittance|receipt')"),
)
def payment_references(t):
    return flags.payment_references(t.items().withColumn("txt", F.concat("description", "number_text")), "txt").select("k")


@query("active_contacts", with_tables(("contacts",), "SELECT tenant_id, contact_id, name FROM contacts WHERE upper(trim(contact_status)) = 'ACTIVE'"))
def active_contacts(t):
    return flags.active_contacts(t.derive("contacts")).select("tenant_id", "contact_id", "name")


@query(
    "eligible_ledger_docs",
    with_tables(
        ("ledger_docs",),
        """SELECT doc_id, doc_kind, status FROM ledger_docs WHERE ((doc_kind = 'invoice' AND type = 'ACCPAY' AND status IN ('DRAFT', 'SUBMITTED', 'AUTHORISED', 'PAID')) OR (doc_kind = 'credit_note' AND type = 'ACCPAYCREDIT'))
           AND updated_at >= TIMESTAMP '1996-06-01'""",
    ),
)
def eligible_ledger_docs(t):
    import datetime

    return flags.eligible_ledger_docs(t.docs(), datetime.datetime(1996, 6, 1)).select("doc_id", "doc_kind", "status")


@query(
    "item_views",
    with_tables(
        ("items_flat",),
        """SELECT 'incomplete' AS tab, k FROM items_flat WHERE k % 3 <> 0 UNION ALL SELECT 'completed-no-payments', k FROM items_flat WHERE k % 3 = 0 AND k % 10 <> 8
           UNION ALL SELECT 'unknown', k FROM items_flat WHERE k % 3 <> 0 UNION ALL SELECT 'all', k FROM items_flat""",
    ),
)
def item_views(t):
    rows = t.derive("items_flat").select(
        "k", (F.col("k") % 3 == 0).alias("is_completed"), F.when(F.col("k") % 10 == 8, "payment").when(F.col("k") % 10 == 1, "invoice").alias("item_type")
    )
    tabs = [("incomplete", "incomplete", True), ("completed-no-payments", " Completed", False), ("unknown", "whatever", True), ("all", "ALL", True)]
    parts = [flags.item_view(rows, view, pay).select(F.lit(tab).alias("tab"), "k") for tab, view, pay in tabs]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    "statements_by_completion",
    with_tables(("headers",), "SELECT statement_id FROM headers WHERE coalesce(record_type, 'statement') = 'statement' AND completed"),
)
def statements_by_completion(t):
    return flags.statements_by_completion(t.headers(), True).select("statement_id")


@query(
    "document_rows",
    with_tables(
        ("items_flat",),
        "SELECT k FROM items_flat WHERE NOT regexp_matches(lower(regexp_replace(CASE WHEN reference <> '' THEN reference || ' ' ELSE '' END || description, '\\s+', ' ', 'g')), 'no match|no-match|nomatch|balance forward')",
    ),
)
def document_rows(t):
    described = t.items().withColumn("raw", F.map_concat("raw", F.create_map(F.lit("Description"), F.col("description"))))
    return flags.skip_non_documents(described).select("k")


_LOOKUP = "SELECT tenant_id, name, arg_max(contact_id, load_seq) AS contact_id FROM contacts WHERE upper(trim(contact_status)) = 'ACTIVE' GROUP BY tenant_id, name"


@query("contact_lookup", with_tables(("contacts",), _LOOKUP))
def contact_lookup(t):
    from tallyweave.operators import tokens

    return tokens.resolve_contacts(t.derive("contacts"))


@query(
    "valid_uploads",
    with_tables(
        ("uploads", "contacts"),
        f"""SELECT k, l.contact_id, CASE WHEN trim(u.contact_name) = '' THEN 'Please select a contact for ''' || f || '''.' WHEN file_error IS NOT NULL THEN f || ': ' || file_error
            WHEN l.contact_id IS NULL THEN 'Contact ''' || trim(u.contact_name) || ''' was not recognised. Please select a contact from the list.' END AS reject_reason
            FROM (SELECT *, CASE WHEN filename = '' THEN 'Unnamed PDF' ELSE filename END AS f FROM uploads) u LEFT JOIN ({_LOOKUP}) l ON l.tenant_id = u.tenant_id AND l.name = trim(u.contact_name)""",
    ),
)
def valid_uploads(t):
    return flags.valid_uploads(t.derive("uploads"), contact_lookup(t)).select("k", "contact_id", "reject_reason")


# --- matching ----------------------------------------------------------------------------------


def _docs(t):
    docs = t.docs()
    return matching.matchable_docs(docs.where("doc_kind = 'invoice'"), docs.where("doc_kind = 'credit_note'"))


def _rows(t):
    return shaping.prepare_display(t.statements(), t.items(), DATE_FORMATS)


def _keys_and_docs(t):
    """The rows' keys written once, as ``match_statements`` does, with the documents and exact matches."""
    checkpoint_folder(t.spark)
    keys, docs = _rows(t).select("tenant_id", "statement_id", "contact_id", "item_seq", "row_key").checkpoint(), _docs(t)
    return keys, docs, matching.exact_matches(keys, docs).checkpoint()


EXACT = """SELECT i.statement_id, i.k, i.contact_id, trim(number_text) AS row_key, d.doc_id, d.doc_kind, d.number FROM items_flat i JOIN ledger_docs d ON d.contact_id = i.contact_id AND d.number = trim(number_text) WHERE trim(number_text) <> ''"""
OPEN = f"SELECT i.* FROM items_flat i WHERE trim(number_text) <> '' AND NOT EXISTS (SELECT 1 FROM ({EXACT}) e WHERE e.statement_id = i.statement_id AND e.row_key = trim(i.number_text))"
PAIRS = f"""SELECT o.statement_id, o.k AS item_seq, d.number, d.doc_id, length(did) AS id_length, d.doc_kind, d.load_seq FROM (SELECT *, {id_key_sql("number_text")} AS iid FROM ({OPEN}) a WHERE NOT regexp_matches(lower(number_text), 'payment|paid|remittance|receipt')) o
  JOIN (SELECT *, {id_key_sql("number")} AS did FROM ledger_docs) d ON d.contact_id = o.contact_id AND (contains(iid, did) OR contains(did, iid)) WHERE iid <> '' AND did <> ''
  AND NOT EXISTS (SELECT 1 FROM ({EXACT}) e WHERE e.statement_id = o.statement_id AND e.doc_id = d.doc_id)"""


@query("matchable_docs", with_tables(("ledger_docs",), "SELECT doc_id, CASE WHEN doc_kind = 'credit_note' THEN 1 ELSE 0 END AS kind, load_seq AS seq FROM ledger_docs"))
def matchable_docs(t):
    return _docs(t).select("doc_id", "doc_ord.kind", "doc_ord.seq")


@query("exact_matches", with_tables(ITEMS, f"SELECT statement_id, row_key, k AS item_seq, doc_id, doc_kind FROM ({EXACT}) e"))
def exact_matches(t):
    return matching.exact_matches(_rows(t), _docs(t)).select("statement_id", "row_key", "item_seq", "doc_id", "doc_kind")


@query(
    "exact_matches_with_duplicates",
    with_tables(
        ("items_flat", "ledger_docs"),
        """SELECT i.statement_id, i.key AS row_key, i.k AS item_seq, d.doc_id FROM (SELECT statement_id, contact_id, CAST(k % 5 AS VARCHAR) AS key, max(k) AS k FROM items_flat GROUP BY 1, 2, 3) i
           JOIN (SELECT contact_id, CAST(load_seq % 5 AS VARCHAR) AS key, arg_min(doc_id, CASE WHEN doc_kind = 'credit_note' THEN 1000000000000 ELSE 0 END + load_seq) AS doc_id FROM ledger_docs GROUP BY 1, 2) d USING (contact_id, key)""",
    ),
)
def exact_matches_with_duplicates(t):
    rows = t.items().withColumn("row_key", (F.col("k") % 5).cast("string"))
    docs = _docs(t).withColumn("number", F.concat(F.lit(" "), (F.col("load_seq") % 5).cast("string")))
    return matching.exact_matches(rows, docs).select("statement_id", "row_key", "item_seq", "doc_id")


@query("unmatched_numbers", with_tables(ITEMS, f"SELECT k FROM ({OPEN}) o"))
def unmatched_numbers(t):
    rows = _rows(t)
    return matching.unmatched_numbers(rows, matching.exact_matches(rows, _docs(t))).select("k")


@query(
    "ledger_only_documents",
    with_tables(ITEMS, f"SELECT doc_id FROM ledger_docs d WHERE NOT EXISTS (SELECT 1 FROM ({EXACT}) e WHERE e.doc_id = d.doc_id)"),
)
def ledger_only_documents(t):
    docs = _docs(t)
    return matching.ledger_only_documents(docs, matching.exact_matches(_rows(t), docs)).select("doc_id")


@query(
    "unused_documents",
    with_tables(
        (*ITEMS, "statements_flat"),
        f"""SELECT t.sid AS statement_id, d.doc_id FROM (SELECT statement_id, contact_id, half, CASE WHEN half = 0 THEN statement_id ELSE statement_id || 'b' END AS sid FROM statements_flat, (VALUES (0), (1)) h(half)) t JOIN ledger_docs d ON d.contact_id = t.contact_id
            WHERE NOT EXISTS (SELECT 1 FROM ({EXACT}) e WHERE e.statement_id = t.statement_id AND e.doc_id = d.doc_id AND e.k % 2 = t.half)""",
    ),
)
def unused_documents(t):
    """Every statement as two of the same contact, each with half of the rows: what one uses stays free for the other."""
    docs, matches = _docs(t), matching.exact_matches(_rows(t), _docs(t))
    second = F.concat("statement_id", F.lit("b"))
    matches = matches.withColumn("statement_id", F.when(F.col("item_seq") % 2 == 1, second).otherwise(F.col("statement_id")))
    statements = t.derive("statements_flat").select("tenant_id", "statement_id", "contact_id")
    both = statements.unionByName(statements.withColumn("statement_id", second))
    return matching.unused_docs(docs, matches, both).select("statement_id", "doc_id")


@query("substring_candidates", with_tables(ITEMS, f"SELECT statement_id, item_seq, number AS matched_number, doc_id, id_length FROM ({PAIRS}) p"))
def substring_candidates(t):
    found = matching.substring_candidates(*_keys_and_docs(t))
    return found.select("statement_id", "item_seq", "matched_number", "doc_id", "id_length")


@query(
    "best_candidates",
    with_tables(
        ITEMS,
        f"""SELECT statement_id, item_seq, number AS matched_number, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY statement_id, item_seq ORDER BY id_length DESC, CASE WHEN doc_kind = 'credit_note' THEN 1 ELSE 0 END, load_seq) AS rn
            FROM ({PAIRS}) p) q WHERE rn = 1""",
    ),
)
def best_candidates(t):
    found = matching.substring_candidates(*_keys_and_docs(t))
    return matching.best_candidate(found).select("statement_id", "item_seq", "matched_number", "doc_id")


# Short keys that many documents contain, and that rows repeat: rows compete, and what one takes the next ones miss.
_RIVAL_KEY = "CASE WHEN k % 4 = 0 THEN CAST(k % 1000 AS STRING) ELSE CAST(k % 10 AS STRING) END"
RESOLVED = f"""SELECT statement_id, row_key, arg_max(number, item_seq) AS matched_number, 'substring' AS match_type FROM (
  WITH RECURSIVE asking AS (SELECT statement_id, contact_id, k AS item_seq, {_RIVAL_KEY} AS row_key FROM items_flat),
  listed AS (SELECT a.statement_id, a.item_seq, a.row_key, list(d.number ORDER BY length(d.did) DESC, CASE WHEN doc_kind = 'credit_note' THEN 1 ELSE 0 END, load_seq) AS numbers
    FROM asking a JOIN (SELECT *, {id_key_sql("number")} AS did FROM ledger_docs) d ON d.contact_id = a.contact_id AND contains(d.did, a.row_key) GROUP BY ALL),
  turns AS (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY item_seq) AS n FROM listed),
  walk AS (SELECT DISTINCT statement_id, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS BIGINT) AS item_seq, CAST(NULL AS VARCHAR) AS row_key, CAST(NULL AS VARCHAR) AS number FROM turns
    UNION ALL SELECT statement_id, n, CASE WHEN number IS NULL THEN used ELSE list_append(used, number) END, item_seq, row_key, number FROM (
      SELECT t.statement_id, t.n, w.used, t.item_seq, t.row_key, list_filter(t.numbers, lambda x: NOT list_contains(w.used, x))[1] AS number
      FROM walk w JOIN turns t ON t.statement_id = w.statement_id AND t.n = w.n + 1) s)
  SELECT * FROM walk WHERE number IS NOT NULL) taken GROUP BY statement_id, row_key"""


@query("resolved_matches", with_tables(("items_flat", "ledger_docs"), RESOLVED))
def resolved_matches(t):
    rows = t.derive("items_flat").select("tenant_id", "statement_id", "contact_id", F.col("k").alias("item_seq"), F.expr(_RIVAL_KEY).alias("row_key"))
    docs = _docs(t)
    exact = stored(matching.exact_matches(rows, docs))
    asking = stored(matching.open_rows(rows, exact))
    resolved = matching.resolve_matches(asking, matching.id_candidates(asking, docs, exact, ()), docs)
    return resolved.select("statement_id", "row_key", "matched_number", "match_type")


# Every row of these statements has its own document, so containment matching has one outcome.
MATCHED = f"""SELECT statement_id, row_key, doc_id, 'exact' AS match_type FROM ({EXACT}) e UNION ALL
  SELECT statement_id, trim(o.number_text), p.doc_id, 'substring' FROM ({PAIRS}) p JOIN ({OPEN}) o USING (statement_id, item_seq)"""


@query("matched_statements", with_tables(ITEMS, MATCHED))
def matched_statements(t):
    return matching.match_statements(_rows(t), _docs(t)).select("statement_id", "row_key", "doc_id", "match_type")


@query(
    "document_types",
    with_tables(("ledger_docs",), "SELECT doc_id, CASE WHEN doc_kind = 'credit_note' OR type LIKE '%CREDIT' THEN 'credit_note' ELSE 'invoice' END AS doc_type FROM ledger_docs"),
)
def document_types(t):
    return matching.doc_type_of_match(t.derive("ledger_docs")).select("doc_id", "doc_type")


PAID = "SELECT p.payment_id, d.number AS invoice_number, p.amount, p.contact_id FROM payments p JOIN ledger_docs d ON d.doc_id = p.invoice_id AND d.doc_kind = 'invoice'"


@query("payments_by_number", with_tables(("payments", "ledger_docs"), f"SELECT payment_id, invoice_number, {money_sql('amount')} AS amount FROM ({PAID}) p"))
def payments_by_number(t):
    paid = matching.payments_by_invoice_number(t.derive("ledger_docs"), t.derive("payments"))
    return paid.select("payment_id", "invoice_number", money("amount").alias("amount"))


@query(
    "reachable_documents",
    with_tables(("ledger_docs", "contacts"), "SELECT doc_id FROM ledger_docs WHERE contact_id IN (SELECT contact_id FROM contacts WHERE upper(contact_status) = 'ACTIVE')"),
)
def reachable_documents(t):
    return matching.contact_rows(t.derive("ledger_docs"), flags.active_contacts(t.derive("contacts"))).select("doc_id")


# --- comparison --------------------------------------------------------------------------------


def _beside(t):
    rows, docs = _rows(t), _docs(t)
    return comparison.compare_cells(
        comparison.ledger_cells(comparison.attach_matches(rows, matching.exact_matches(rows, docs)), DATE_FORMATS)
    )


def _day_sql(column: str) -> str:
    return f"""CASE date_format WHEN 'DD/MM/YYYY' THEN strftime({column}, '%d/%m/%Y') WHEN 'YYYY-MM-DD' THEN strftime({column}, '%Y-%m-%d') WHEN 'D MMM YYYY' THEN strftime({column}, '%-d %b %Y') ELSE strftime({column}, '%m/%d/%Y') END"""


LEDGER_CELLS = f"""SELECT c.*, coalesce(CASE c.field WHEN 'total' THEN CASE WHEN trim(value) = '' THEN '' WHEN {decimal_sql("value")} = 0 THEN '0.00' ELSE {format_money_sql("d.total")} END
  WHEN 'date' THEN {_day_sql("d.date")} WHEN 'due_date' THEN {_day_sql("d.due_date")} WHEN 'number' THEN d.number WHEN 'reference' THEN d.reference END, '') AS ledger_value
  FROM ({CELLS}) c LEFT JOIN ledger_docs d ON d.contact_id = c.contact_id AND d.number = trim(c.number_text) AND trim(c.number_text) <> ''"""
_A, _B = compare_sql("value"), compare_sql("ledger_value")
COMPARED = f"""SELECT *, CASE WHEN field = 'number' THEN ({id_key_sql("value")} <> '' AND {id_key_sql("ledger_value")} <> '' AND (contains({id_key_sql("value")}, {id_key_sql("ledger_value")}) OR contains({id_key_sql("ledger_value")}, {id_key_sql("value")})))
  WHEN {_A} IS NOT NULL OR {_B} IS NOT NULL THEN coalesce({_A} = {_B}, false) ELSE lower(trim(value)) = lower(trim(ledger_value)) END AS matches FROM ({LEDGER_CELLS}) l"""


@query("ledger_cells", with_tables(ITEMS, f"SELECT k AS item_seq, header_pos, header, ledger_value FROM ({LEDGER_CELLS}) l"))
def ledger_cells(t):
    rows, docs = _rows(t), _docs(t)
    beside = comparison.ledger_cells(comparison.attach_matches(rows, matching.exact_matches(rows, docs)), DATE_FORMATS)
    return (
        beside.select("item_seq", F.posexplode(F.arrays_zip("cells", "ledger")).alias("header_pos", "c"))
        .select("item_seq", "header_pos", F.col("c.cells.header").alias("header"), F.col("c.ledger").alias("ledger_value"))
    )


@query(
    "compared_cells",
    with_tables(ITEMS, f"SELECT k AS item_seq, header_pos, header, field AS canonical_field, value AS statement_value, ledger_value, matches FROM ({COMPARED}) c"),
)
def compared_cells(t):
    return comparison.explode_comparisons(_beside(t)).drop("tenant_id", "statement_id")


@query(
    "row_matches",
    with_tables(
        ITEMS,
        f"SELECT k, CASE WHEN ck % 2 = 0 THEN bool_or(d_number IS NOT NULL) ELSE bool_and(matches) END AS row_match FROM (SELECT c.*, d.number AS d_number FROM ({COMPARED}) c LEFT JOIN ledger_docs d ON d.contact_id = c.contact_id AND d.number = trim(c.number_text)) q GROUP BY k, ck",
    ),
)
def row_matches(t):
    # Statements of odd contacts have no identifying column, so all of their cells must agree.
    beside = _beside(t).withColumn("number_header", F.when(F.col("ck") % 2 == 0, F.col("number_header")))
    return comparison.row_matches(beside).select("k", "row_match")


@query(
    "item_completion",
    with_tables(("items_flat", "item_status"), "SELECT i.k, coalesce(s.completed, false) AS is_completed FROM items_flat i LEFT JOIN item_status s USING (statement_item_id)"),
)
def item_completion(t):
    return comparison.attach_item_status(t.items(), t.derive("item_status")).select("k", "is_completed")


@query(
    "replaced_items",
    with_tables(
        ("items_flat", "headers"),
        """SELECT statement_id, statement_item_id, k % 3 = 0 AS completed FROM items_flat WHERE ck % 5 <> 0 UNION ALL
           SELECT i.statement_id, i.statement_item_id, CASE WHEN i.k % 4 = 0 THEN h.completed ELSE i.k % 3 = 0 END FROM items_flat i JOIN headers h USING (statement_id) WHERE ck % 5 = 0 AND i.k % 6 <> 1""",
    ),
)
def replaced_items(t):
    flat = t.derive("items_flat").withColumn("completed", F.col("k") % 3 == 0)
    existing = flat.where((F.col("ck") % 5 != 0) | (F.col("k") % 4 != 0)).select("tenant_id", "statement_id", "statement_item_id", "completed")
    incoming = flat.where("ck % 5 = 0").withColumn("statement_item_id", F.when(F.col("k") % 6 != 1, F.col("statement_item_id")).otherwise(""))
    out = comparison.replace_items(existing, t.headers(), incoming.select("tenant_id", "statement_id", "statement_item_id"))
    return out.select("statement_id", "statement_item_id", "completed")


@query(
    "completion_counts",
    with_tables(
        ("items_flat",),
        "SELECT statement_id, count(CASE WHEN k % 3 = 0 THEN 1 END) AS completed_count, count(CASE WHEN k % 3 <> 0 THEN 1 END) AS incomplete_count, bool_or(k % 10 = 8) AS has_payment_rows FROM items_flat GROUP BY statement_id",
    ),
)
def completion_counts(t):
    rows = t.derive("items_flat").withColumn("is_completed", F.col("k") % 3 == 0).withColumn("item_type", F.when(F.col("k") % 10 == 8, "payment"))
    return comparison.completion_counts(rows).drop("tenant_id")


STATES = f"""SELECT f.k, f.contact_id, CASE WHEN i1 IS NOT NULL OR i2 IS NOT NULL THEN 'anomaly' WHEN e.doc_id IS NOT NULL THEN 'match' ELSE 'mismatch' END AS state, coalesce(s.completed, false) AS done
  FROM ({FLAGGED}) f LEFT JOIN ({EXACT}) e ON e.k = f.k LEFT JOIN item_status s ON s.statement_item_id = f.statement_item_id"""
_SUMMARY = ", ".join(
    f"count(CASE WHEN state = '{state}' AND {done} THEN 1 END) AS {state}{suffix}"
    for state in ("match", "mismatch", "anomaly")
    for done, suffix in (("NOT done", ""), ("done", "_completed"))
)


def _reconciled(t):
    return reconcile.exact_reconciliation(t.statements(), t.items(), _docs(t), t.derive("item_status"), DATE_FORMATS)


@query("row_states", with_tables((*ITEMS, "item_status"), f"SELECT k, state FROM ({STATES}) s"))
def row_states(t):
    return _reconciled(t).select("k", "state")


@query(
    "reconciliation_summary",
    with_tables((*ITEMS, "item_status"), f"SELECT contact_id, count(*) AS rows, {_SUMMARY} FROM ({STATES}) s GROUP BY contact_id"),
)
def reconciliation_summary(t):
    return comparison.reconciliation_summary(_reconciled(t)).drop("tenant_id")


_KINDS, _SOURCES = ("payment", "credit_note", "invoice"), ("invoice_match", "credit_note_match", "payment_match", "heuristic")
_FULL_DOCS = f"SELECT m.statement_id AS sid, m.row_key, d.* FROM ({MATCHED}) m JOIN ledger_docs d ON d.doc_id = m.doc_id"
_FULL_CELLS = COMPARED.replace(
    "LEFT JOIN ledger_docs d ON d.contact_id = c.contact_id AND d.number = trim(c.number_text) AND trim(c.number_text) <> ''",
    "LEFT JOIN full_docs d ON d.sid = c.statement_id AND d.row_key = trim(c.number_text)",
)
FULL_ROWS = f"""SELECT f.k, f.tenant_id, CASE WHEN i1 IS NOT NULL OR i2 IS NOT NULL THEN 'anomaly' WHEN d.doc_id IS NOT NULL THEN 'match' ELSE 'mismatch' END AS state, coalesce(s.completed, false) AS done,
  CASE WHEN d.doc_kind = 'credit_note' OR d.type LIKE '%CREDIT' THEN 'credit_note_match' WHEN d.doc_id IS NOT NULL THEN 'invoice_match' WHEN p.invoice_number IS NOT NULL THEN 'payment_match' ELSE 'heuristic' END AS type_source,
  CASE WHEN d.doc_kind = 'credit_note' OR d.type LIKE '%CREDIT' THEN 'credit_note' WHEN d.doc_id IS NOT NULL THEN 'invoice' WHEN p.invoice_number IS NOT NULL THEN 'payment' ELSE g.guessed END AS new_type, t.digest
  FROM ({FLAGGED}) f JOIN {GUESSES} g ON g.k = f.k LEFT JOIN full_docs d ON d.sid = f.statement_id AND d.row_key = trim(f.number_text) LEFT JOIN item_status s ON s.statement_item_id = f.statement_item_id
  LEFT JOIN (SELECT DISTINCT contact_id, invoice_number FROM ({PAID}) y) p ON p.contact_id = f.contact_id AND p.invoice_number = trim(f.number_text) AND trim(f.number_text) <> ''
  JOIN (SELECT k, CAST('0x' || left(md5(k || '|' || string_agg(header || '~' || value || '~' || ledger_value || '~' || matches, '|' ORDER BY header_pos)), 8) AS BIGINT) AS digest FROM ({_FULL_CELLS}) c GROUP BY k) t ON t.k = f.k"""


@query(
    "full_reconciliation",
    with_tables(
        (*ITEMS, "item_status", "payments"),
        f"""SELECT tenant_id, count(*) AS rows, {_SUMMARY}, {", ".join(f"count(CASE WHEN new_type = '{x}' THEN 1 END) AS {x}_rows" for x in _KINDS)},
            {", ".join(f"count(CASE WHEN type_source = '{x}' THEN 1 END) AS {x}_source" for x in _SOURCES)}, CAST(sum(digest) AS BIGINT) AS cells_digest FROM ({FULL_ROWS}) s GROUP BY tenant_id""",
        {"full_docs": _FULL_DOCS},
    ),
)
def full_reconciliation(t):
    rows = reconcile.reconciled_rows(t.statements(), t.items(), _docs(t), t.derive("payments"), t.derive("item_status"), DATE_FORMATS)
    # Every cell of both sides and whether they agree, as one number a row.
    cells = F.transform("comparisons", lambda c: F.concat_ws("~", c["header"], c["statement_value"], c["ledger_value"], c["matches"].cast("string")))
    text = F.concat_ws("|", F.col("k").cast("string"), F.array_join(cells, "|"))
    rows = rows.withColumn("digest", F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint"))
    kinds = [F.count_if(F.col("new_type") == x).alias(f"{x}_rows") for x in _KINDS]
    sources = [F.count_if(F.col("type_source") == x).alias(f"{x}_source") for x in _SOURCES]
    return comparison.reconciliation_summary(rows, ["tenant_id"], [*kinds, *sources, F.sum("digest").alias("cells_digest")])


_LABELS = "upper(header[1]) || header[2:]"


@query(
    "exported_lines",
    with_tables(
        (*ITEMS, "item_status"),
        f"""SELECT statement_id, 0 AS item_seq, 'Type|' || string_agg('Statement ' || label, '|' ORDER BY header_pos) || '|' || string_agg('Ledger ' || label, '|' ORDER BY header_pos) || '|Ledger Link|Status' AS line
            FROM (SELECT DISTINCT statement_id, header_pos, upper(replace(header, '_', ' ')[1]) || replace(header, '_', ' ')[2:] AS label FROM ({CELLS}) c) h GROUP BY statement_id
            UNION ALL SELECT c.statement_id, c.k, CASE WHEN c.k % 2 = 0 THEN 'INV' ELSE 'PMT' END || '|' || string_agg(value, '|' ORDER BY header_pos) || '|' || string_agg(ledger_value, '|' ORDER BY header_pos) || '|' ||
            CASE WHEN bool_or(d.doc_id IS NOT NULL) THEN 'Link' ELSE '' END || '|' || CASE WHEN bool_or(s.completed) THEN 'Completed' ELSE 'Incomplete' END
            FROM ({LEDGER_CELLS}) c LEFT JOIN ledger_docs d ON d.contact_id = c.contact_id AND d.number = trim(c.number_text) AND trim(c.number_text) <> ''
            LEFT JOIN item_status s ON s.statement_item_id = concat(c.statement_id, '#item-', CAST(c.k AS VARCHAR)) GROUP BY c.statement_id, c.k""",
    ),
)
def exported_lines(t):
    rows = _reconciled(t).withColumn("item_type", F.when(F.col("k") % 2 == 0, "invoice").otherwise("payment"))
    return comparison.export_lines(rows).select("statement_id", F.col("item_seq").cast("bigint").alias("item_seq"), F.array_join("line", "|").alias("line"))


def _csv_sql(text: str) -> str:
    return f"""CASE WHEN regexp_matches({text}, '[",\r\n]') THEN '"' || replace({text}, '"', '""') || '"' ELSE {text} END"""


@query(
    "exported_files",
    with_tables(
        (*ITEMS, "item_status"),
        f"""SELECT tenant_id, statement_id, 0 AS item_seq, 'Type,' || string_agg({_csv_sql("'Statement ' || label")}, ',' ORDER BY header_pos) || ',' || string_agg({_csv_sql("'Ledger ' || label")}, ',' ORDER BY header_pos) || ',Ledger Link,Status' AS value
            FROM (SELECT DISTINCT tenant_id, statement_id, header_pos, upper(replace(header, '_', ' ')[1]) || replace(header, '_', ' ')[2:] AS label FROM ({CELLS}) c) h GROUP BY tenant_id, statement_id
            UNION ALL SELECT c.tenant_id, c.statement_id, c.k, CASE WHEN c.k % 2 = 0 THEN 'INV' ELSE 'PMT' END || ',' || string_agg({_csv_sql("value")}, ',' ORDER BY header_pos) || ',' || string_agg({_csv_sql("ledger_value")}, ',' ORDER BY header_pos) || ',' ||
            CASE WHEN bool_or(d.doc_id IS NOT NULL) THEN 'Link' ELSE '' END || ',' || CASE WHEN bool_or(s.completed) THEN 'Completed' ELSE 'Incomplete' END
            FROM ({LEDGER_CELLS}) c LEFT JOIN ledger_docs d ON d.contact_id = c.contact_id AND d.number = trim(c.number_text) AND trim(c.number_text) <> ''
            LEFT JOIN item_status s ON s.statement_item_id = concat(c.statement_id, '#item-', CAST(c.k AS VARCHAR)) GROUP BY c.tenant_id, c.statement_id, c.k""",
    ),
)
def exported_files(t):
    """The export, written and read back as files."""
    folder = f"{checkpoint_folder(t.spark)}/export-{uuid.uuid4().hex}"
    export.export_reconciliation(_reconciled(t).withColumn("item_type", F.when(F.col("k") % 2 == 0, "invoice").otherwise("payment")), folder)
    back = t.spark.read.schema("statement_id string, item_seq bigint, value string, tenant_id string").option("header", True).option("escape", "\\").csv(folder)
    return back.select("tenant_id", "statement_id", "item_seq", "value")


# --- classification ----------------------------------------------------------------------------


@query(
    "amount_hints",
    with_tables(("items_flat",), "SELECT k, CASE WHEN layout <> 0 THEN NULL WHEN is_credit = 1 THEN 'credit' ELSE 'invoice' END AS amount_hint FROM items_flat"),
)
def amount_hints(t):
    return classification.amount_hint(t.items()).select("k", "amount_hint")


@query("types_by_contained_words", with_tables(("items_flat",), f"SELECT k, CASE WHEN settled THEN guessed END AS guessed FROM {GUESSES} g"))
def types_by_contained_words(t):
    from tallyweave.functions.text import id_key

    guessed = classification.guess_item_type(t.items(), "guessed")
    joined = id_key(F.array_join(F.map_values("raw"), ""))
    pay, inv = (F.col("layout") != 0) | (F.col("is_credit") == 1), (F.col("layout") != 0) | (F.col("is_credit") == 0)
    contained = (pay & joined.rlike("PAYMENT|PAID|RECEIPT|REMITTANCE|BANKTRANSFER|DIRECTDEBIT|CASHRECEIPT|CREDIT|CRN|CR|CN")) | (inv & joined.rlike("INV|BILL"))
    return guessed.select("k", F.when(contained, F.col("guessed")).alias("guessed"))


@query("guessed_item_types", with_tables(("items_flat",), f"SELECT k, guessed AS guessed_type FROM {GUESSES} g"))
def guessed_item_types(t):
    return classification.guess_item_type(t.items()).select("k", "guessed_type")


_TURN_WORDS = "SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(upper(replace(coalesce(text, ''), 'ß', 'ss')), '[A-Z0-9]+'))) AS token FROM conversations"


@query(
    "token_similarities",
    f"""WITH w AS ({_TURN_WORDS}) SELECT c.conv_id, c.turn, coalesce(max(payment), 0.0) AS payment, coalesce(max(credit_note), 0.0) AS credit_note, coalesce(max(invoice), 0.0) AS invoice
        FROM conversations c LEFT JOIN w ON w.conv_id = c.conv_id AND w.turn = c.turn LEFT JOIN {token_scores_sql("SELECT token FROM w")} s ON s.token = w.token GROUP BY c.conv_id, c.turn""",
)
def token_similarities(t):
    from tallyweave.functions.text import upper_tokens

    scored = t.base("conversations").select("conv_id", "turn", classification.token_similarity(F.array_distinct(upper_tokens("text"))).alias("s"))
    return scored.select("conv_id", "turn", "s.*")


@query(
    "types_with_evidence",
    with_tables(
        (*ITEMS, "payments"),
        f"""SELECT f.k, CASE WHEN e.doc_kind = 'credit_note' THEN 'credit_note_match' WHEN e.doc_id IS NOT NULL THEN 'invoice_match' WHEN p.invoice_number IS NOT NULL THEN 'payment_match' ELSE 'heuristic' END AS type_source,
            CASE WHEN e.doc_kind = 'credit_note' THEN 'credit_note' WHEN e.doc_id IS NOT NULL THEN 'invoice' WHEN p.invoice_number IS NOT NULL THEN 'payment' ELSE g.guessed END AS new_type
            FROM items_flat f JOIN {GUESSES} g ON g.k = f.k LEFT JOIN (SELECT * FROM ({EXACT}) x WHERE k % 2 = 0) e ON e.k = f.k
            LEFT JOIN (SELECT DISTINCT contact_id, invoice_number FROM ({PAID}) y) p ON p.contact_id = f.contact_id AND p.invoice_number = trim(f.number_text)""",
    ),
)
def types_with_evidence(t):
    # Half of the matches are taken away, which leaves payments as evidence.
    rows, docs = _rows(t), _docs(t)
    matches = matching.exact_matches(rows, docs).where("item_seq % 2 = 0")
    paid = matching.payments_by_invoice_number(t.derive("ledger_docs"), t.derive("payments"))
    typed = classification.classify_items(rows, matches, paid)
    return typed.select("k", "type_source", "new_type")


@query(
    "classification_updates",
    with_tables(("items_flat",), "SELECT statement_item_id, 'payment' AS item_type FROM items_flat WHERE k % 3 <> 0 AND k % 8 <> 0"),
)
def classification_updates(t):
    old = F.when(F.col("k") % 3 == 0, " PAYMENT ").when(F.col("k") % 3 == 1, "invoice")
    item_id = F.when(F.col("k") % 8 != 0, F.col("statement_item_id"))
    rows = t.items().withColumns({"item_type": old, "new_type": F.lit("payment"), "statement_item_id": item_id})
    return classification.classification_updates(rows).select("statement_item_id", "item_type")


@query(
    "types_by_keywords",
    with_tables(
        ("items_flat",),
        f"SELECT k, CASE WHEN description LIKE 'Payment%' THEN 'payment' WHEN description LIKE 'Credit note%' THEN 'credit_note' ELSE guessed END AS entry_type FROM items_flat JOIN {GUESSES} g USING (k)",
    ),
)
def types_by_keywords(t):
    items = t.items().withColumn("reference", F.col("description"))
    return classification.classify_by_keywords(items).select("k", "entry_type")


_PLAIN = "replace(replace(amount_text, ',', ''), ' ', '')"
_MARKED = f"coalesce(TRY_CAST({_PLAIN} AS DECIMAL(38,10)), TRY_CAST(CASE WHEN {_PLAIN} LIKE '(%' THEN '-' ELSE '' END || regexp_replace({_PLAIN}, '[^0-9.]', '', 'g') AS DECIMAL(38,10)))"


@query(
    "derived_documents",
    with_tables(
        ("items_flat",),
        f"""SELECT k, CASE WHEN description LIKE 'No match%' THEN 'non-document' WHEN coalesce({_MARKED}, 0) = 0 THEN 'no-amount' WHEN parsed IS NULL THEN 'no-date' END AS skip_reason, {money_sql(_MARKED)} AS amount, parsed AS doc_date,
            CASE WHEN trim(number) = '' THEN NULL ELSE coalesce(nullif(replace(regexp_extract(number, '(?i)([A-Z]{{2,6}}[- ]?\\d{{2,}}(?:[-/]\\d{{1,4}})?)', 1), ' ', ''), ''), trim(number)) END AS doc_number
            FROM (SELECT *, CAST(CAST(CASE ck % 4 WHEN 0 THEN try_strptime(date_text, '%d/%m/%Y') WHEN 3 THEN try_strptime(date_text, '%d/%m/%Y') WHEN 2 THEN day END AS DATE) AS VARCHAR) AS parsed FROM items_flat) q""",
    ),
)
def derived_documents(t):
    items = t.items().withColumn("reference", F.col("description")).withColumn("total_text", F.col("amount_text"))
    items = items.withColumn("raw", F.map_filter("raw", lambda k, _: k != "due_date"))
    derived = classification.derive_documents(items, "DD/MM/YYYY", ("debit", "credit", "amount"))
    return derived.select("k", "skip_reason", money("amount").alias("amount"), iso("doc_date").alias("doc_date"), "doc_number")


@query(
    "guarded_documents",
    with_tables(
        ("items_flat", "ledger_docs"),
        """SELECT DISTINCT d.doc_id, CASE WHEN d.status IN ('DRAFT', 'SUBMITTED') THEN 'DELETED' ELSE 'VOIDED' END AS next_status FROM ledger_docs d JOIN items_flat i ON i.contact_id = d.contact_id AND d.doc_kind = 'invoice'
           AND ((i.layout <> 1 AND trim(i.number_text) <> '' AND i.number_text = d.number) OR (NOT (i.layout <> 1 AND trim(i.number_text) <> '') AND d.reference = concat('PO-', CAST(i.k % 97 AS VARCHAR)))) WHERE d.status NOT IN ('DELETED', 'VOIDED')""",
    ),
)
def guarded_documents(t):
    return _guard(t)[1].select("doc_id", "next_status")


def _guard(t):
    candidates = t.derive("items_flat").select(
        "tenant_id", "contact_id", F.lit("invoice").alias("doc_kind"), "k", F.when(F.col("layout") != 1, F.col("number_text")).alias("number"), F.concat(F.lit("PO-"), (F.col("k") % 97).cast("string")).alias("reference")
    )
    return ledger.guard_existing(candidates, t.derive("ledger_docs"))


@query(
    "creatable_documents",
    with_tables(
        ("items_flat", "ledger_docs"),
        """SELECT k FROM items_flat i WHERE NOT EXISTS (SELECT 1 FROM ledger_docs d WHERE d.contact_id = i.contact_id AND d.doc_kind = 'invoice' AND d.status NOT IN ('DELETED', 'VOIDED')
           AND ((i.layout <> 1 AND trim(i.number_text) <> '' AND i.number_text = d.number) OR (NOT (i.layout <> 1 AND trim(i.number_text) <> '') AND d.reference = concat('PO-', CAST(i.k % 97 AS VARCHAR)))))""",
    ),
)
def creatable_documents(t):
    return _guard(t)[0].select("k")
