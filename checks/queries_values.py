"""Value normalisation, pricing and lookups in raw cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.derive import DATE_FORMATS, with_tables
from checks.registry import compare_sql, decimal_sql, format_money_sql, id_key_sql, iso, money, money_sql, query, separators_sql
from tallyweave.functions import dates
from tallyweave.functions import text as texts
from tallyweave.operators import values


def _amount_query(rule: str, number_sql: str, from_sql: str = "amount_texts"):
    sql = with_tables(
        ("amount_texts",),
        f"SELECT id, {money_sql('n')} AS amount, (trim(text) = '' OR n IS NOT NULL) AS ok FROM (SELECT id, text, {number_sql} AS n FROM {from_sql}) q",
    )

    @query(f"amounts_{rule}", sql)
    def build(t):
        out = values.normalise_amounts(t.derive("amount_texts"), "text", rule)
        return out.select("id", money("text_amount").alias("amount"), F.col("text_ok").alias("ok"))


_amount_query("coerce", "TRY_CAST(trim(replace(replace(text, ',', ''), ' ', '')) AS DECIMAL(38,10))")
_amount_query("decimal", decimal_sql("text"))
_amount_query("compare", compare_sql("text"))
_amount_query(
    "convert",
    f"sign * TRY_CAST({separators_sql('body')} AS DECIMAL(38,10))".replace("TRY_CAST(", "TRY_CAST(replace(").replace(
        " AS DECIMAL", ", ' ', '') AS DECIMAL"
    ),
    """(SELECT id, text, CASE WHEN s LIKE '%-' OR (s LIKE '(%' AND s LIKE '%)') OR s LIKE '-%' THEN -1 ELSE 1 END AS sign,
        CASE WHEN s LIKE '%-' THEN trim(s[:-2]) WHEN s LIKE '(%' AND s LIKE '%)' THEN trim(s[2:-2]) WHEN s LIKE '-%' THEN trim(s[2:]) ELSE s END AS body
        FROM (SELECT id, text, trim(regexp_replace(trim(text), '^[A-Za-z€$£¥₹]{1,3}\\s*', '')) AS s FROM amount_texts) a) b""",
)
_amount_query(
    "evidence",
    """TRY_CAST(replace(regexp_replace(CASE WHEN text LIKE '%(%' AND text LIKE '%)%' AND kept NOT LIKE '%-%' THEN '-' || kept ELSE kept END, '[(),]', '', 'g'), '..', '.') AS DECIMAL(38,10))""",
    "(SELECT id, text, regexp_replace(text, '[^0-9\\-.,()]', '', 'g') AS kept FROM amount_texts) a",
)
_amount_query(
    "marked",
    """coalesce(TRY_CAST(plain AS DECIMAL(38,10)), CASE WHEN bare LIKE '(%' AND bare LIKE '%)' OR kept LIKE '-%' THEN -1 ELSE 1 END
       * TRY_CAST(regexp_replace(kept, '[+\\-]', '', 'g') AS DECIMAL(38,10)))""",
    """(SELECT *, regexp_replace(bare, '[^0-9.+\\-]', '', 'g') AS kept FROM (SELECT *, trim(regexp_replace(plain, '[A-Za-z]', '', 'g')) AS bare
        FROM (SELECT id, text, replace(replace(text, ',', ''), ' ', '') AS plain FROM amount_texts) a) b) c""",
)


@query(
    "amounts_rendered",
    with_tables(
        ("amount_texts",),
        f"SELECT id, coalesce({format_money_sql('n')}, text) AS text_text FROM (SELECT id, text, {decimal_sql('text')} AS n FROM amount_texts) q",
    ),
)
def amounts_rendered(t):
    return values.render_amounts(t.derive("amount_texts"), "text").select("id", "text_text")


@query(
    "amounts_failure_profile",
    with_tables(
        ("amount_texts", "order_items"),
        f"""SELECT statement_id, count(*) AS values, CAST(sum(CASE WHEN trim(text) <> '' AND {compare_sql("text")} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS failures
            FROM amount_texts JOIN order_items ON id = k GROUP BY statement_id""",
    ),
)
def amounts_failure_profile(t):
    joined = t.derive("amount_texts").join(t.derive("order_items").select(F.col("k").alias("id"), "statement_id"), "id")
    return values.failure_profile(values.normalise_amounts(joined, "text", "compare"), "text", ["statement_id"])


# --- dates -------------------------------------------------------------------------------------

_STRPTIME = """CASE date_format WHEN 'DD/MM/YYYY' THEN try_strptime({0}, '%d/%m/%Y') WHEN 'YYYY-MM-DD' THEN try_strptime({0}, '%Y-%m-%d')
  WHEN 'D MMM YYYY' THEN try_strptime({0}, '%d %b %Y') ELSE try_strptime({0}, '%m/%d/%Y') END"""


def strptime_sql(column: str) -> str:
    return f"CAST(CAST({_STRPTIME.format(column)} AS DATE) AS STRING)"


@query(
    "dates_by_template",
    with_tables(("items_flat",), f"SELECT k, {strptime_sql('date_text')} AS parsed, {strptime_sql('date_text')} IS NOT NULL AS ok FROM items_flat"),
)
def dates_by_template(t):
    out = values.normalise_dates(t.derive("items_flat"), "date_text", "date_format", DATE_FORMATS, lenient=False)
    return out.select("k", iso("date_text_date").alias("parsed"), F.col("date_text_ok").alias("ok"))


_STRFTIME = """CASE date_format WHEN 'DD/MM/YYYY' THEN strftime({0}, '%d/%m/%Y') WHEN 'YYYY-MM-DD' THEN strftime({0}, '%Y-%m-%d')
  WHEN 'D MMM YYYY' THEN strftime({0}, '%-d %b %Y') ELSE strftime({0}, '%m/%d/%Y') END"""


@query(
    "dates_of_many_templates",
    with_tables(
        ("items_flat",),
        f"""SELECT k, parsed, {_STRFTIME.format("CAST(parsed AS DATE)")} || ' (' || k % 350 || ')' AS rendered, parsed AS loose
            FROM (SELECT *, {strptime_sql('date_text')} AS parsed FROM items_flat) p""",
    ),
)
def dates_of_many_templates(t):
    """Each of the table's formats with 350 different endings, over all items."""
    ending = F.concat(F.lit(" ("), (F.col("k") % 350).cast("string"), F.lit(")"))
    flat = t.derive("items_flat").withColumns({"text": F.concat("date_text", ending), "template": F.concat("date_format", ending)})
    templates = dates.templates_of(flat, "template")
    out = values.normalise_dates(flat, "text", "template", templates, lenient=False)
    out = values.render_dates(out, "text_date", "template", templates, lenient=False)
    loose = dates.loose_by_template("text", "template", templates)
    return out.select("k", iso("text_date").alias("parsed"), F.col("text_date_text").alias("rendered"), iso(loose).alias("loose"))


@query(
    "dates_wrong_template",
    with_tables(
        ("items_flat",),
        "SELECT k, CAST(CAST(try_strptime(CASE WHEN regexp_matches(date_text, '^\\d{2}/\\d{2}/\\d{4}$') THEN date_text END, '%m/%d/%Y') AS DATE) AS STRING) AS parsed FROM items_flat",
    ),
)
def dates_wrong_template(t):
    flat = t.derive("items_flat").withColumn("other_format", F.lit("MM/DD/YYYY"))
    return values.normalise_dates(flat, "date_text", "other_format", ["MM/DD/YYYY"]).select("k", iso("date_text_date").alias("parsed"))


@query("dates_discovered_templates", with_tables(("items_flat",), f"SELECT k, {strptime_sql('date_text')} AS parsed FROM items_flat"))
def dates_discovered_templates(t):
    out = values.normalise_dates(t.derive("items_flat"), "date_text", "date_format", lenient=True)
    return out.select("k", iso("date_text_date").alias("parsed"))


@query(
    "dates_rendered",
    with_tables(
        ("ledger_docs",),
        """SELECT doc_id, CASE load_seq % 3 WHEN 0 THEN strftime(date, '%d/%m/%Y')
           WHEN 1 THEN concat(CAST(day(date) AS STRING), CASE WHEN day(date) BETWEEN 10 AND 20 THEN 'th' WHEN day(date) % 10 = 1 THEN 'st' WHEN day(date) % 10 = 2 THEN 'nd' WHEN day(date) % 10 = 3 THEN 'rd' ELSE 'th' END, strftime(date, ' %B %Y'))
           ELSE strftime(date, '%A %-d %b %y') END AS date_text FROM ledger_docs""",
    ),
)
def dates_rendered(t):
    formats = ["DD/MM/YYYY", "Do MMMM YYYY", "dddd D MMM YY"]
    docs = t.derive("ledger_docs").withColumn(
        "fmt", F.get(F.array(*[F.lit(f) for f in formats]), (F.col("load_seq") % 3).cast("int"))
    )
    return values.render_dates(docs, "date", "fmt", formats).select("doc_id", "date_text")


@query(
    "dates_coerced",
    with_tables(
        ("items_flat",),
        f"SELECT k, CASE WHEN k % 2 = 0 THEN CAST(day AS STRING) ELSE {strptime_sql('date_text')} END AS parsed FROM items_flat",
    ),
)
def dates_coerced(t):
    stamped = F.concat(F.col("day").cast("string"), F.lit("T10:00:00"))
    mixed = t.derive("items_flat").withColumn("mixed", F.when(F.col("k") % 2 == 0, stamped).otherwise(F.col("date_text")))
    return values.normalise_dates(mixed, "mixed", "date_format", DATE_FORMATS, rule="coerce").select("k", iso("mixed_date").alias("parsed"))


@query(
    "dates_loose",
    with_tables(
        ("items_flat",),
        """SELECT k, CAST(CAST(CASE WHEN ck % 4 = 0 OR ck % 4 = 3 THEN try_strptime(date_text, '%d/%m/%Y') WHEN ck % 4 = 1 THEN try_strptime(date_text, '%Y-%m-%d')
           ELSE NULL END AS DATE) AS STRING) AS parsed FROM items_flat""",
    ),
)
def dates_loose(t):
    return values.normalise_dates(t.derive("items_flat"), "date_text", rule="loose").select("k", iso("date_text_date").alias("parsed"))


@query(
    "dates_loose_template",
    with_tables(("items_flat",), f"SELECT k, {strptime_sql('date_text')} AS parsed FROM items_flat"),
)
def dates_loose_template(t):
    out = values.normalise_dates(t.derive("items_flat"), "date_text", "date_format", DATE_FORMATS, rule="loose")
    return out.select("k", iso("date_text_date").alias("parsed"))


@query(
    "dates_epoch",
    """SELECT event_id, CASE WHEN event_id % 5 <> 2 THEN CAST(floor(epoch(ts)) AS BIGINT) END AS seconds FROM events""",
)
def dates_epoch(t):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    # Seconds, milliseconds, no time at all, ISO text in UTC, and text without a zone.
    raw = (
        F.when(F.col("event_id") % 5 == 0, F.floor(micros / 1_000_000).cast("string"))
        .when(F.col("event_id") % 5 == 1, F.floor(micros / 1000).cast("string"))
        .when(F.col("event_id") % 5 == 2, "not a time")
        .when(F.col("event_id") % 5 == 3, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .otherwise(F.date_format("ts", " yyyy-MM-dd HH:mm:ss "))
    )
    out = values.normalise_dates(t.base("events").withColumn("raw", raw), "raw", rule="epoch")
    return out.select("event_id", F.unix_seconds("raw_date").alias("seconds"))


# --- keys --------------------------------------------------------------------------------------


@query(
    "keys_of_documents",
    """SELECT doc_id, md5(regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g')) AS label_key,
       md5(trim(regexp_replace(lower(replace(text, '/', ' ')), '[^a-z0-9]+', ' ', 'g'))) AS text_key FROM documents""",
)
def keys_of_documents(t):
    docs = t.base("documents").select("doc_id", "text")
    return values.normalise_keys(docs, "text", "label").select(
        "doc_id", F.md5("text_key").alias("label_key"), F.md5(texts.plain_text("text")).alias("text_key")
    )


@query("keys_of_headers", "SELECT p_partkey, lower(trim(regexp_replace('  ' || p_name || '   ' || p_type, '\\s+', ' ', 'g'))) AS header_key FROM part")
def keys_of_headers(t):
    named = t.base("part").withColumn("header", F.concat(F.lit("  "), "p_name", F.lit("   "), "p_type"))
    return values.normalise_keys(named, "header", "header").select("p_partkey", "header_key")


@query(
    "keys_of_ids",
    with_tables(("items_flat",), f"SELECT k, {id_key_sql('number_text')} AS number_text_key FROM items_flat"),
)
def keys_of_ids(t):
    return values.normalise_keys(t.derive("items_flat"), "number_text", "id").select("k", "number_text_key")


@query(
    "tokens_of_conversations",
    "SELECT conv_id, turn, len(regexp_extract_all(upper(replace(text, 'ß', 'SS')), '[A-Z0-9]+')) AS tokens, array_to_string(regexp_extract_all(upper(replace(text, 'ß', 'SS')), '[A-Z0-9]+'), ' ') AS joined FROM conversations",
)
def tokens_of_conversations(t):
    out = values.normalise_keys(t.base("conversations"), "text", "tokens")
    return out.select("conv_id", "turn", F.size("text_key").cast("bigint").alias("tokens"), F.array_join("text_key", " ").alias("joined"))


@query(
    "document_numbers",
    "SELECT doc_id, nullif(replace(regexp_extract(text, '(?i)([A-Z]{2,6}[- ]?\\d{2,}(?:[-/]\\d{1,4})?)', 1), ' ', ''), '') AS text_key FROM documents",
)
def document_numbers(t):
    return values.normalise_keys(t.base("documents"), "text", "document_number").select("doc_id", "text_key")


@query(
    "typed_map_values",
    with_tables(
        ("items_flat",),
        """SELECT k, CASE layout WHEN 0 THEN 1 + 1 WHEN 1 THEN 2 ELSE 1 END AS kept,
           CASE WHEN TRY_CAST(replace(amount_text, ',', '') AS DECIMAL(38,10)) IS NULL THEN 0 WHEN layout = 2 THEN 1 ELSE 2 END AS numbers,
           CAST(CAST(TRY_CAST(replace(amount_text, ',', '') AS DECIMAL(38,10)) AS DECIMAL(18,4)) AS DOUBLE) AS amount FROM items_flat""",
    ),
)
def typed_map_values(t):
    out = values.type_map_values(t.items(), "total")
    label = F.when(F.col("layout") == 2, "Amount").otherwise("Balance")
    return out.select(
        "k",
        F.size("total").alias("kept"),
        F.size("total_numbers").alias("numbers"),
        money(F.try_element_at("total_numbers", label)).alias("amount"),
    )


@query(
    "item_type_labels",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'CRN' WHEN event_id % 5 = 1 THEN 'INV' WHEN event_id % 5 = 2 THEN 'PMT' WHEN event_id % 5 = 3 THEN '' ELSE upper(event_type) || ' ROW' END AS label FROM events""",
)
def item_type_labels(t):
    given = (
        F.when(F.col("event_id") % 5 == 0, " Credit_Note ")
        .when(F.col("event_id") % 5 == 1, "invoice")
        .when(F.col("event_id") % 5 == 2, "PAYMENT")
        .when(F.col("event_id") % 5 == 3, "  ")
        .otherwise(F.concat("event_type", F.lit("_row")))
    )
    return t.base("events").select("event_id", texts.item_type_label(given).alias("label"))


@query(
    "purchase_prices",
    """SELECT k, total_pence, CASE WHEN k > 0 THEN CAST(round_even(total_pence / k, 2) AS DOUBLE) END AS rate FROM (
       SELECT l_orderkey * 4 + l_linenumber AS k, CAST(least(k, 499) * 10 + least(greatest(k - 499, 0), 500) * 9 + greatest(k - 999, 0) * 8 AS BIGINT) AS total_pence FROM lineitem) q""",
)
def purchase_prices(t):
    bought = t.base("lineitem").select((F.col("l_orderkey") * 4 + F.col("l_linenumber")).alias("tokens"))
    return values.price_purchases(bought).select(F.col("tokens").alias("k"), "total_pence", F.col("rate_pence").cast("double").alias("rate"))


@query(
    "subscription_prices",
    with_tables(
        ("billing_events",),
        """SELECT event_id, tier_id, CASE tier_id WHEN 'tier_50' THEN 450 WHEN 'tier_200' THEN 1600 ELSE 3500 END AS monthly_price_pence FROM billing_events""",
    ),
)
def subscription_prices(t):
    return values.price_subscriptions(t.derive("billing_events")).select("event_id", "tier_id", "monthly_price_pence")


@query(
    "picked_amounts",
    with_tables(
        ("items_flat",),
        f"""SELECT k, {money_sql("CASE WHEN k % 3 = 0 THEN CAST(cents / 100 AS DECIMAL(38,10)) WHEN n IS NULL OR n = 0 THEN 0 ELSE n END")} AS amount FROM (SELECT *,
           coalesce(TRY_CAST(plain AS DECIMAL(38,10)), TRY_CAST(CASE WHEN bare LIKE '(%' THEN '-' ELSE '' END || regexp_replace(bare, '[^0-9.]', '', 'g') AS DECIMAL(38,10))) AS n
           FROM (SELECT *, trim(regexp_replace(plain, '[A-Za-z]', '', 'g')) AS bare FROM (SELECT *, replace(replace(amount_text, ',', ''), ' ', '') AS plain FROM items_flat) a) b) c""",
    ),
)
def picked_amounts(t):
    total = F.when(F.col("k") % 3 == 0, (F.col("cents") / 100).cast("decimal(18,2)").cast("string")).otherwise("0")
    tokens = F.array(*[F.lit(h) for h in ("debit", "CREDIT", "amount", "Total")])
    items = t.items().withColumn("own", total).withColumn("tokens", tokens)
    return values.pick_amount(items, "own", "tokens").select("k", money("amount").alias("amount"))


@query(
    "raw_cells_by_header",
    with_tables(
        ("items_flat",),
        "SELECT k, CASE layout WHEN 1 THEN nullif(due_text, '') WHEN 0 THEN NULL ELSE NULL END AS cell FROM items_flat",
    ),
)
def raw_cells_by_header(t):
    return values.pick_from_raw(t.items().withColumn("wanted", F.lit(" Due-Date")), "wanted", "cell").select("k", "cell")


@query(
    "dates_from_raw",
    with_tables(
        ("items_flat",),
        """SELECT k, CAST(CAST(coalesce(CASE WHEN ck % 4 = 0 OR ck % 4 = 3 THEN try_strptime(date_text, '%d/%m/%Y') WHEN ck % 4 = 1 THEN try_strptime(date_text, '%Y-%m-%d') END,
           CASE WHEN layout <> 1 THEN NULL WHEN ck % 4 = 0 OR ck % 4 = 3 THEN try_strptime(due_text, '%d/%m/%Y') WHEN ck % 4 = 1 THEN try_strptime(due_text, '%Y-%m-%d') END) AS DATE) AS STRING) AS day_found FROM items_flat""",
    ),
)
def dates_from_raw(t):
    # A due date, where a layout has one, stands in for a date that cannot be read.
    return values.pick_date_from_raw(t.items(), "date", "found", None).select("k", iso("found").alias("day_found"))


@query(
    "row_links",
    with_tables(
        ("ledger_docs",),
        """SELECT doc_id, CASE WHEN load_seq % 7 = 0 THEN '' WHEN doc_kind = 'credit_note' THEN 'credit/' || doc_id ELSE 'bill/' || doc_id END AS link FROM ledger_docs""",
    ),
)
def row_links(t):
    blank = F.col("load_seq") % 7 == 0
    docs = t.derive("ledger_docs").withColumn("credit_note_id", F.when(~blank & (F.col("doc_kind") == "credit_note"), F.col("doc_id")).otherwise("  "))
    docs = docs.withColumn("invoice_id", F.when(~blank, F.concat(F.lit(" "), "doc_id")))
    return values.statement_row_link(docs, "credit/", "bill/").select("doc_id", "link")


@query(
    "landed_files",
    """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'suffix' WHEN doc_id % 5 = 0 AND text NOT LIKE '\\%PDF-%' ESCAPE '\\' THEN 'content' END AS reject_reason,
       CASE WHEN doc_id % 3 = 1 THEN 2 WHEN doc_id % 3 = 2 THEN 1 + n_chars % 40 END AS page_count FROM documents""",
)
def landed_files(t):
    from tallyweave.sources import pdf_landing

    # Every text becomes the content of a file, with page objects, a page-tree count, or neither.
    start = F.when(F.col("doc_id") % 5 == 0, "").otherwise("%PDF-1.4 ")
    end = (
        F.when(F.col("doc_id") % 3 == 1, " /Type /Page /Type/Pages /Type\n/Page ")
        .when(F.col("doc_id") % 3 == 2, F.concat(F.lit(" /Count 1 /Count  "), (1 + F.col("n_chars") % 40).cast("string")))
        .otherwise("")
    )
    files = t.base("documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 7 == 0, "scan.txt").otherwise("scan.PDF").alias("filename"),
        F.encode(F.concat(start, "text", end), "UTF-8").alias("content"),
    )
    checked = pdf_landing.estimate_pdf_pages(pdf_landing.check_pdfs(files))
    return checked.select("doc_id", "reject_reason", "page_count")
