"""Chunks to items, statement metadata, and the columns to show."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.derive import DATE_FORMATS, LAYOUTS, with_tables
from checks.queries_values import strptime_sql
from checks.registry import decimal_sql, format_money_sql, iso, money, money_sql, query, separators_sql
from tallyweave.operators import quality, shaping

# The items of each statement as chunks of four rows that share their edge rows.
LINES = """SELECT f.*, c AS chunk_index, i - c * 3 AS row_pos FROM (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY item_seq) - 1 AS i,
  count(*) OVER (PARTITION BY statement_id) AS n FROM items_flat) f, unnest(generate_series(0, CAST(greatest(ceil((n - 4) / 3.0), 0) AS BIGINT))) AS t(c)
  WHERE i >= c * 3 AND i < c * 3 + 4"""

LAYOUT_COLUMNS = ", ".join(
    f"({i}, {pos}, '{header}', '{column}', '{column if column[0].islower() else 'total'}')"
    for i, layout in enumerate(LAYOUTS)
    for pos, (header, column) in enumerate(layout)
)
HEADERS = f"SELECT * FROM (VALUES {LAYOUT_COLUMNS}) AS v(layout, pos, detected, header, field)"
# Amount columns that are shown: debit and credit, else the total column.
SHOWN = f"""SELECT layout, pos, header, field FROM ({HEADERS}) h WHERE field <> 'total' OR header IN ('Debit', 'Credit', 'Total', 'Amount')"""
RAW = """CASE header WHEN 'date' THEN date_text WHEN 'due_date' THEN due_text WHEN 'number' THEN number WHEN 'reference' THEN reference
  WHEN 'Debit' THEN CASE WHEN is_credit = 0 THEN amount_text ELSE '' END WHEN 'Credit' THEN CASE WHEN is_credit = 1 THEN amount_text ELSE '' END ELSE amount_text END"""
CELL_ORDER = "CASE field WHEN 'date' THEN 0 WHEN 'due_date' THEN 1 WHEN 'number' THEN 2 WHEN 'reference' THEN 3 ELSE 9 END, pos"
CELLS = f"""SELECT k, ck, statement_id, contact_id, tenant_id, item_seq, number_text, date_format, header, field, pos, value,
  row_number() OVER (PARTITION BY k ORDER BY {CELL_ORDER}) - 1 AS header_pos FROM (
  SELECT f.*, header, field, pos, CASE WHEN field = 'total' THEN coalesce({format_money_sql("abs(" + decimal_sql(RAW) + ")")}, {RAW}) ELSE {RAW} END AS value
  FROM items_flat f JOIN ({SHOWN}) s ON f.layout = s.layout) q"""


@query(
    "reconstructed_items",
    with_tables(
        ("items_flat",),
        """SELECT statement_id, chunk_index, row_pos, date_text AS date, number, reference, CASE WHEN layout = 1 THEN due_text ELSE '' END AS due_date,
           CASE layout WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS totals, CASE layout WHEN 0 THEN 6 WHEN 1 THEN 5 ELSE 3 END AS cells FROM lines""",
        {"lines": LINES},
    ),
)
def reconstructed_items(t):
    out = shaping.reconstruct_items(t.chunks())
    return out.select(
        "statement_id", "chunk_index", "row_pos", "date", "number", "reference", "due_date", F.size("total").alias("totals"), F.size("raw").alias("cells")
    )


@query(
    "header_mappings",
    with_tables(
        ("statements_flat",),
        f"SELECT statement_id, detected AS header, field FROM statements_flat s JOIN ({HEADERS}) h ON h.layout = s.layout",
    ),
)
def header_mappings(t):
    out = shaping.build_header_mapping(t.statements().drop("header_mapping"))
    return out.select("statement_id", F.explode("header_mapping").alias("header", "field"))


_CONVERT = f"TRY_CAST(replace({separators_sql('body')}, ' ', '') AS DECIMAL(38,10))"
_BODIES = """SELECT *, CASE WHEN s LIKE '(%' THEN -1 ELSE 1 END AS sign, CASE WHEN s LIKE '(%' THEN s[2:-2] ELSE s END AS body
  FROM (SELECT *, trim(regexp_replace(amount_text, '^[A-Za-z€$£¥₹]{1,3}\\s*', '')) AS s FROM items_flat) b"""


@query(
    "converted_totals",
    with_tables(("items_flat",), f"SELECT k, {money_sql('sign * ' + _CONVERT)} AS amount FROM ({_BODIES}) q"),
)
def converted_totals(t):
    label = F.when(F.col("layout") == 2, "Amount").otherwise("Balance")
    return shaping.postprocess_totals(t.items()).select("k", money(F.try_element_at("total_amounts", label)).alias("amount"))


@query(
    "conversion_failures",
    with_tables(
        ("items_flat",),
        f"""SELECT k AS item_seq, label, 'x' || amount_text AS text FROM ({_BODIES}) q JOIN (VALUES (0, 'Balance'), (1, 'Balance'), (1, 'Total'), (2, 'Amount')) v(la, label) ON la = layout WHERE amount_text LIKE '(%'""",
    ),
)
def conversion_failures(t):
    # 'x(1.00)' loses its letter, 'xR1.00' too; a doubled sign makes the rest unreadable.
    broken = t.items().withColumn(
        "total",
        F.map_filter(
            F.transform_values("total", lambda k, v: F.when(k.isin("Debit", "Credit"), F.lit("")).when(v.startswith("("), F.concat(F.lit("x"), v)).otherwise(v)),
            lambda k, v: v != "",
        ),
    )
    marked = broken.withColumn("total", F.transform_values("total", lambda _, v: F.when(v.startswith("x"), F.concat(v, F.lit("?"))).otherwise(v)))
    out = shaping.conversion_failures(marked)
    return out.select("item_seq", "label", F.regexp_replace("text", r"\?$", "").alias("text"))


@query(
    "assigned_item_ids",
    with_tables(
        ("items_flat",),
        """SELECT statement_id, k, row_number() OVER (PARTITION BY statement_id ORDER BY item_seq) AS item_seq,
           concat(statement_id, '#item-', lpad(CAST(row_number() OVER (PARTITION BY statement_id ORDER BY item_seq) AS VARCHAR), 4, '0')) AS statement_item_id FROM items_flat""",
    ),
)
def assigned_item_ids(t):
    # A chunk per residue keeps the order; places in a chunk are dense.
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("statement_id").orderBy("item_seq")) - 1
    items = t.items().withColumn("i", place).withColumn("chunk_index", F.floor(F.col("i") / 3)).withColumn("row_pos", F.col("i") % 3)
    return shaping.assign_item_ids(items.drop("item_seq", "statement_item_id")).select("statement_id", "k", "item_seq", "statement_item_id")


@query(
    "statement_date_ranges",
    with_tables(
        ("items_flat",),
        f"SELECT statement_id, min({strptime_sql('date_text')}) AS earliest, max({strptime_sql('date_text')}) AS latest FROM items_flat GROUP BY statement_id",
    ),
)
def statement_date_ranges(t):
    out = shaping.statement_date_range(t.items(), DATE_FORMATS)
    return out.select("statement_id", iso("earliest_item_date").alias("earliest"), iso("latest_item_date").alias("latest"))


@query(
    "date_confidences",
    with_tables(
        ("items_flat",),
        """SELECT statement_id, CASE WHEN min(ck % 4) = 2 THEN 'high' WHEN max(CASE WHEN day(day) > 12 OR month(day) > 12 THEN 1 ELSE 0 END) = 1 THEN 'high' ELSE 'low' END AS date_confidence
           FROM items_flat GROUP BY statement_id""",
    ),
)
def date_confidences(t):
    return shaping.date_confidence(t.items()).select("statement_id", "date_confidence")


@query(
    "planned_page_chunks",
    with_tables(
        ("statements_flat",),
        """SELECT statement_id, c AS chunk_index, c * 9 + 1 AS start_page, least(c * 9 + 10, pages) AS end_page
           FROM statements_flat, unnest(generate_series(0, pages)) AS t(c) WHERE c = 0 OR c * 9 + 1 < pages""",
    ),
)
def planned_page_chunks(t):
    return shaping.plan_page_chunks(t.statements()).select("statement_id", "chunk_index", "start_page", "end_page")


@query(
    "merged_chunks",
    with_tables(
        ("items_flat",),
        """SELECT statement_id, date_text AS date, number, reference, CASE WHEN layout = 1 THEN due_text ELSE '' END AS due_date, amount_text AS amount FROM items_flat""",
    ),
)
def merged_chunks(t):
    out = shaping.merge_chunks(t.chunks())
    amount = F.coalesce(F.try_element_at("total", F.lit("Balance")), F.try_element_at("total", F.lit("Amount")))
    return out.select("statement_id", "date", "number", "reference", "due_date", amount.alias("amount"))


@query(
    "merged_items_numbered",
    with_tables(
        ("items_flat",),
        """SELECT statement_id, concat(statement_id, '#item-', lpad(CAST(row_number() OVER (PARTITION BY statement_id ORDER BY item_seq) AS VARCHAR), 4, '0')) AS statement_item_id, date_text AS date FROM items_flat""",
    ),
)
def merged_items_numbered(t):
    return shaping.assign_item_ids(shaping.merge_chunks(t.chunks())).select("statement_id", "statement_item_id", "date")


@query(
    "without_adjacent_duplicates",
    with_tables(
        ("items_flat",),
        """SELECT k FROM (SELECT k, style, lag(style) OVER w AS before, i, lag(i) OVER w AS i_before FROM (SELECT k, statement_id, CAST(style % 2 AS BIGINT) AS style,
           row_number() OVER (PARTITION BY statement_id ORDER BY item_seq) AS i FROM items_flat) a WINDOW w AS (PARTITION BY statement_id ORDER BY i)) b WHERE before IS NULL OR before <> style""",
    ),
)
def without_adjacent_duplicates(t):
    numbered = assigned_item_ids(t).select("statement_id", "k", "item_seq")
    items = t.items().drop("item_seq", "statement_item_id").join(numbered, ["statement_id", "k"]).withColumn("style", F.col("style") % 2)
    return shaping.drop_adjacent_duplicates(items, ["style"]).select("k")


@query(
    "chunk_metadata_conflicts",
    with_tables(
        ("items_flat",),
        """SELECT DISTINCT statement_id, chunk_index, 'OTHER' AS date_format, date_format AS canonical_format FROM lines WHERE chunk_index > 0 AND chunk_index % 2 = 1""",
        {"lines": LINES},
    ),
)
def chunk_metadata_conflicts(t):
    odd = F.when(F.col("chunk_index") % 2 == 1, "OTHER").otherwise(F.col("date_format"))
    out = shaping.chunk_metadata_audit(t.chunks().withColumn("date_format", odd))
    return out.select("statement_id", "chunk_index", "date_format", "canonical_format")


@query(
    "confirmed_date_formats",
    with_tables(
        ("items_flat",),
        """SELECT statement_id, CASE WHEN min(ck % 4) = 2 THEN 'D MMM YYYY' WHEN min(ck % 4) = 1 THEN ''
           WHEN min(ck % 4) = 0 THEN CASE WHEN max(day(day)) > 12 THEN 'DD/MM/YYYY' ELSE '' END
           ELSE CASE WHEN max(day(day)) > 12 THEN 'MM/DD/YYYY' ELSE '' END END AS confirmed_format FROM items_flat GROUP BY statement_id""",
    ),
)
def confirmed_date_formats(t):
    # Day-first statements come with a month-first proposal and the other way round.
    swapped = (
        F.when(F.col("date_format") == "DD/MM/YYYY", "MM/DD/YYYY").when(F.col("date_format") == "MM/DD/YYYY", "DD/MM/YYYY").otherwise(F.col("date_format"))
    )
    return shaping.disambiguate_date_format(t.items().withColumn("date_format", swapped)).select("statement_id", "confirmed_format")


def _long_cells(t):
    """The raw cells of every item in long form."""
    items = t.items()
    return items.select(
        "tenant_id", "statement_id", "item_seq", F.posexplode(F.map_entries("raw")).alias("header_pos", "e")
    ).select("tenant_id", "statement_id", "item_seq", "header_pos", F.col("e.key").alias("header"), F.col("e.value").alias("value"))


@query(
    "monetary_cells",
    with_tables(
        ("items_flat",),
        f"""SELECT k AS item_seq, header, trim(value) AS value FROM (SELECT k, layout, h.header, {RAW.replace("CASE header", "CASE h.header")} AS value FROM items_flat f JOIN ({HEADERS}) h USING (layout)) q
            WHERE trim(value) <> '' AND ((layout = 0 AND header IN ('Debit', 'Credit')) OR
            (layout <> 0 AND header <> 'date' AND regexp_matches(value, '\\d') AND regexp_matches(value, '[.,'' ]') AND NOT regexp_matches(value, '^\\d{{1,4}}[/\\-.]\\d{{1,2}}[/\\-.]\\d{{1,4}}$')))""",
    ),
)
def monetary_cells(t):
    statements = t.statements()
    named = statements.where("layout = 0").select("tenant_id", "statement_id", F.explode(F.array(F.lit("debit"), F.lit(" CREDIT "))).alias("header"))
    excluded = statements.select("tenant_id", "statement_id", F.lit("Date").alias("header"))
    return shaping.monetary_values(_long_cells(t), named, excluded).select("item_seq", "header", "value")


@query(
    "statement_separators",
    with_tables(
        ("items_flat",),
        """SELECT statement_id, style, CASE WHEN style IN (1, 2) THEN ',' ELSE '.' END AS decimal_separator,
           CASE WHEN style = 1 THEN '.' WHEN style = 2 AND max(cents) >= 100000 THEN ' ' WHEN style = 2 THEN '.' ELSE ',' END AS thousands_separator FROM items_flat GROUP BY statement_id, style""",
    ),
)
def statement_separators(t):
    found = t.items().select("statement_id", "style", F.col("amount_text").alias("value"))
    return shaping.disambiguate_separators(found, ["statement_id", "style"])


@query(
    "common_date_patterns",
    with_tables(
        ("items_flat",),
        """SELECT pattern, samples FROM (SELECT regexp_replace(date_text, '[\\p{L}\\p{N}]', 'A', 'g') AS pattern, count(*) AS samples, min(k) AS first_seen FROM items_flat GROUP BY 1) q ORDER BY samples DESC, first_seen LIMIT 3""",
    ),
)
def common_date_patterns(t):
    return shaping.common_formats(t.items(), "date_text", "k", 3).select("pattern", "samples")


@query(
    "common_patterns_by_statement",
    with_tables(
        ("items_flat",),
        """SELECT statement_id, pattern, samples FROM (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY samples DESC, first_seen) AS rn FROM (
           SELECT statement_id, regexp_replace(amount_text, '[\\p{L}\\p{N}]', 'A', 'g') AS pattern, count(*) AS samples, min(k) AS first_seen FROM items_flat GROUP BY 1, 2) q) r WHERE rn <= 2""",
    ),
)
def common_patterns_by_statement(t):
    return shaping.common_formats(t.items(), "amount_text", "k", 2, ["statement_id"]).select("statement_id", "pattern", "samples")


@query(
    "displayed_headers",
    with_tables(
        ("statements_flat",),
        f"""SELECT statement_id, header, field, row_number() OVER (PARTITION BY statement_id ORDER BY {CELL_ORDER}) - 1 AS place FROM statements_flat JOIN ({SHOWN}) s USING (layout)""",
    ),
)
def displayed_headers(t):
    out = shaping.display_headers(t.statements())
    return out.select("statement_id", F.posexplode("headers").alias("place", "h")).select("statement_id", "place", "h.header", "h.field")


@query(
    "number_headers",
    with_tables(("statements_flat",), "SELECT statement_id, CASE WHEN layout = 1 THEN 'reference' ELSE 'number' END AS number_header FROM statements_flat"),
)
def number_headers(t):
    return shaping.item_number_header(t.statements()).select("statement_id", "number_header")


@query(
    "statement_cells",
    with_tables(("items_flat",), f"SELECT k AS item_seq, header_pos, header, field, value FROM ({CELLS}) c"),
)
def statement_cells(t):
    rows = shaping.statement_cells(t.items(), shaping.display_headers(t.statements()), DATE_FORMATS)
    return shaping.explode_cells(rows).select("item_seq", "header_pos", "header", "field", "value")


@query(
    "prepared_rows",
    with_tables(
        ("items_flat",),
        f"SELECT k AS item_seq, trim(max(number_text)) AS row_key, count(*) AS cells, string_agg(value, '|' ORDER BY header_pos) AS shown FROM ({CELLS}) c GROUP BY k",
    ),
)
def prepared_rows(t):
    rows = shaping.prepare_display(t.statements(), t.items())
    return rows.select(
        "item_seq", "row_key", F.size("cells").cast("bigint").alias("cells"), F.array_join(F.transform("cells", lambda c: c["value"]), "|").alias("shown")
    )


# --- quality -----------------------------------------------------------------------------------


@query(
    "extraction_runs",
    with_tables(
        ("statements_flat",),
        """SELECT filename, count(*) AS chunks, CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(items) AS BIGINT) AS items, CAST(sum(tin) AS BIGINT) AS input_tokens, CAST(sum(tout) AS BIGINT) AS output_tokens,
           CAST(round(sum(CAST((tin * 1.0 + tout * 5.0) / 1000000 AS DECIMAL(20,8))), 4) AS DOUBLE) AS cost_usd, CAST(sum(CASE WHEN k % 20 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS failures
           FROM (SELECT tenant_id AS filename, pages, pages * 12 AS items, k * 7 AS tin, k * 3 AS tout, k FROM statements_flat) q GROUP BY ROLLUP (filename)""",
    ),
)
def extraction_runs(t):
    files = t.derive("statements_flat").select(
        F.col("tenant_id").alias("filename"),
        "pages",
        (F.col("pages") * 12).alias("items"),
        (F.col("k") * 7).alias("input_tokens"),
        (F.col("k") * 3).alias("output_tokens"),
        (F.col("k") % 20 == 0).alias("failed"),
    )
    return quality.extraction_run_summary(files)


@query(
    "differing_item_fields",
    with_tables(
        ("items_flat",),
        """SELECT statement_id AS scenario, item_seq, 'reference' AS field FROM items_flat WHERE k % 9 = 0 AND statement_id NOT IN (SELECT statement_id FROM items_flat WHERE k % 23 = 0)
           UNION ALL SELECT DISTINCT statement_id, NULL, 'item_count' FROM items_flat WHERE k % 23 = 0""",
    ),
)
def differing_item_fields(t):
    expected = t.items().withColumn("scenario", F.col("statement_id"))
    changed = F.when(F.col("k") % 9 == 0, F.concat("reference", F.lit("!"))).otherwise(F.concat(F.lit(" "), "reference"))
    actual = expected.where(F.col("k") % 23 != 0).withColumn("reference", changed)
    return quality.diff_items(expected, actual).select("scenario", "item_seq", "field")


@query(
    "differing_totals",
    with_tables(
        ("items_flat",),
        """SELECT statement_id AS scenario, item_seq, label FROM items_flat JOIN (VALUES (0, 'Debit'), (0, 'Credit'), (0, 'Balance'), (1, 'Total'), (1, 'Balance'), (2, 'Amount')) v(la, label) ON la = layout
           WHERE (k % 10 = 1 AND NOT (label = 'Debit' AND is_credit = 1) AND NOT (label = 'Credit' AND is_credit = 0)) OR (k % 10 = 2 AND label = 'Balance')""",
    ),
)
def differing_totals(t):
    expected = shaping.postprocess_totals(t.items()).withColumn("scenario", F.col("statement_id"))
    shift = F.when(F.col("k") % 10 == 1, 0.02).when(F.col("k") % 10 == 3, 0.01).otherwise(0).cast("decimal(10,2)")
    moved = F.transform_values("total_amounts", lambda _, v: (v + F.col("shift")).cast("decimal(38,10)"))
    actual = expected.withColumn("shift", shift).withColumn("total_amounts", moved)
    dropped = F.map_filter("total_amounts", lambda label, _: (F.col("k") % 10 != 2) | (label != "Balance"))
    actual = actual.withColumn("total_amounts", dropped)
    return quality.diff_totals(expected, actual).select("scenario", "item_seq", "label")


@query(
    "differing_metadata",
    with_tables(
        ("statements_flat",),
        """SELECT statement_id AS scenario, 'date_format' AS field FROM statements_flat WHERE k % 4 <> 0 AND k % 5 = 0
           UNION ALL SELECT statement_id, 'header_mapping' FROM statements_flat WHERE k % 6 = 1""",
    ),
)
def differing_metadata(t):
    expected = t.statements().withColumn("scenario", F.col("statement_id")).withColumn("date_confidence", F.lit("high"))
    other = F.when(F.col("k") % 5 == 0, "DD/MM/YYYY").otherwise(F.col("date_format"))
    fewer = F.map_filter("header_mapping", lambda _, f: (F.col("k") % 6 != 1) | (f != "total"))
    actual = expected.withColumn("date_format", other).withColumn("header_mapping", fewer)
    return quality.diff_metadata(expected, actual).select("scenario", "field")
