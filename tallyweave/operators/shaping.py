"""From extracted page chunks to statement rows ready for display."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions import amounts, dates
from tallyweave.functions.arrays import bound, unfold
from tallyweave.functions.text import has_text, header_key, strip, stripped
from tallyweave.schemas import STANDARD_FIELDS, STATEMENT_KEYS
from tallyweave.session import checkpoint_folder

# How amount columns are recognised, most telling group first.
AMOUNT_TIERS = (
    ("debit", "dr", "invoices", "charges", "amount", "credit", "cr", "credit notes", "payments"),
    ("total",),
    ("balance",),
)

# Display order of the columns that are no amounts.
FIELD_ORDER = ("date", "due_date", "number", "reference")

# Fixed value: two numbers that could be day and month, then a year.
NUMERIC_DATE = r"^(\d{1,2})\s*[/\-.]\s*(\d{1,2})\s*[/\-.]\s*(\d{2,4})$"

# Characters that can part the digits of an amount.
SEPARATORS = (".", ",", "'", " ")

_CHUNK_KEYS = [*STATEMENT_KEYS, "chunk_index"]


# --- chunks to items ---------------------------------------------------------------------------


def _padded(row: Column, order: Column) -> Column:
    """The cells of a row, one per column; '' where the row is short, extra cells ignored."""
    return F.transform(order, lambda _, i: F.coalesce(F.get(row, i), F.lit("")))


def reconstruct_items(chunks: DataFrame) -> DataFrame:
    """One row per extracted line: standard fields, ``total`` and ``raw`` maps.

    ``cells`` keeps the line in column order next to ``column_order``.
    """
    return _items_of_lines(chunks.select(*_CHUNK_KEYS, "column_order", F.posexplode("rows").alias("row_pos", "row")))


def _items_of_lines(lines: DataFrame) -> DataFrame:
    lines = lines.withColumn("cells", _padded(F.col("row"), F.col("column_order"))).drop("row")
    raw = F.map_from_arrays("column_order", "cells")

    def standard(field: str) -> Column:
        entries = F.filter(
            F.arrays_zip(F.col("column_order").alias("k"), F.col("cells").alias("v")), lambda e: F.lower(e["k"]) == field
        )
        return F.coalesce(F.try_element_at(entries, F.lit(-1))["v"], F.lit(""))

    return lines.select(
        *_CHUNK_KEYS,
        "row_pos",
        *[standard(f).alias(f) for f in STANDARD_FIELDS],
        F.map_filter(raw, lambda k, _: ~F.lower(k).isin(*STANDARD_FIELDS)).alias("total"),
        raw.alias("raw"),
        "column_order",
        "cells",
    )


def build_header_mapping(statements: DataFrame) -> DataFrame:
    """Add ``header_mapping``: detected header to standard field, or to 'total'."""
    size = F.least(F.size("detected_headers"), F.size("column_order"))
    fields = F.transform(
        F.slice("column_order", F.lit(1), size),
        lambda c: F.when(F.lower(c).isin(*STANDARD_FIELDS), F.lower(c)).otherwise("total"),
    )
    return statements.withColumn(
        "header_mapping", F.map_from_arrays(F.slice("detected_headers", F.lit(1), size), fields)
    )


def postprocess_totals(items: DataFrame) -> DataFrame:
    """Add ``total_amounts``: the total map with amounts parsed; unreadable labels hold null."""
    return items.withColumn(
        "total_amounts", F.transform_values("total", lambda _, v: amounts.convert_amount(v))
    )


def conversion_failures(items: DataFrame) -> DataFrame:
    """The non-blank total cells that ``postprocess_totals`` could not read."""
    cells = items.select(
        *[c for c in (*STATEMENT_KEYS, "chunk_index", "row_pos", "item_seq") if c in items.columns],
        F.explode("total").alias("label", "text"),
    )
    return cells.where(has_text("text") & amounts.convert_amount("text").isNull())


def assign_item_ids(items: DataFrame) -> DataFrame:
    """Add the dense 1-based ``item_seq`` and ``<statement>#item-0001`` ids, in chunk and row order.

    Only one row per chunk is ordered by a window; a row's place is its chunk's offset plus its
    place in the chunk, so a statement of any length spreads over many tasks. Rows whose places in
    a chunk have gaps (after overlap removal) are numbered from the first place kept.
    """
    chunks = items.groupBy(*_CHUNK_KEYS).agg(
        F.count("*").alias("n"), F.min("row_pos").alias("first_pos")
    )
    before = Window.partitionBy(*STATEMENT_KEYS).orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunks.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    numbered = items.join(offsets, _CHUNK_KEYS)
    seq = (F.col("offset") + F.col("row_pos") - F.col("first_pos") + 1).cast("int")
    return (
        numbered.withColumn("item_seq", seq)
        .withColumn(
            "statement_item_id",
            F.concat(
                "statement_id",
                F.lit("#item-"),
                # Four digits at least; longer numbers keep all of theirs.
                F.when(F.col("item_seq") > 9999, F.col("item_seq").cast("string")).otherwise(
                    F.lpad(F.col("item_seq").cast("string"), 4, "0")
                ),
            ),
        )
        .drop("offset", "first_pos")
    )


def plan_page_chunks(statements: DataFrame, size: int = 10, overlap: int = 1) -> DataFrame:
    """Page ranges of each statement (``pages``), 1-based and inclusive, with shared edge pages."""
    step = size - overlap
    pages = F.col("pages")
    starts = F.filter(
        F.sequence(F.lit(0), F.greatest(pages - 1, F.lit(0)), F.lit(step)),
        lambda s: (pages > 0) & ((s == 0) | (s + overlap < pages)),
    )
    return (
        statements.select(*STATEMENT_KEYS, "pages", F.posexplode(starts).alias("chunk_index", "start"))
        .withColumn("start_page", F.col("start") + 1)
        .withColumn("end_page", F.least(F.col("start") + size, "pages"))
        .drop("start", "pages")
    )


def merge_chunks(chunks: DataFrame) -> DataFrame:
    """The chunks' lines in order, without the lines that a chunk repeats from the end of all before.

    What is merged so far always ends with the whole previous chunk, so an overlap is found by
    comparing a chunk with its predecessor: an equi-join on the chunk number, of line digests only.
    Where a chunk is longer than its predecessor and starts with a line known from an earlier one,
    the overlap may reach further back; such a chunk is compared with as many merged lines as it has,
    fetched by their absolute numbers. No task holds more of a statement than one chunk
    and the lines it is compared with. The lines themselves never leave their chunk.
    """
    digested = chunks.select(
        *_CHUNK_KEYS,
        F.transform(
            "rows", lambda r: F.md5(F.to_json(F.array_sort(F.map_entries(F.map_from_arrays("column_order", _padded(r, F.col("column_order")))))))
        ).alias("digests"),
    )
    # Chunks without lines neither overlap nor stand between two others.
    digested = digested.where(F.size("digests") > 0)
    # Read several times below, and narrow: written to the checkpoint folder once.
    checkpoint_folder(chunks.sparkSession)
    positions = _chunk_ranks(digested.checkpoint()).checkpoint()
    previous = positions.select(
        *STATEMENT_KEYS, (F.col("rank") + 1).alias("rank"), F.col("digests").alias("before")
    )
    pairs = positions.join(previous, [*STATEMENT_KEYS, "rank"], "left")
    repeated = pairs.select(*_CHUNK_KEYS, "rank", F.size("digests").alias("n"), _overlap(F.col("before"), F.col("digests")).alias("repeated")).checkpoint()
    far = _reaching_further_back(pairs).checkpoint()
    if not far.isEmpty():
        repeated = _settled_overlaps(repeated, positions, far)
    lines = chunks.join(repeated.select(*_CHUNK_KEYS, "repeated"), _CHUNK_KEYS, "left").select(
        *_CHUNK_KEYS, "column_order", "repeated", F.posexplode("rows").alias("row_pos", "row")
    )
    return _items_of_lines(lines.where(F.col("row_pos") >= F.coalesce("repeated", F.lit(0))))


def _chunk_ranks(digested: DataFrame) -> DataFrame:
    # One light row per chunk; the digests are joined back by chunk.
    order = Window.partitionBy(*STATEMENT_KEYS).orderBy("chunk_index")
    ranks = digested.select(*_CHUNK_KEYS).withColumn("rank", F.row_number().over(order))
    return digested.join(ranks, _CHUNK_KEYS)


def _overlap(existing: Column, incoming: Column) -> Column:
    """Length of the prefix of ``incoming`` that repeats the end of ``existing``.

    The search starts at the first place of incoming's first line within the last
    ``size(incoming)`` lines of existing; the rest must then agree to the end.
    """
    tail = F.when(
        F.size(existing) > F.size(incoming), F.slice(existing, F.size(existing) - F.size(incoming) + 1, F.size(incoming))
    ).otherwise(existing)
    place = F.array_position(tail, F.get(incoming, 0)).cast("int")
    length = F.size(tail) - place + 1
    agrees = F.slice(tail, F.greatest(place, F.lit(1)), F.greatest(length, F.lit(0))) == F.slice(
        incoming, F.lit(1), F.greatest(length, F.lit(0))
    )
    return F.when((place > 0) & agrees, length).otherwise(0)


def _reaching_further_back(pairs: DataFrame) -> DataFrame:
    """Chunks that are longer than their predecessor and start with a line older than it."""
    longer = pairs.where(F.size("digests") > F.size("before")).select(*_CHUNK_KEYS, "rank", "digests", F.get("digests", F.lit(0)).alias("digest"))
    lines = pairs.select(*STATEMENT_KEYS, "rank", F.explode("digests").alias("digest"))
    oldest = lines.groupBy(*STATEMENT_KEYS, "digest").agg(F.min("rank").alias("oldest"))
    seen = longer.join(oldest, [*STATEMENT_KEYS, "digest"]).where(F.col("oldest") < F.col("rank") - 1)
    return seen.select(*_CHUNK_KEYS, "digests")


def _settled_overlaps(repeated: DataFrame, positions: DataFrame, far: DataFrame) -> DataFrame:
    """The chunks' overlaps with the merged lines, from those with their predecessors alone.

    Overlaps give every merged line its number, and the numbers give each chunk of ``far`` the lines
    before it, as many as it has, to be compared with anew. An overlap depends on earlier ones only, so each round settles one
    more chunk of a statement at least, mostly all; rounds end when nothing changes.
    """
    keys = far.select(*STATEMENT_KEYS).distinct()
    lines = positions.join(keys, STATEMENT_KEYS, "left_semi").select(*_CHUNK_KEYS, F.posexplode("digests").alias("i", "digest")).checkpoint()
    order = Window.partitionBy(*STATEMENT_KEYS).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        starts = repeated.withColumn("start", F.coalesce(F.sum(F.col("n") - F.col("repeated")).over(order), F.lit(0)))
        placed = starts.join(keys, STATEMENT_KEYS, "left_semi")
        merged = lines.join(placed, _CHUNK_KEYS).where(F.col("i") >= F.col("repeated"))
        merged = merged.select(*STATEMENT_KEYS, (F.col("start") + F.col("i") - F.col("repeated")).alias("line"), "digest")
        asked = placed.join(far.select(*_CHUNK_KEYS), _CHUNK_KEYS, "left_semi").where("start > 0")
        wanted = asked.select(*_CHUNK_KEYS, F.explode(F.sequence(F.greatest(F.col("start") - F.col("n"), F.lit(0)), F.col("start") - 1)).alias("line"))
        tails = wanted.join(merged, [*STATEMENT_KEYS, "line"]).groupBy(*_CHUNK_KEYS).agg(F.array_sort(F.collect_list(F.struct("line", "digest"))).alias("tail"))
        tails = tails.join(far, _CHUNK_KEYS).select(*_CHUNK_KEYS, _overlap(F.col("tail.digest"), F.col("digests")).alias("again"))
        settled = repeated.join(tails, _CHUNK_KEYS, "left").withColumn("new", F.coalesce("again", "repeated")).checkpoint()
        repeated = settled.select(*_CHUNK_KEYS, "rank", "n", F.col("new").alias("repeated"))
        if settled.where(F.col("new") != F.col("repeated")).isEmpty():
            return repeated


def drop_adjacent_duplicates(items: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop a row whose columns all equal those of the row before it (``item_seq`` - 1).

    The neighbour is found by an equi-join on the dense number, so no statement is gathered.
    """
    digest = F.md5(F.to_json(F.struct(*columns)))
    rows = items.withColumn("digest", digest)
    before = rows.select(*STATEMENT_KEYS, (F.col("item_seq") + 1).alias("item_seq"), "digest")
    return rows.join(before, [*STATEMENT_KEYS, "item_seq", "digest"], "left_anti").drop("digest")


def chunk_metadata_audit(chunks: DataFrame) -> DataFrame:
    """Chunks whose date format is given but differs from the first chunk's."""
    first = chunks.groupBy(*STATEMENT_KEYS).agg(
        F.min_by("date_format", "chunk_index").alias("canonical_format"), F.min("chunk_index").alias("first_chunk")
    )
    later = chunks.join(first, STATEMENT_KEYS).where(F.col("chunk_index") > F.col("first_chunk"))
    differs = (F.coalesce("date_format", F.lit("")) != "") & ~F.col("date_format").eqNullSafe(F.col("canonical_format"))
    return later.where(differs).select(*_CHUNK_KEYS, "date_format", "canonical_format")


# --- dates and separators of a statement -------------------------------------------------------


def statement_date_range(items: DataFrame, templates: Iterable[str], lenient: bool = False) -> DataFrame:
    """First and last item date per statement; a date that does not fit the format is ignored."""
    parsed = dates.parse_by_template("date", "date_format", templates, lenient)
    return items.groupBy(*STATEMENT_KEYS).agg(
        F.min(parsed).alias("earliest_item_date"), F.max(parsed).alias("latest_item_date")
    )


def date_confidence(items: DataFrame) -> DataFrame:
    """'low' where day and month could be swapped in every date of a statement, else 'high'.

    Items carry the ``date_format`` of their statement.
    """
    fmt = F.coalesce("date_format", F.lit(""))
    mark = F.regexp_extract(fmt, r"([^DMYdoy])", 1)
    # split() takes a pattern; every mark is quoted.
    format_parts = F.when(mark != "", F.split(fmt, F.concat(F.lit(r"\Q"), mark, F.lit(r"\E")), -1))
    date_parts = F.when(mark != "", F.split(F.coalesce("date", F.lit("")), F.concat(F.lit(r"\Q"), mark, F.lit(r"\E")), -1))
    year_at = F.array_position(F.transform(format_parts, lambda p: p.startswith("Y")), F.lit(True)) - 1
    settled = fmt.contains("MMM") | (mark == "") | (F.size(format_parts) != 3) | (year_at < 0)
    clear = F.exists(
        F.filter(date_parts, lambda _, i: i != year_at),
        lambda p: F.coalesce(strip(p).try_cast("int") > 12, F.lit(True)),
    )
    return items.groupBy(*STATEMENT_KEYS).agg(
        F.when(
            F.bool_or(F.coalesce(settled, F.lit(True)))
            | F.bool_or(F.coalesce((F.size(date_parts) == 3) & clear, F.lit(False))),
            "high",
        )
        .otherwise("low")
        .alias("date_confidence")
    )


def disambiguate_date_format(items: DataFrame, proposed: str = "date_format") -> DataFrame:
    """Day-first or month-first, decided from all dates of a statement.

    ``confirmed_format`` is the proposal with day and month in the proven order, or '' when the
    dates prove nothing (or both). Formats with month names are taken as they are.
    """
    text = stripped("date")
    first = F.regexp_extract(text, NUMERIC_DATE, 1).try_cast("int")
    second = F.regexp_extract(text, NUMERIC_DATE, 2).try_cast("int")
    seen = items.groupBy(*STATEMENT_KEYS).agg(
        F.first(proposed, ignorenulls=True).alias("proposed_format"),
        F.count_if(has_text("date")).alias("given"),
        F.coalesce(F.bool_or(first > 12), F.lit(False)).alias("day_first"),
        F.coalesce(F.bool_or(second > 12), F.lit(False)).alias("month_first"),
    )
    fmt = F.coalesce("proposed_format", F.lit(""))
    to_day_first = F.regexp_replace(fmt, r"^(M{1,2})([\s/\-.]+)(D{1,2}|Do)", "$3$2$1")
    to_month_first = F.regexp_replace(fmt, r"^(D{1,2}|Do)([\s/\-.]+)(M{1,2})", "$3$2$1")
    return seen.withColumn(
        "confirmed_format",
        F.when(F.col("given") == 0, "")
        .when(fmt.contains("MMM"), fmt)
        .when(F.col("day_first") & ~F.col("month_first"), to_day_first)
        .when(F.col("month_first") & ~F.col("day_first"), to_month_first)
        .otherwise(""),
    ).drop("given", "day_first", "month_first")


def looks_monetary(value: Column) -> Column:
    date_like = value.rlike(r"^\d{1,4}[/\-.]\d{1,2}[/\-.]\d{1,4}$")
    return value.rlike(r"\d") & value.rlike(r"[.,' ]") & ~date_like


def monetary_values(cells: DataFrame, total_columns: DataFrame, excluded_columns: DataFrame | None = None) -> DataFrame:
    """Amount texts of each statement.

    ``cells`` is the long cell table (``header``, ``value``). Cells under a named total column count;
    a statement with none of them falls back to every monetary-looking cell outside the excluded
    columns. Of headers that repeat, the first one is meant.
    """
    name = F.lower(F.trim("header")).alias("name")
    placed = [*STATEMENT_KEYS, "name", "header_pos"]
    named_cells = cells.select("*", name)
    # The first place of every header of a statement, and whether it holds a text anywhere; two passes over the cells in all.
    first_places = (
        named_cells.groupBy(*placed)
        .agg(F.bool_or(stripped("value") != "").alias("filled"))
        .groupBy(*STATEMENT_KEYS, "name")
        .agg(F.min("header_pos").alias("header_pos"), F.min_by("filled", "header_pos").alias("filled"))
    )

    def places(columns: DataFrame, mark: str) -> DataFrame:
        return columns.select(*STATEMENT_KEYS, name, F.lit(mark).alias("mark")).distinct().join(first_places, [*STATEMENT_KEYS, "name"])

    in_total = places(total_columns, "total")
    marks = in_total if excluded_columns is None else in_total.unionByName(places(excluded_columns, "excluded"))
    marks = marks.groupBy(*placed).agg(F.bool_or(F.col("mark") == "total").alias("in_total"), F.first("filled").alias("filled"))
    settled = F.bool_or(F.col("in_total") & F.col("filled")).alias("settled")
    by_statement = marks.groupBy(*STATEMENT_KEYS).agg(settled, F.collect_list(F.struct("name", "header_pos", "in_total")).alias("marks"))
    texts = named_cells.withColumn("value", stripped("value")).where(F.col("value") != "").join(by_statement, STATEMENT_KEYS, "left")
    own = F.filter("marks", lambda m: (m["name"] == F.col("name")) & (m["header_pos"] == F.col("header_pos")))
    total = F.coalesce(F.exists(own, lambda m: m["in_total"]), F.lit(False))
    free = ~F.coalesce("settled", F.lit(False)) & (F.coalesce(F.size(own), F.lit(0)) <= 0)
    return texts.where(total | (free & looks_monetary(F.col("value")))).drop("name", "settled", "marks")


def separator_roles(value: Column) -> Column:
    """Evidence of one amount text: an array of 'd' (decimal) or 't' (group) plus the character."""
    text = strip(value)
    bare = F.when(
        text.startswith("(") & text.endswith(")") & (F.length(text) > 1), F.substring(text, F.lit(2), F.length(text) - 2)
    ).otherwise(text)
    digits = strip(F.regexp_replace(bare, r"[^\d.,'\s\-]", ""))
    digits = F.regexp_replace(F.regexp_replace(digits, r"^-", ""), r"[-+]$", "")
    several = F.length(F.regexp_replace(digits, r"[^.,' ]", "")) > 0
    last = F.regexp_extract(digits, r"([.,' ])[^.,' ]*$", 1)
    roles = []
    kinds = sum(((digits.contains(s)).cast("int") for s in SEPARATORS), F.lit(0))
    for mark in SEPARATORS:
        count = F.length(digits) - F.length(F.replace(digits, F.lit(mark), F.lit("")))
        after = F.substring_index(digits, mark, -1)
        decimal = (count == 1) & after.rlike(r"^\d{1,2}$")
        roles.append(
            F.when(
                several & (count > 0),
                F.array_distinct(
                    F.concat(
                        F.array(F.concat(F.when(decimal, "d").otherwise("t"), F.lit(mark))),
                        F.when(
                            kinds >= 2, F.array(F.concat(F.when(last == mark, "d").otherwise("t"), F.lit(mark)))
                        ).otherwise(F.array().cast("array<string>")),
                    )
                ),
            ).otherwise(F.array().cast("array<string>"))
        )
    return F.concat(*roles)


def disambiguate_separators(
    values: DataFrame, by: Sequence[str], proposed_decimal: str = ".", proposed_thousands: str = ","
) -> DataFrame:
    """Decimal and group separator of each statement, from all of its amount texts.

    A character with only one role anywhere is settled; with only one side settled, the other
    follows the proposal unless that would use the same character twice.
    """
    marks = [(role, mark) for mark in SEPARATORS for role in ("d", "t")]
    roles = separator_roles(F.col("value"))
    seen = values.withColumn("roles", roles).groupBy(*by).agg(
        *[
            F.bool_or(F.array_contains("roles", role + mark)).alias(f"{role}{i // 2}")
            for i, (role, mark) in enumerate(marks)
        ]
    )

    def settled(role: str, other: str) -> Column:
        return F.coalesce(
            *[F.when(F.col(f"{role}{i}") & ~F.col(f"{other}{i}"), F.lit(m)) for i, m in enumerate(SEPARATORS)]
        )

    decimal, group = settled("d", "t"), settled("t", "d")
    both_proposed = (F.lit(proposed_decimal), F.lit(proposed_thousands))
    return seen.select(
        *by,
        F.coalesce(
            decimal,
            F.when(group == proposed_decimal, both_proposed[1]).otherwise(both_proposed[0]),
        ).alias("decimal_separator"),
        F.coalesce(
            group,
            F.when(decimal == proposed_thousands, both_proposed[0]).otherwise(both_proposed[1]),
        ).alias("thousands_separator"),
    )


def common_formats(values: DataFrame, column: str, order: str, k: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """The k most frequent character patterns of a column; ties go to the pattern seen first."""
    patterns = values.groupBy(*by, dates.character_mask(column).alias("pattern")).agg(
        F.count("*").alias("samples"), F.min(order).alias("first_seen")
    )
    if not by:
        return patterns.orderBy(F.desc("samples"), "first_seen").limit(k)
    # Spark keeps only the first k of a group on each side of the shuffle.
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("samples"), "first_seen"))
    return patterns.withColumn("place", place).where(F.col("place") <= k).drop("place")


# --- columns to show ---------------------------------------------------------------------------


def display_headers(statements: DataFrame) -> DataFrame:
    """Add ``headers``, the columns to show as (pos, header, field), and ``number_header``.

    The raw columns come from ``column_order``. Each is mapped to a field by ``header_mapping``, or
    by its own name; unmapped ones are left out. Of the amount columns only the most telling
    tier stays. Everything happens inside the statement's own row.
    """
    normalised = F.map_from_entries(
        F.transform(
            F.map_entries("header_mapping"), lambda e: F.struct(header_key(e["key"]).alias("key"), e["value"].alias("value"))
        )
    )

    def named(header: Column, pos: Column) -> Column:
        return F.struct(pos.alias("pos"), header.alias("header"), header_key(header).alias("name"))

    def listed(mapping: Column) -> Callable[[Column], Column]:
        return lambda h: F.struct(
            h["pos"].alias("pos"), h["header"].alias("header"), h["name"].alias("name"), F.try_element_at(mapping, h["name"]).alias("listed")
        )

    def with_field(h: Column) -> Column:
        own = F.lower(h["header"])
        field = F.coalesce(F.when(h["listed"] != "", h["listed"]), F.when(own.isin(*STANDARD_FIELDS), own))
        return F.struct(h["pos"].alias("pos"), h["header"].alias("header"), h["name"].alias("name"), field.alias("field"))

    def ranked(h: Column) -> Column:
        tier = F.lit(9)
        for number, patterns in reversed(list(enumerate(AMOUNT_TIERS, start=1))):
            either = "|".join(patterns)
            tier = F.when(h["name"].rlike(f"^(?:{either})|(?:{either})$"), number).otherwise(tier)
        rank = F.lit(98)
        for number, field in enumerate(FIELD_ORDER):
            rank = F.when(h["field"] == field, number).otherwise(rank)
        is_total = h["field"] == "total"
        return F.struct(
            F.when(is_total, 99).otherwise(rank).alias("rank"),
            h["pos"].alias("pos"),
            h["header"].alias("header"),
            h["field"].alias("field"),
            F.when(is_total, tier).otherwise(0).alias("tier"),
        )

    # The mapping and the best tier are needed for each header: bound, they are made once a statement.
    found = bound(normalised, lambda mapping: F.transform(F.transform("column_order", named), listed(mapping)))
    with_fields = F.filter(F.transform(found, with_field), lambda h: h["field"].isNotNull())
    mapped = statements.withColumn("described", F.transform(with_fields, ranked))
    tiers = F.transform(F.filter("described", lambda h: h["tier"] > 0), lambda h: h["tier"])
    kept = bound(
        F.array_min(tiers), lambda best: F.filter("described", lambda h: (h["tier"] == 0) | ((h["tier"] == best) & (h["tier"] < 9)))
    )
    shown = mapped.withColumn("shown", F.array_sort(kept))

    def first_of(field: str) -> Column:
        return F.get(F.filter("shown", lambda h: h["field"] == field), 0)["header"]

    return (
        shown.withColumn(
            "headers",
            F.transform("shown", lambda h: F.struct(h["pos"].alias("pos"), h["header"].alias("header"), h["field"].alias("field"))),
        )
        .withColumn("number_header", F.coalesce(first_of("number"), first_of("reference")))
        .drop("described", "shown")
    )


def item_number_header(statements: DataFrame) -> DataFrame:
    """The header whose value identifies a row: number, else reference, else null."""
    return display_headers(statements).select(*STATEMENT_KEYS, "number_header")


def statement_cells(items: DataFrame, layouts: DataFrame, templates: Iterable[str]) -> DataFrame:
    """Add to each item its ``cells``, (pos, header, field, value) of the columns shown, and ``row_key``.

    ``layouts`` is the result of ``display_headers``; ``row_key`` is the trimmed display value of
    the identifying column. The join is on the statement and brings one row per statement.
    Dates are rewritten in the statement's format and amounts shown as absolute values (the ledger
    holds positive totals); other cells stay as they are.
    """
    templates = list(templates)
    joined = items.drop("contact_id", "date_format", "headers", "number_header").join(
        layouts.select(*STATEMENT_KEYS, "contact_id", "date_format", "headers", "number_header"), STATEMENT_KEYS
    )
    date_format = F.col("date_format")

    def read(h: Column) -> Column:
        text = F.coalesce(F.try_element_at("raw", h["header"]), F.lit(""))
        return F.struct(h["pos"].alias("pos"), h["header"].alias("header"), h["field"].alias("field"), text.alias("text"))

    def interpret(c: Column) -> Column:
        day = dates.coerce_by_template(c["text"], date_format, templates)
        return F.struct(
            c["pos"].alias("pos"),
            c["header"].alias("header"),
            c["field"].alias("field"),
            c["text"].alias("text"),
            F.when(c["field"].isin("date", "due_date"), day).alias("day"),
        )

    def show(c: Column) -> Column:
        day = dates.render_by_template(c["day"], date_format, templates)
        amount = amounts.format_amount(F.abs(amounts.display_amount(c["text"])))
        shown = F.when(c["field"].isin("date", "due_date"), day).when(c["field"] == "total", amount)
        return F.struct(
            c["pos"].alias("pos"),
            c["header"].alias("header"),
            c["field"].alias("field"),
            F.coalesce(shown, c["text"]).alias("value"),
        )

    cells = F.transform(F.transform(F.transform("headers", read), interpret), show)
    # The identifying cell is shown as it is, so the key needs none of the cells.
    key = stripped(F.try_element_at("raw", F.col("number_header")))
    return joined.withColumns({"cells": cells, "row_key": key}).drop("headers")


def explode_cells(rows: DataFrame, column: str = "cells") -> DataFrame:
    """The long cell table: one row per item and shown column, ``header_pos`` in display order."""
    cells = unfold(rows, [*STATEMENT_KEYS, "item_seq"], column, "cell", "header_pos")
    return cells.select(*STATEMENT_KEYS, "item_seq", "header_pos", "cell.*").drop("pos")


def prepare_display(statements: DataFrame, items: DataFrame, templates: Iterable[str] | None = None) -> DataFrame:
    """Headers, cells and row keys of every item.

    Statements are dealt out as the join needs them before their headers are worked out: they are few and small on disk, so
    a scan would do that in a task or two.
    """
    layouts = display_headers(statements.repartition(*STATEMENT_KEYS))
    if templates is None:
        templates = dates.templates_of(statements, "date_format")
    return statement_cells(items, layouts, templates)
