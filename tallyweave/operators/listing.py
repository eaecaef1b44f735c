"""Statement lists: order, labels, pages and counts."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.text import has_text, stripped
from tallyweave.session import checkpoint_folder, ranges_of

# Rows of a range of an indexed list, about, and of the pages that need no index.
ROWS_PER_RANGE = 100_000
TOP_ROWS = 10_000

# Sort keys of the statement list with their default directions.
DEFAULT_DIRECTIONS = {"contact": "asc", "date_range": "desc", "uploaded": "desc"}


def list_order(key: str | None, direction: str | None = None) -> list[Column]:
    """Sort columns of the statement list; an unknown key means newest upload first.

    Blank contact names come last in both directions; a missing date counts as the earliest.
    """
    key = (key or "").strip().lower()
    key = key if key in DEFAULT_DIRECTIONS else "uploaded"
    direction = (direction or "").strip().lower()
    if direction not in ("asc", "desc"):
        direction = DEFAULT_DIRECTIONS[key]
    if key == "contact":
        name = F.lower(stripped("contact_name"))
        return [F.when(has_text("contact_name"), 0).otherwise(1), name.desc() if direction == "desc" else name.asc()]
    column = F.col("latest_item_date" if key == "date_range" else "uploaded_at")
    return [column.desc_nulls_last() if direction == "desc" else column.asc_nulls_first()]


def sort_statements(headers: DataFrame, key: str | None = None, direction: str | None = None) -> DataFrame:
    return headers.orderBy(*list_order(key, direction))


def date_range_label(headers: DataFrame) -> DataFrame:
    """Add ``date_range``: one date, 'first - last', or a dash."""
    first, last = (F.date_format(c, "yyyy-MM-dd") for c in ("earliest_item_date", "latest_item_date"))
    return headers.withColumn(
        "date_range",
        F.when(first.isNotNull() & last.isNotNull() & (first != last), F.concat(first, F.lit(" - "), last)).otherwise(
            F.coalesce(last, first, F.lit("—"))
        ),
    )


class Page(NamedTuple):
    page: int
    per_page: int
    total_pages: int
    total_items: int
    start_index: int
    end_index: int


def page_bounds(total_items: int, page: int, per_page: int, options: Sequence[int] | None = None) -> Page:
    """Slice of a page; the size snaps to the nearest option (the lower one on a tie)."""
    if options:
        per_page = min(options, key=lambda option: (abs(option - per_page), option))
    per_page = max(per_page, 1)
    total_pages = max(-(-total_items // per_page), 1)
    page = min(max(page, 1), total_pages)
    start = (page - 1) * per_page
    return Page(page, per_page, total_pages, total_items, start, start + per_page)


class PageIndex(NamedTuple):
    """A list laid out in ranges of its order: the rows, each range a folder, and how many rows come before each range."""

    rows: DataFrame
    before: list[int]

    @property
    def total(self) -> int:
        return self.before[-1]


def page_index(df: DataFrame, order: Sequence[Column | str], rows_per_range: int = ROWS_PER_RANGE) -> PageIndex:
    """Write a list to the shared folder in ranges of ``order``, of about ``rows_per_range`` rows, and count each of them.

    Rows are ordered within their range alone; any page, however deep, then reads the ranges it touches. ``order`` should
    tell any two rows apart, as rows that tie stand in no fixed order. A long list has larger ranges than asked for, not thousands of them.
    """
    ranges = ranges_of(df.count(), rows_per_range, ROWS_PER_RANGE)
    ordered = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    # The id holds the partition above its 33rd bit and the row's place in it below.
    placed = ordered.withColumn("_range", F.shiftright("_place", 33).cast("int")).withColumn("_place", F.col("_place").bitwiseAND((1 << 33) - 1))
    folder = f"{checkpoint_folder(df.sparkSession)}/pages-{uuid.uuid4().hex}"
    placed.write.partitionBy("_range").parquet(folder)
    rows = df.sparkSession.read.schema(placed.schema).parquet(folder)
    sizes = {r["_range"]: r["n"] for r in rows.groupBy("_range").agg(F.count("*").alias("n")).collect()}  # a row per range
    before = [0]
    for r in range(ranges):
        before.append(before[-1] + sizes.get(r, 0))
    return PageIndex(rows, before)


def read_page(index: PageIndex, page: int, per_page: int, options: Sequence[int] | None = None) -> DataFrame:
    """Rows of one page of an indexed list; only the ranges that the page touches are read."""
    bounds = page_bounds(index.total, page, per_page, options)
    touched = [r for r in range(len(index.before) - 1) if index.before[r] < bounds.end_index and index.before[r + 1] > bounds.start_index]
    rows = index.rows.where(F.col("_range").isin(touched))
    first = F.element_at(F.lit([index.before[r] for r in touched] or [0]), (F.col("_range") - (touched[0] if touched else 0) + 1).cast("int"))
    place = F.col("_place") + first
    return rows.where((place >= bounds.start_index) & (place < bounds.end_index)).orderBy("_range", "_place").drop("_range", "_place")


def numbered(df: DataFrame, order: Sequence[Column | str], column: str = "place") -> DataFrame:
    """Add the place of every row in the whole order, from 1, without ordering all rows in one task."""
    index = page_index(df, order)
    starts = df.sparkSession.createDataFrame(list(enumerate(index.before[:-1])), "_range int, _before bigint")
    return index.rows.join(starts, "_range").withColumn(column, F.col("_before") + F.col("_place") + 1).drop("_range", "_place", "_before")


def paginate(
    df: DataFrame, order: Sequence[Column | str], page: int, per_page: int, options: Sequence[int] | None = None
) -> DataFrame:
    """Rows of one page of a list. A page near the top is a top-k; a deep one goes over a page index."""
    bounds = page_bounds(df.count(), page, per_page, options)
    if bounds.end_index <= TOP_ROWS:
        return df.orderBy(*order).offset(bounds.start_index).limit(bounds.per_page)
    return read_page(page_index(df, order), bounds.page, bounds.per_page)


def statement_counts(headers: DataFrame) -> DataFrame:
    """Statements per tenant and completion."""
    listed = headers.where(F.coalesce("record_type", F.lit("statement")) == "statement")
    return listed.groupBy("tenant_id", "completed").agg(F.count("*").alias("statements"))


def longest_files(files: DataFrame, k: int = 20) -> DataFrame:
    """The k files with the most pages, next to the total and the maximum over all files."""
    totals = files.agg(F.sum("page_count").alias("total_pages"), F.max("page_count").alias("max_pages"))
    # One row of totals beside at most k files.
    return files.orderBy(F.desc("page_count"), "filename").limit(k).join(totals, F.lit(True))
