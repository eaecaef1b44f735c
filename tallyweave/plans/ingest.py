"""From extracted page chunks to flagged, numbered statement items and statement metadata."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.operators import flags, shaping
from tallyweave.schemas import STATEMENT_KEYS


def ingest_chunks(chunks: DataFrame, templates: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """Statements (metadata from their first chunk, dates and confidence from all rows) and items."""
    templates = list(templates)
    first = chunks.groupBy(*STATEMENT_KEYS).agg(
        F.min_by(F.struct("detected_headers", "column_order", "date_format"), "chunk_index").alias("m"),
        F.sum("input_tokens").cast("bigint").alias("input_tokens"),
        F.sum("output_tokens").cast("bigint").alias("output_tokens"),
    )
    first = first.select(*STATEMENT_KEYS, "m.*", "input_tokens", "output_tokens")
    merged = shaping.assign_item_ids(shaping.merge_chunks(chunks))
    items = flags.flag_items(shaping.postprocess_totals(merged))
    dated = items.join(first.select(*STATEMENT_KEYS, "date_format"), STATEMENT_KEYS)
    statements = (
        shaping.build_header_mapping(first)
        .join(shaping.statement_date_range(dated, templates), STATEMENT_KEYS, "left")
        .join(shaping.date_confidence(dated), STATEMENT_KEYS, "left")
    )
    return statements, items
