"""The landing folder of uploaded PDF files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from tallyweave.sources.byte_ranges import read_bytes

# What an upload has to be.
PDF_SUFFIX, PDF_TYPE, PDF_MAGIC = ".pdf", "application/pdf", "%PDF-"
NO_PAGES = "Unable to determine page count for this PDF."

# Page objects and page-tree counts, as ``estimate_pages`` finds them; a word goes on with letters, digits or low lines.
PAGE_OBJECT, PAGE_TREE = re.compile(rb"/Type\s*/Page(?![A-Za-z0-9_])"), re.compile(rb"/Count\s+(\d+)")
PIECE = 1 << 20  # bytes of a file read at once


def scan_pdf_landing(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder with their path, size and content."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(folder)
        .withColumn("filename", F.element_at(F.split("path", "/"), -1))
    )


def scan_pdf_heads(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder with their path, size and first bytes; contents are not read beyond these."""
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(folder)
        .select("path", "length", F.element_at(F.split("path", "/"), -1).alias("filename"))
    )

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = [read_bytes(p, 0, len(PDF_MAGIC)) for p in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(start, pa.binary())], names=[*batch.schema.names, "content"])

    return listed.mapInArrow(heads, "path string, length bigint, filename string, content binary")


def count_pdf_pages(files: DataFrame, piece: int = PIECE) -> DataFrame:
    """Add ``page_count`` and ``file_error`` to files (path), whose contents go through the task in pieces.

    The result is that of ``estimate_pdf_pages``; a file of any size takes the memory of two pieces. What is
    counted may not lie further apart than a piece.
    """
    schema = StructType([f for f in files.schema.fields if f.name not in ("page_count", "file_error")]).add("page_count", IntegerType())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_pages_of(path, piece) for path in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in schema.fields[:-1]), pa.array(found, pa.int32())], names=schema.names)

    counted = files.select(schema.names[:-1]).mapInArrow(count, schema)
    return counted.withColumn("file_error", F.when(F.col("page_count").isNull(), NO_PAGES))


def _pages_of(path: str, piece: int) -> int | None:
    pages, largest, at, held = 0, 0, 0, b""
    while True:
        more = read_bytes(path, at, piece)
        at, data = at + len(more), held + more
        # What ends in the last piece's length may go on; it is looked at again with what follows.
        sure = len(data) if len(more) < piece else len(data) - piece // 2
        for hit in PAGE_OBJECT.finditer(data):
            pages += hit.start() < sure
        for hit in PAGE_TREE.finditer(data):
            if hit.start() < sure and int(hit[1]) < 1 << 31:
                largest = max(largest, int(hit[1]))
        held = data[sure:]
        if len(more) < piece:
            return pages or largest or None


def check_pdfs(files: DataFrame, mime_type: str | None = None) -> DataFrame:
    """Add ``reject_reason``: wrong suffix, wrong MIME type, or content that is no PDF.

    ``mime_type`` names the column with the declared type; without one the type is not checked.
    """
    reason = F.when(~F.lower("filename").endswith(PDF_SUFFIX), "suffix")
    if mime_type:
        reason = reason.when(~F.col(mime_type).eqNullSafe(F.lit(PDF_TYPE)), "mime-type")
    start = F.decode(F.substring("content", 1, len(PDF_MAGIC)), "ISO-8859-1")
    return files.withColumn("reject_reason", reason.when(start != PDF_MAGIC, "content"))


def estimate_pages(text: Column) -> Column:
    """Page objects in the text of a PDF; without any, the largest page-tree count; else null."""
    pages = F.regexp_count(text, F.lit(r"/Type\s*/Page\b"))
    counts = F.transform(
        F.regexp_extract_all(text, F.lit(r"/Count\s+(\d+)"), F.lit(1)), lambda n: n.try_cast("int")
    )
    largest = F.array_max(F.filter(counts, lambda n: n > 0))
    return F.when(pages > 0, pages).otherwise(largest)


def estimate_pdf_pages(files: DataFrame) -> DataFrame:
    """Add ``page_count`` and, where it cannot be told, ``file_error``."""
    counted = files.withColumn("page_count", estimate_pages(F.decode("content", "ISO-8859-1")))
    return counted.withColumn(
        "file_error", F.when(F.col("page_count").isNull(), NO_PAGES)
    )
