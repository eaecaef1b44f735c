"""Files of the shared folder as tasks write and read them, in whatever store its address names."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs


def store(address: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it. Local paths may come bare or as ``file:/path``."""
    if address.startswith("/"):
        return fs.LocalFileSystem(), address
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", address))


def record_batches(folder: str, rows: int) -> Iterator[pa.RecordBatch]:
    """All rows of a folder of Parquet files, some at a time, in the order of file names."""
    system, path = store(folder)
    names = sorted(x.path for x in system.get_file_info(fs.FileSelector(path)) if x.path.endswith(".parquet"))
    for name in names:
        with system.open_input_file(name) as source:
            yield from pq.ParquetFile(source).iter_batches(batch_size=rows)


def put(address: str, content: bytes) -> None:
    """Write a file under a name of its own first, so that nobody sees a part of it."""
    system, path = store(address)
    system.create_dir(os.path.dirname(path), recursive=True)
    with system.open_output_stream(f"{path}.part") as out:
        out.write(content)
    system.move(f"{path}.part", path)


def get(address: str, start: int = 0, size: int | None = None) -> bytes:
    system, path = store(address)
    with system.open_input_file(path) as source:
        source.seek(start)
        return source.read() if size is None else source.read(size)
