"""Parts of files as tasks read and write them, in whatever store their address names."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import NativeFile, fs


def _store(path: str) -> tuple[fs.FileSystem, str]:
    address = re.sub(r"^file:/+", "file:///", path)
    return fs.FileSystem.from_uri(address) if "://" in address else (fs.LocalFileSystem(), address)


def read_bytes(path: str, start: int, size: int) -> bytes:
    """Up to ``size`` bytes from a place on."""
    system, name = _store(path)
    with system.open_input_file(name) as source:
        source.seek(start)
        return source.read(size)


@contextmanager
def written(path: str) -> Iterator[NativeFile]:
    """A file to write to piece by piece, under a name of its own until it is whole."""
    system, name = _store(path)
    system.create_dir(os.path.dirname(name), recursive=True)
    with system.open_output_stream(f"{name}.part", buffer_size=1 << 20) as out:
        yield out
    system.move(f"{name}.part", name)


def write_bytes(path: str, content: bytes) -> None:
    """A file, under a name of its own until it is whole."""
    with written(path) as out:
        out.write(content)
