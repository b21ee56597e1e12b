"""Shared folders, materialised stages and binary files beside them.

Tables go through Spark's own writers.  Binary files (token ids, tar shards)
are written by Python workers: with the operating system's calls where the folder is a
`file:` one, which all executors mount, and with pyarrow's file systems elsewhere.
A file is first written under a name of its own and then renamed, so a task that
is run again, or twice at a time, leaves whole files only.
"""

from __future__ import annotations

import mmap
import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

from gazetrail.sources.interim import delete, free, mark, new_folder, purge, shared_dir, written

__all__ = ["Input", "Output", "delete", "discard", "free", "local", "mark", "new_folder", "purge", "shared_dir", "written"]


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables that `written` made and that no later plan reads."""
    for table in tables:
        delete(spark, table._written_to)


def local(uri: str) -> str | None:
    """The path of a `file:` address or of a bare path, else None."""
    u = urlparse(uri)
    return unquote(u.path) if u.scheme in ("", "file") else None


def _remote(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Output:
    """A binary file that appears under its name when it is closed without an error."""

    def __init__(self, uri: str):
        self.uri, self.part, self.size = uri, f"{uri}.{uuid.uuid4().hex}.part", 0

    def __enter__(self) -> Output:
        if path := local(self.part):
            os.makedirs(os.path.dirname(path), exist_ok=True)
            self.file = open(path, "wb", buffering=1 << 20)  # noqa: SIM115
        else:
            self.fs, at = _remote(self.part)
            self.file = self.fs.open_output_stream(at)
        return self

    def write(self, data: bytes) -> None:
        self.file.write(data)
        self.size += len(data)

    def __exit__(self, kind, *_) -> None:
        self.file.close()
        if path := local(self.part):
            os.remove(path) if kind else os.replace(path, local(self.uri))
        else:
            at = _remote(self.part)[1]
            self.fs.delete_file(at) if kind else self.fs.move(at, _remote(self.uri)[1])


class Input:
    """Random access to a binary file: mapped into memory where it is local, range reads elsewhere."""

    def __init__(self, uri: str):
        self.map = None
        if path := local(uri):
            with open(path, "rb") as f:
                self.size = os.fstat(f.fileno()).st_size
                self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if self.size else b""
        else:
            fs, at = _remote(uri)
            self.file = fs.open_input_file(at)
            self.size = self.file.size()

    def read(self, offset: int, length: int) -> bytes:
        if self.map is not None:
            return self.map[offset : offset + length]
        return self.file.read_at(length, offset)
