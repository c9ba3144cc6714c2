"""Files of any store that Arrow reads (local, shared, object stores) for Python data sources."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import WriterCommitMessage

#: Bytes of rows that a data source hands to Spark at once.
BATCH_BYTES = 4 << 20


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), os.path.abspath(uri)) if "://" not in uri else fs.FileSystem.from_uri(uri)


def listing(uri: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files below a folder, without hidden ones, in order."""
    where, path = store(uri)
    found = where.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    shown = (f for f in found if f.type == fs.FileType.File and not any(p[0] in "._" for p in f.path[len(path) :].split("/") if p))
    return sorted((f.path, f.size) for f in shown)


def batches(rows: Iterable[tuple], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    """Rows in record batches of about BATCH_BYTES by their `size`, one row at least."""
    held, n = [], 0
    for row in rows:
        if held and n + size(row) > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, n = [], 0
        held.append(row)
        n += size(row)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    """What a task has written under hidden names: (hidden path, final path, what to remember of it)."""

    files: list[tuple[str, str, dict]]


def hidden(final: str) -> str:
    """A new name for a file that becomes `final` when the job commits; attempts of one task never share it."""
    folder, name = final.rsplit("/", 1)
    return f"{folder}/_{uuid.uuid4().hex}-{name}"


def publish(where: fs.FileSystem, messages: Iterable[Written | None], replaced: list[str]) -> list[tuple[str, dict]]:
    """Give all files their final names, after those they replace are gone."""
    files = [f for m in messages if m is not None for f in m.files]
    for path in replaced:
        where.delete_file(path)
    for temporary, final, _ in files:
        where.move(temporary, final)
    return [(final, facts) for _, final, facts in files]


def withdraw(where: fs.FileSystem, messages: Iterable[Written | None]) -> None:
    """Delete what tasks of a failed job have written."""
    for m in messages:
        for temporary, _, _ in m.files if m is not None else []:
            if where.get_file_info(temporary).type == fs.FileType.File:
                where.delete_file(temporary)
