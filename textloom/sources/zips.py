"""Zip archives of concatenated XML documents as a data source.

    spark.dataSource.register(XmlArchives)
    spark.read.format("xml_archives").load(folder)            # path, year, member, at, dtd_version, xml
    documents.write.format("xml_archives").mode("append").save(folder)     # year, xml

Archives are planned as spans of bytes.  An entry that is stored as it is can be read from any place, so that each of its
spans is a task of its own, and a document belongs to the span in which it starts; a deflated entry is a stream and
belongs to the span in which it starts.  Tasks hold a block and a document at a time, never an entry.
"""

from __future__ import annotations

import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from . import files

DECLARATION = b"<?xml"
SCHEMA = "path string, year int, member string, at long, dtd_version int, xml string"
ARROW = pa.schema([("path", pa.string()), ("year", pa.int32()), ("member", pa.string()), ("at", pa.int64()), ("dtd_version", pa.int32()), ("xml", pa.string())])
SPAN, BLOCK, ARCHIVE_BYTES = 64 << 20, 1 << 20, 256 << 20


def year_of(path: str) -> int | None:
    """The year among the folders of a path."""
    found = re.findall(r"(?<=/)[0-9]{4}(?=/)", path)
    return int(found[-1]) if found else None


def version_of(year: int) -> int:
    """The schema version of documents of a year."""
    return 4 if year > 2004 else 2


def pieces(read: Callable[[int], bytes], at: int, stop: int | None, block: int = BLOCK) -> Iterator[tuple[int, bytes]]:
    """(place, document) of what starts before `stop` in a stream whose first byte has the place `at`: from each
    declaration to the next; at the start of an entry also what lies before the first.  White space alone is none."""
    held, seen, whole = bytearray(), 1 if at == 0 else 0, at == 0
    while True:
        more = read(block)
        held += more
        while (found := held.find(DECLARATION, seen)) >= 0:
            if whole and held[:found].strip():
                yield at, bytes(held[:found])
            del held[:found]
            at, seen, whole = at + found, 1, True
            if stop is not None and at >= stop:
                return
        seen = max(1 if whole else 0, len(held) - len(DECLARATION) + 1)
        if not whole:  # nothing of this span so far: what cannot begin a declaration is of no use
            at, held, seen = at + seen, held[seen:], 0
            if stop is not None and at >= stop:
                return
        if not more:
            break
    if whole and held.strip():
        yield at, bytes(held)


@dataclass
class Span(InputPartition):
    """Bytes `low` to `high` of an archive."""

    path: str
    year: int
    low: int
    high: int


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.every = options["path"], options.get("entries", "first") == "all"
        self.span = int(options.get("span", SPAN))
        self.limits: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Limits on the year choose the archives to open; all others are left to Spark."""
        for f in filters:
            if getattr(f, "attribute", None) == ("year",) and isinstance(f, EqualTo | In | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                self.limits.append(f)
            else:
                yield f

    def partitions(self) -> list[Span]:
        found = []
        for path, size in files.listing(self.folder):
            year = year_of(path)
            if year is not None and "zip" in path.rsplit("/", 1)[1] and all(meets(year, f) for f in self.limits):
                found += [Span(path, year, low, min(low + self.span, size)) for low in range(0, size, self.span)]
        return found or [Span("", 0, 0, 0)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        yield from files.batches(self._documents(partition), ARROW, lambda row: len(row[5]) + 100)

    def _documents(self, span: Span) -> Iterator[tuple]:
        if not span.path:
            return
        where, _ = files.store(self.folder)
        with where.open_input_file(span.path) as f:
            try:
                with zipfile.ZipFile(f) as archive:
                    named = [x for x in archive.infolist() if re.search("XML|xml", x.filename)]
                    for entry in named if self.every else named[:1]:
                        for at, document in self._pieces(f, archive, entry, span):
                            yield span.path, span.year, entry.filename, at, version_of(span.year), document.decode("utf-8", "replace")
            except (zipfile.BadZipFile, zlib.error, EOFError, pa.ArrowInvalid):
                return  # a broken archive gives what could be read of it

    def _pieces(self, f, archive: zipfile.ZipFile, entry: zipfile.ZipInfo, span: Span) -> Iterator[tuple[int, bytes]]:
        f.seek(entry.header_offset)
        head = f.read(30)
        if head[:4] != b"PK\x03\x04":
            raise zipfile.BadZipFile(entry.filename)
        data = entry.header_offset + 30 + sum(struct.unpack("<HH", head[26:30]))
        if entry.compress_type != zipfile.ZIP_STORED or entry.flag_bits & 1:
            if span.low <= data < span.high:
                with archive.open(entry) as stream:
                    yield from pieces(stream.read, 0, None)
            return
        low, high = max(span.low - data, 0), min(span.high - data, entry.file_size)
        if low >= high:
            return
        f.seek(data + low)
        left = entry.file_size - low

        def read(n: int) -> bytes:
            nonlocal left
            got = f.read(min(n, left))
            left -= len(got)
            return got

        yield from pieces(read, low, high)


def meets(value, f: Filter) -> bool:
    """Whether a value that is no null fulfils a filter."""
    if isinstance(f, In):
        return value in f.value
    return {EqualTo: value == f.value, GreaterThan: value > f.value, GreaterThanOrEqual: value >= f.value, LessThan: value < f.value, LessThanOrEqual: value <= f.value}[type(f)]


class ArchiveWriter(DataSourceArrowWriter):
    """Rows (year, xml) as archives of one entry below a folder for each year; rows of a task come sorted by year."""

    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.overwrite = options["path"], overwrite
        self.method = zipfile.ZIP_STORED if options.get("compression", "deflate") == "none" else zipfile.ZIP_DEFLATED
        self.most = int(options.get("archiveBytes", ARCHIVE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> files.Written:
        where, root = files.store(self.folder)
        made, year, size, name = [], None, 0, uuid.uuid4().hex
        out = archive = entry = None

        def close() -> None:
            if entry is not None:
                entry.close()
                archive.close()
                out.close()

        for batch in iterator:
            for row_year, xml in zip(batch.column("year").to_pylist(), batch.column("xml").to_pylist(), strict=True):
                if row_year is None or xml is None:
                    continue  # a document without a year has no folder
                if row_year != year or size >= self.most:
                    close()
                    final = f"{root}/{row_year:04d}/{name}-{len(made)}.zip"
                    where.create_dir(final.rsplit("/", 1)[0], recursive=True)
                    made.append((files.hidden(final), final, {}))
                    out = where.open_output_stream(made[-1][0])
                    archive = zipfile.ZipFile(out, "w", self.method, allowZip64=True)
                    entry = archive.open("documents.xml", "w", force_zip64=True)
                    year, size = row_year, 0
                data = xml.encode()
                entry.write(data)
                size += len(data)
        close()
        return files.Written(made)

    def commit(self, messages: list) -> None:
        where, _ = files.store(self.folder)
        files.publish(where, messages, [p for p, _ in files.listing(self.folder)] if self.overwrite else [])

    def abort(self, messages: list) -> None:
        files.withdraw(files.store(self.folder)[0], messages)


class XmlArchives(DataSource):
    """Options path, span (bytes of a task), entries (first, the default, or all); for writing compression (deflate
    or none) and archiveBytes."""

    @classmethod
    def name(cls) -> str:
        return "xml_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> ArchiveReader:
        return ArchiveReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options, overwrite)


def _with_pushdown(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_archives(spark: SparkSession, folder: str, **options: object) -> DataFrame:
    """(path, year, member, at, dtd_version, xml), a row for each document of the archives below a folder; `at` is
    its place in the entry.  Filters on the year choose the archives that are opened."""
    _with_pushdown(spark)
    spark.dataSource.register(XmlArchives)
    return spark.read.format("xml_archives").options(**{k: str(v) for k, v in options.items()}).load(folder)


def write_archives(documents: DataFrame, folder: str, overwrite: bool = False, **options: object) -> None:
    """Rows (year, xml) as zip archives, a folder for each year; rows without a year or a text are left out."""
    spark = documents.sparkSession
    spark.dataSource.register(XmlArchives)
    rows = documents.select(F.col("year").cast("int").alias("year"), F.col("xml").cast("string").alias("xml")).sortWithinPartitions("year")
    rows.write.format("xml_archives").mode("overwrite" if overwrite else "append").options(**{k: str(v) for k, v in options.items()}).save(folder)
