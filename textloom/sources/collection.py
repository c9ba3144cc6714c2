"""A collection of documents by key as a data source: key ranges, pages, and filters on the key.

    write_collection(documents, folder, "doc_id")         # JSON documents under their keys
    read_collection(spark, folder, "long").where("key >= 10 and key < 20")

A collection is a folder of JSON lines, `{"key": ..., "document": {...}}`, in the order of their keys.  Each file has an index
of its pages beside it, and a manifest tells the first and last key of each file.  A scan is planned from the manifest
alone, a task for each file whose keys a filter can meet; the task reads the pages that it can meet and no others.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith

from . import files

#: Documents and bytes of a page, and bytes of a file.
PAGE_ROWS, PAGE_BYTES, FILE_BYTES = 1000, 4 << 20, 128 << 20
KEYS = {"long": pa.int64(), "string": pa.string()}
LIMITS = EqualTo | EqualNullSafe | In | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual | StringStartsWith


@dataclass
class Limits:
    """What filters leave of the keys: whether a key is among them, and whether a range may hold one that is."""

    filters: list[Filter]

    def holds(self, key) -> bool:
        return all(self._one(f, key, key) for f in self.filters)

    def meets(self, first, last) -> bool:
        return all(self._one(f, first, last) for f in self.filters)

    def _one(self, f: Filter, first, last) -> bool:
        match f:
            case EqualTo() | EqualNullSafe():
                return f.value is not None and first <= f.value <= last
            case In():
                return any(v is not None and first <= v <= last for v in f.value)
            case GreaterThan():
                return last > f.value
            case GreaterThanOrEqual():
                return last >= f.value
            case LessThan():
                return first < f.value
            case LessThanOrEqual():
                return first <= f.value
            case StringStartsWith():
                return first[: len(f.value)] <= f.value <= last[: len(f.value)]
        return True


@dataclass
class Range(InputPartition):
    """A file of the collection and the keys it holds."""

    path: str
    first: object
    last: object


class CollectionReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.kind, self.limits = options["path"], options.get("keytype", "long"), Limits([])

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of the key are answered here, exactly; all others are left to Spark."""
        for f in filters:
            if getattr(f, "attribute", None) == ("key",) and isinstance(f, LIMITS):
                self.limits.filters.append(f)
            elif not (isinstance(f, IsNotNull) and f.attribute == ("key",)):  # no key is null
                yield f

    def partitions(self) -> list[Range]:
        where, root = files.store(self.folder)
        found = []
        for path, _ in files.listing(f"{self.folder.rstrip('/')}/_manifests"):
            with where.open_input_file(path) as f:
                found += [Range(f"{root}/{name}", first, last) for name, first, last in json.loads(f.read()) if self.limits.meets(first, last)]
        return sorted(found, key=lambda r: (r.first, r.path)) or [Range("", None, None)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", KEYS[self.kind]), ("document", pa.string())])
        yield from files.batches(self._documents(partition), schema, lambda row: len(row[1]) + 50)

    def _documents(self, part: Range) -> Iterator[tuple]:
        if not part.path:
            return
        where, _ = files.store(self.folder)
        with where.open_input_file(_index(part.path)) as f:
            pages = [p for p in json.loads(f.read()) if self.limits.meets(p[0], p[1])]
        if not pages:
            return
        decode = json.JSONDecoder().raw_decode
        with where.open_input_file(part.path) as f:
            for _, _, at, size in pages:
                f.seek(at)
                for line in f.read(size).decode().split("\n")[:-1]:
                    key, end = decode(line, 7)
                    if self.limits.holds(key):
                        yield key, line[end + 12 : -1]


def _index(path: str) -> str:
    folder, name = path.rsplit("/", 1)
    return f"{folder}/_pages-{name}"


class CollectionWriter(DataSourceArrowWriter):
    """Rows (key, document) in the order of their keys."""

    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.overwrite = options["path"], overwrite
        self.rows, self.bytes, self.most = (int(options.get(k, d)) for k, d in (("pagerows", PAGE_ROWS), ("pagebytes", PAGE_BYTES), ("filebytes", FILE_BYTES)))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> files.Written:
        where, root = files.store(self.folder)
        where.create_dir(root, recursive=True)
        made, name = [], uuid.uuid4().hex
        out, pages, page, held, at = None, [], [], 0, 0

        def end_page() -> None:
            nonlocal page, held, at
            if page:
                out.write(b"".join(line for _, line in page))
                pages.append([page[0][0], page[-1][0], at, held])
                page, held, at = [], 0, at + held

        def end_file() -> None:
            nonlocal out, pages, at
            if out is None:
                return
            end_page()
            out.close()
            temporary, final, _ = made.pop()
            index = files.hidden(_index(final))
            with where.open_output_stream(index) as f:
                f.write(json.dumps(pages).encode())
            made.extend([(index, _index(final), {}), (temporary, final, {"first": pages[0][0], "last": pages[-1][1]})])
            out, pages, at = None, [], 0

        for batch in iterator:
            for key, document in zip(batch.column("key").to_pylist(), batch.column("document").to_pylist(), strict=True):
                if out is None:
                    final = f"{root}/{name}-{len(made)}.jsonl"
                    made.append((files.hidden(final), final, {}))
                    out = where.open_output_stream(made[-1][0])
                # a raw line feed in JSON is white space
                line = f'{{"key":{json.dumps(key, ensure_ascii=False)},"document":{document.replace("\n", " ")}}}\n'.encode()
                page.append((key, line))
                held += len(line)
                if len(page) >= self.rows or held >= self.bytes:
                    end_page()
                if at + held >= self.most:
                    end_file()
        end_file()
        return files.Written(made)

    def commit(self, messages: list) -> None:
        """Files get their names first, the manifest that makes them part of the collection comes last."""
        where, root = files.store(self.folder)
        where.create_dir(f"{root}/_manifests", recursive=True)
        sub = f"{self.folder.rstrip('/')}/_manifests"
        old = [p for p, _ in files.listing(sub)] if self.overwrite else []
        spent = [p for p, _ in files.listing(self.folder)] if self.overwrite else []
        done = files.publish(where, messages, [])
        entries = [[path.rsplit("/", 1)[1], facts["first"], facts["last"]] for path, facts in done if facts]
        final = f"{root}/_manifests/{uuid.uuid4().hex}.json"
        temporary = files.hidden(final)
        with where.open_output_stream(temporary) as f:
            f.write(json.dumps(entries).encode())
        for path in old:
            where.delete_file(path)
        where.move(temporary, final)
        for path in spent:
            where.delete_file(path)
            where.delete_file(_index(path))

    def abort(self, messages: list) -> None:
        files.withdraw(files.store(self.folder)[0], messages)


class DocumentCollection(DataSource):
    """Options path, keyType (long or string); for writing pageRows, pageBytes, fileBytes."""

    @classmethod
    def name(cls) -> str:
        return "document_collection"

    def schema(self) -> str:
        return f"key {self.options.get('keytype', 'long')}, document string"

    def reader(self, schema: T.StructType) -> CollectionReader:
        return CollectionReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> CollectionWriter:
        return CollectionWriter(self.options, overwrite)


def write_collection(documents: DataFrame, folder: str, key: str, overwrite: bool = False, **options: object) -> None:
    """The rows as JSON documents under their `key` (a number or a string), in ranges of keys.  Rows without a key are left
    out; rows that share a key are all kept, side by side."""
    spark = documents.sparkSession
    spark.dataSource.register(DocumentCollection)
    kind = "string" if isinstance(documents.schema[key].dataType, T.StringType) else "long"
    rows = documents.where(F.col(key).isNotNull()).select(F.col(key).cast(kind).alias("key"), F.to_json(F.struct(*documents.columns)).alias("document"))
    rows = rows.repartitionByRange("key").sortWithinPartitions("key")
    rows.write.format("document_collection").mode("overwrite" if overwrite else "append").options(**{k: str(v) for k, v in options.items()}).save(folder)


def read_collection(spark: SparkSession, folder: str, key_type: str = "long") -> DataFrame:
    """(key, document as JSON).  Comparisons of the key with literals choose the files and pages that are read."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DocumentCollection)
    return spark.read.format("document_collection").option("keyType", key_type).load(folder)
