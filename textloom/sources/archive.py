"""Archives of concatenated XML documents, link pages, and keyed sinks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def links(pages: DataFrame, prefix: str, first_year: int | None = None) -> DataFrame:
    """(page_id, url) of links whose target holds `prefix`, from `first_year` on by their first four digits."""
    found = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("url")).where(F.contains("url", F.lit(prefix)))
    if first_year is None:
        return found
    return found.where(F.try_to_number(F.nullif(F.regexp_extract("url", "([0-9]{4})", 1), F.lit("")), F.lit("9999")) >= first_year)


def missing(wanted: DataFrame, landed: DataFrame, key: str) -> DataFrame:
    """What has not landed yet."""
    return wanted.join(landed.select(key).distinct(), key, "left_anti")


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """(path, year, content) of every file called like a zip below a folder with a year in its path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*zip*").load(folder)
    year = F.regexp_extract("path", "/([0-9]{4})/", 1)
    return files.where(year != "").select("path", year.cast("int").alias("year"), "content")


def unzip(files: DataFrame) -> DataFrame:
    """(path, year, xml), the first entry called like XML; archives without one, or broken ones, give no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["xml"] = [_first_xml(c) for c in batch.pop("content")]
            yield batch[batch["xml"].notna()]

    return files.mapInPandas(run, "path string, year int, xml string")


def _first_xml(content: bytes) -> str | None:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            name = next((n for n in z.namelist() if re.search("XML|xml", n)), None)
            return None if name is None else z.read(name).decode("utf-8", "replace")
    except zipfile.BadZipFile:
        return None


def documents(unzipped: DataFrame) -> DataFrame:
    """(path, year, seq, dtd_version, xml): cut before each XML declaration; version 4 after 2004, else 2."""
    pieces = F.split("xml", r"(?=<\?xml)")
    rows = unzipped.select("path", "year", F.posexplode(pieces).alias("seq", "xml")).where(F.btrim("xml") != "")
    return rows.select("path", "year", "seq", F.when(F.col("year") > 2004, 4).otherwise(2).alias("dtd_version"), "xml")


DECLARATION = b"<?xml"


def split_archives(files: DataFrame) -> DataFrame:
    """(path, year, seq, dtd_version, xml), the documents of each archive's first entry called like XML.

    The entry is read in blocks and each document goes out once it is whole, so that no cell holds an entry."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, year, content in zip(batch["path"], batch["year"], batch["content"], strict=True):
                version = 4 if year > 2004 else 2
                for seq, xml in enumerate(_pieces(content)):
                    yield pd.DataFrame({"path": [path], "year": [year], "seq": [seq], "dtd_version": [version], "xml": [xml]})

    return files.select("path", "year", "content").mapInPandas(run, "path string, year int, seq int, dtd_version int, xml string")


def _pieces(content: bytes, block: int = 1 << 20) -> Iterator[str]:
    """What lies before the first declaration and from each one to the next, white space alone left out."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            name = next((n for n in z.namelist() if re.search("XML|xml", n)), None)
            if name is None:
                return
            with z.open(name) as entry:
                held, seen = bytearray(), 1
                while more := entry.read(block):
                    held += more
                    while (at := held.find(DECLARATION, seen)) >= 0:
                        if (piece := held[:at].decode("utf-8", "replace")).strip():
                            yield piece
                        del held[:at]
                        seen = 1
                    seen = max(1, len(held) - len(DECLARATION) + 1)
                if (last := held.decode("utf-8", "replace")).strip():
                    yield last
    except zipfile.BadZipFile:
        return


def token_lines(lines: DataFrame, *keep: str) -> DataFrame:
    """(id, rest) of text lines, and columns to keep."""
    pair = F.split("value", " ", 2)
    return lines.select(F.get(pair, F.lit(0)).alias("id"), F.coalesce(F.get(pair, F.lit(1)), F.lit("")).alias("rest"), *keep)


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """K1: the last write of each key, aggregated before the shuffle."""
    every = F.struct(*rows.columns)
    return rows.groupBy(key).agg(F.max_by(every, F.struct(*order)).alias("__last")).select("__last.*")


def write_parts(parts: DataFrame, path: str) -> None:
    """K5, K6: rows or arrays by split and level as Parquet; a rerun replaces the folders it writes."""
    parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split", "level").parquet(path)


def natural_key(name: Column) -> Column:
    """K8: sorts runs of digits by value."""
    return F.transform(F.regexp_extract_all(name, F.lit("[0-9]+|[^0-9]+"), F.lit(0)), lambda x: F.when(x.rlike("^[0-9]+$"), F.lpad(x, 20, "0")).otherwise(x))
