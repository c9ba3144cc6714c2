"""Queries over archives, document stores and keyed state: the given tables written as such and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract, variants
from ..sources import collection, zips
from ..sources.stores import scratch
from ..streaming import ingest, keyed
from .catalog import SQL, docs, query, table


def _escaped(text):
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _plain(text):
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


@query("q_archives", "SELECT doc_id, (1998 + doc_id % 12)::INT AS year, CASE WHEN 1998 + doc_id % 12 > 2004 THEN 4 ELSE 2 END::INT AS dtd_version, length(coalesce(text, ''))::BIGINT AS n_chars, md5(coalesce(text, '')) AS digest FROM documents")
def q_archives(spark: SparkSession, d: str) -> DataFrame:
    """Every document written to zip archives by year, and read back from spans of them."""
    body = F.concat(F.lit('<?xml version="1.0"?>\n<doc id="'), F.col("doc_id"), F.lit('">'), _escaped(F.col("text")), F.lit("</doc>"))
    folder = scratch(spark, "archives")
    zips.write_archives(docs(spark, d).select((1998 + F.col("doc_id") % 12).alias("year"), body.alias("xml")), folder)
    text = _plain(F.regexp_extract("xml", r"(?s)<doc id=\"[0-9]+\">(.*)</doc>", 1))
    rows = zips.read_archives(spark, folder).select(F.regexp_extract("xml", '<doc id="([0-9]+)">', 1).cast("long").alias("doc_id"), "year", "dtd_version", text.alias("text"))
    return rows.select("doc_id", "year", "dtd_version", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


_DOCUMENTS = "doc_id long, text string, lang string, source string"


def _collection(spark: SparkSession, d: str) -> DataFrame:
    folder = scratch(spark, "collection")
    collection.write_collection(docs(spark, d), folder, "doc_id")
    return collection.read_collection(spark, folder)


@query("q_store_scan", "SELECT doc_id AS key, lang, source, length(coalesce(text, ''))::BIGINT AS n_chars, md5(coalesce(text, '')) AS digest FROM documents")
def q_store_scan(spark: SparkSession, d: str) -> DataFrame:
    """All documents of a collection by key, range by range and page by page."""
    rows = _collection(spark, d).select("key", F.from_json("document", _DOCUMENTS).alias("v"))
    return rows.select("key", "v.lang", "v.source", F.length("v.text").cast("long").alias("n_chars"), F.md5(F.col("v.text").cast("binary")).alias("digest"))


@query("q_store_range", "SELECT lang, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last, sum(length(coalesce(text, '')))::BIGINT AS n_chars FROM documents WHERE doc_id >= 150 AND doc_id < 650 GROUP BY lang")
def q_store_range(spark: SparkSession, d: str) -> DataFrame:
    """A range of keys; only its files and pages are read."""
    rows = _collection(spark, d).where("key >= 150 and key < 650").select("key", F.from_json("document", _DOCUMENTS).alias("v"))
    return rows.groupBy("v.lang").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first"), F.max("key").alias("last"), F.sum(F.length("v.text")).cast("long").alias("n_chars"))


@query("q_stream_state", SQL["q_upsert_latest"])
def q_stream_state(spark: SparkSession, d: str) -> DataFrame:
    """S5, K1 with state: events land in three parts, the newest first, so that most rows come late, and the second part
    lands twice; what the state holds in the end is what the whole table gives."""
    base = scratch(spark, "keyed")
    events = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    # by the day, so that no key's last rows are spread evenly over the parts
    part = 2 - F.pmod(F.dayofyear("ts"), F.lit(3))
    for number in (0, 1, 1, 2):
        events.where(part == number).write.mode("append").parquet(f"{base}/landing")
        keyed.upsert(ingest.landing(spark, f"{base}/landing", events.schema), "user_id", ["ts", "event_id"], f"{base}/changes", f"{base}/checkpoint").awaitTermination()
    return keyed.current(spark, f"{base}/checkpoint", events.schema).select("user_id", "event_id", "event_type")


# ---- all fields of documents in XML

#: What the documents hold beside the fields of `runs`: opening tags, value in SQL, closing tags.
_WHOLE_4 = [
    ("<us-patent-grant><us-bibliographic-data-grant><publication-reference><document-id><country>", "lang", "</country>"),
    ("<doc-number>", "'A' || doc_id", "</doc-number></document-id></publication-reference>"),
    ("<classification-national><main-classification>", "'4 ' || doc_id", "</main-classification></classification-national>"),
    ("<classifications-ipcr><classification-ipcr><section>A</section><class>01</class><main-group>", "doc_id", "</main-group><other>no</other></classification-ipcr>"),
    ("<x><classification-ipcr><subclass>", "lang", "</subclass></classification-ipcr></x></classifications-ipcr>"),
    ("<us-references-cited><us-citation><patcit><document-id><doc-number>", "'R ' || doc_id", "</doc-number></document-id></patcit></us-citation></us-references-cited>"),
    ("<references-cited><y><citation><patcit><document-id><doc-number>", "'Q ' || doc_id", "</doc-number></document-id></patcit></citation></y></references-cited>"),
    ("<z><classification-national><main-classification>", "'7 ' || doc_id", "</main-classification></classification-national></z>"),
    ("<us-parties><us-applicants><us-applicant><addressbook><last-name>", "source", "</last-name><first-name>F</first-name></addressbook></us-applicant></us-applicants></us-parties>"),
    ("<parties><applicants><w><applicant><addressbook><address><city>", "'in ' || lang", "</city><street>no</street></address><country>C</country></addressbook></applicant></w></applicants></parties></us-bibliographic-data-grant>"),
    ("<abstract id=\"a\"><p>", "lang", "<b>!</b></p><br /></abstract>"),
    ("<description><p>", "source", "</p></description><abstract>second</abstract><claims><claim>1</claim></claims></us-patent-grant>"),
]
_WANTED_4 = {
    "patent_country": "lang",
    "patent_doc_number": "'A' || doc_id",
    "patent_kind": "''",
    "classification_national_main": "'4' || doc_id",
    "classification_ipc": "'A|01|' || doc_id || '|' || lang",
    "references_cited": "'R' || doc_id || '|Q' || doc_id",
    "us_field_of_search": "'4' || doc_id || '|7' || doc_id",
    "inventors": "source || '|F|in ' || lang || '|C'",
    "abstract_xml": "'<abstract id=\"a\"><p>' || lang || '<b>!</b></p><br /></abstract>'",
    "description_xml": "'<description><p>' || source || '</p></description>'",
    "claims_xml": "'<claims><claim>1</claim></claims>'",
}
_WHOLE_2 = [
    ("<PATDOC><SDOBI><B100><B110><DNUM><PDAT>", "'A' || doc_id", "</PDAT></DNUM></B110><B190><PDAT>US</PDAT></B190></B100>"),
    ("<B500><B510><B511><PDAT>", "'A01B ' || doc_id", "</PDAT></B511><v><B512><PDAT>H02</PDAT></B512></v></B510>"),
    ("<B580><B582><PDAT>", "'6 ' || doc_id", "</PDAT><deep><er>7 7</er></deep></B582></B580></B500>"),
    ("<B700><B720><B721><PARTY-US><NAM><FNM>", "lang", "</FNM><SNM><STEXT>S</STEXT></SNM></NAM></PARTY-US></B721></B720></B700></SDOBI>"),
    ("<SDOAB><BTEXT><PARA><PTEXT><PDAT>", "source", "</PDAT></PTEXT></PARA></BTEXT></SDOAB><SDODE><p>d</p></SDODE>"),
    ("<SDOCL><p>", "doc_id", "</p></SDOCL></PATDOC>"),
]
_WANTED_2 = {
    "patent_country": "'US'",
    "application_doc_number": "'A' || doc_id",
    "classification_ipc": "'A01B' || doc_id || '|H02'",
    "us_field_of_search": "'6' || doc_id || '|77'",
    "inventors": "lang || '|S'",
    "invention_title": "source",
    "references_cited": "''",
    "abstract_xml": "'<SDOAB><BTEXT><PARA><PTEXT><PDAT>' || source || '</PDAT></PTEXT></PARA></BTEXT></SDOAB>'",
    "description_xml": "'<SDODE><p>d</p></SDODE>'",
    "claims_xml": "'<SDOCL><p>' || doc_id || '</p></SDOCL>'",
}


def _whole(spark: SparkSession, d: str, version: int, parts: list, wanted: dict) -> DataFrame:
    xml = F.concat(*[F.concat(F.lit(a), F.expr(v).cast("string"), F.lit(z)) for a, v, z in parts])
    found = extract.fields(docs(spark, d).select("doc_id", xml.alias("xml")), version)
    return found.select("doc_id", *[F.col(f) if f.endswith("_xml") else F.coalesce(F.array_join(f, "|"), F.lit("")).alias(f) for f in wanted])


def _whole_sql(wanted: dict) -> str:
    return "SELECT doc_id, " + ", ".join(f"{v} AS {f}" for f, v in wanted.items()) + " FROM documents"


@query("q_one_pass_v4", _whole_sql(_WANTED_4))
def q_one_pass_v4(spark: SparkSession, d: str) -> DataFrame:
    """Fields, unions, descendants and text fields of documents of version 4, by one parse."""
    return _whole(spark, d, 4, _WHOLE_4, _WANTED_4)


@query("q_one_pass_v2", _whole_sql(_WANTED_2))
def q_one_pass_v2(spark: SparkSession, d: str) -> DataFrame:
    """The same for version 2."""
    return _whole(spark, d, 2, _WHOLE_2, _WANTED_2)


# ---- JSON

_NESTED = """to_json(named_struct('id', doc_id, 'meta', named_struct('lang', lang, 'origin', named_struct('source', source, 'even', doc_id % 2 = 0)),
  'size', length(text), 'half', doc_id / 2.0, 'words', slice(split(text, ' '), 1, 2), 'odd', if(doc_id % 2 = 1, doc_id, null)))"""


@query(
    "q_variant_fields",
    "SELECT doc_id, doc_id AS id, lang AS meta_lang, source AS meta_origin_source, doc_id % 2 = 0 AS meta_origin_even, length(coalesce(text, ''))::BIGINT AS size, round(doc_id / 2, 3)::DOUBLE AS half, "
    "array_to_string(string_split(coalesce(text, ''), ' ')[:2], '|') AS words, CASE WHEN doc_id % 2 = 1 THEN doc_id END AS odd FROM documents",
)
def q_variant_fields(spark: SparkSession, d: str) -> DataFrame:
    """Nested JSON of every document, its schema by aggregation, each value in its type."""
    rows = variants.parsed(docs(spark, d).select("doc_id", F.expr(_NESTED).alias("json")), "json")
    found = variants.typed(rows, "doc_id")
    return found.select("doc_id", "id", "meta_lang", "meta_origin_source", "meta_origin_even", "size", F.round("half", 3).alias("half"), F.array_join("words", "|").alias("words"), "odd")


@query("q_variant_entries", "SELECT key, count(*) AS n, count(DISTINCT event_id) AS n_events, min(json_extract_string(props, '$.\"' || key || '\"')) AS first FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events) GROUP BY key")
def q_variant_entries(spark: SparkSession, d: str) -> DataFrame:
    """The entries of JSON objects whatever their keys."""
    rows = variants.entries(variants.parsed(table(spark, d, "events").select("event_id", "props"), "props"), "event_id")
    text = F.col("entry").cast("string")
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("n_events"), F.min(text).alias("first"))
