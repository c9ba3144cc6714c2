"""Projection of documents from XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import IPC
from .onepass import read_fields

_GRANT = "/us-patent-grant/us-bibliographic-data-grant"
#: Field -> path, for both schema versions; values are the text of every match.
PATHS = {
    4: {
        "patent_country": f"{_GRANT}/publication-reference/document-id/country",
        "patent_doc_number": f"{_GRANT}/publication-reference/document-id/doc-number",
        "patent_date": f"{_GRANT}/publication-reference/document-id/date",
        "patent_kind": f"{_GRANT}/publication-reference/document-id/kind",
        "application_country": f"{_GRANT}/application-reference/document-id/country",
        "application_doc_number": f"{_GRANT}/application-reference/document-id/doc-number",
        "application_date": f"{_GRANT}/application-reference/document-id/date",
        "inventors": f"{_GRANT}/parties/applicants//applicant/addressbook//*[self::last-name or self::first-name or self::city or self::country] | {_GRANT}/us-parties/us-applicants//us-applicant/addressbook//*[self::last-name or self::first-name or self::city or self::country]",
        "invention_title": f"{_GRANT}/invention-title",
        "classification_national_main": f"{_GRANT}/classification-national/main-classification",
        "classification_national_further": f"{_GRANT}/classification-national//further-classification",
        "classification_ipc": f"{_GRANT}/classification-ipc/*[self::main-classification or self::further-classification] | {_GRANT}/classifications-ipcr//classification-ipcr/*[self::section or self::class or self::subclass or self::main-group or self::subgroup]",
        "us_field_of_search": f"{_GRANT}//classification-national/main-classification",
        "references_cited": f"{_GRANT}/references-cited//citation/patcit/document-id/doc-number | {_GRANT}/us-references-cited//us-citation/patcit/document-id/doc-number",
    },
    2: {
        "patent_country": "/PATDOC/SDOBI/B100/B190/PDAT",
        "patent_doc_number": "/PATDOC/SDOBI/B100/B110/DNUM/PDAT",
        "patent_date": "/PATDOC/SDOBI/B100/B140/DATE/PDAT",
        "patent_kind": "/PATDOC/SDOBI/B100/B130/PDAT",
        "application_country": "/PATDOC/SDOBI/B100/B190/PDAT",
        "application_doc_number": "/PATDOC/SDOBI/B100/B110/DNUM/PDAT",
        "application_date": "/PATDOC/SDOBI/B100/B140/DATE/PDAT",
        "inventors": "/PATDOC/SDOBI/B700/B720//B721//*",
        "invention_title": "/PATDOC/SDOAB/BTEXT/PARA/PTEXT/PDAT",
        "classification_national_main": "/PATDOC/SDOBI/B500/B520/B521/PDAT",
        "classification_national_further": "/PATDOC/SDOBI/B500/B520//B522/PDAT",
        "classification_ipc": "/PATDOC/SDOBI/B500/B510/B511/PDAT | /PATDOC/SDOBI/B500/B510//B512/PDAT",
        "us_field_of_search": "/PATDOC/SDOBI/B500/B580/B582//*",
        "references_cited": "/PATDOC/SDOBI/B500/B560//B561/PCIT/DOC/DNUM/PDAT",
    },
}
SUBTREES = {4: {"abstract_xml": "abstract", "description_xml": "description", "claims_xml": "claims"}, 2: {"abstract_xml": "SDOAB", "description_xml": "SDODE", "claims_xml": "SDOCL"}}
REQUIRED = ["ipc", "inventors", "abstract_xml", "description_xml", "claims_xml"]
LISTS = ("classification_national_further", "us_field_of_search", "references_cited", "inventors", "classification_ipc")
#: Fields without white space.
SQUEEZED = {"references_cited", "us_field_of_search"} | {f for f in PATHS[4] if f.startswith("classification")}


def clean_xml(xml: Column) -> Column:
    """Processing instructions but the declaration go, and the tags (not the text) of inline marks."""
    return F.regexp_replace(F.regexp_replace(xml, r"<\?(?!xml)[^>]*>", ""), r"</?(b|i|figref|sequence-cwu|claim-ref)( [^>]*)?/?>", "")


def values(found: Column, squeeze: bool = False) -> Column:
    """Without nulls and values that start a line; null if nothing is left."""
    kept = F.filter(found, lambda v: v.isNotNull() & ~v.startswith("\n"))
    kept = F.transform(kept, lambda v: F.regexp_replace(v, "[ \\t-\\r]", "")) if squeeze else kept
    return F.when(F.size(kept) > 0, kept)


def parse_ipc(parts: Column) -> Column:
    """An array of (section, class, subclass)."""
    joined = F.regexp_replace(F.array_join(parts, ""), "[ \\t-\\r]", "")
    cut = lambda v: F.struct(F.substring(v, 1, 1).alias("section"), F.substring(v, 2, 2).alias("class"), F.substring(v, 4, 1).alias("subclass"))
    return F.transform(F.regexp_extract_all(joined, F.lit(IPC), F.lit(1)), cut)


def valid_version_2(parts: Column) -> Column:
    """P10."""
    return F.forall(parts, lambda v: v.rlike("^[A-Z]"))


def chunk_inventors(flat: Column, last_first: bool) -> Column:
    """Fours of a flat list; what is left over at the end goes."""
    first, last = (1, 0) if last_first else (0, 1)

    def four(i: Column) -> Column:
        at = lambda k: F.get(flat, i * 4 + k)
        return F.struct(at(first).alias("first_name"), at(last).alias("last_name"), at(2).alias("city"), at(3).alias("country"))

    count = F.floor(F.size(flat) / 4).cast("int")
    return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: i < count), four)


def scalar(found: Column) -> Column:
    """P13."""
    return F.coalesce(F.get(found, F.lit(0)), F.lit(""))


def parsed_documents(raw: DataFrame) -> DataFrame:
    """Every document, by one parse, with the texts of all its fields and its text fields as XML, or with the
    `error` of the parser."""
    return read_fields(raw.withColumn("xml", clean_xml(F.col("xml"))), PATHS, SUBTREES)


def rejected(raw: DataFrame) -> DataFrame:
    """(path, seq, error, xml) of documents that `patents` leaves out because they cannot be parsed."""
    return parsed_documents(raw).where("error is not null").select("path", "seq", "error", "xml")


def fields(raw: DataFrame, version: int) -> DataFrame:
    """The values of every field of documents (doc_id, xml) in one schema version, as arrays or null, and its text
    fields as XML.  A document that cannot be parsed has nulls."""
    found = read_fields(raw.select("doc_id", "xml", F.lit(version).alias("dtd_version")), PATHS, SUBTREES)
    return found.select("doc_id", *[values(F.col(name), name in SQUEEZED).alias(name) for name in PATHS[version]], *SUBTREES[version])


def json_values(rows: DataFrame, column: str, *keep: str) -> DataFrame:
    """(*keep, key, value), one row for each entry of a JSON object; broken or null JSON gives none."""
    return rows.select(*keep, F.explode(F.from_json(column, "map<string,string>")).alias("key", "value"))


def patents(raw: DataFrame) -> DataFrame:
    """P1-P15 over raw documents (path, year, seq, dtd_version, xml): one row for each complete patent."""
    parsed = parsed_documents(raw).where("error is null")
    columns = [values(F.col(name), name in SQUEEZED).alias(name) for name in PATHS[4]]
    rows = parsed.select("path", "seq", "dtd_version", *SUBTREES[4], *columns)
    rows = rows.where((F.col("dtd_version") == 4) | valid_version_2(F.col("classification_ipc")))
    last_first = F.when(F.col("dtd_version") == 4, chunk_inventors(F.col("inventors"), True)).otherwise(chunk_inventors(F.col("inventors"), False))
    rows = rows.withColumn("ipc", parse_ipc(F.col("classification_ipc"))).withColumn("inventors", last_first).drop("classification_ipc").dropna(subset=REQUIRED)
    single = [c for c in PATHS[4] if c not in LISTS]
    return rows.withColumns({c: scalar(F.col(c)) for c in single}).withColumnRenamed("patent_doc_number", "doc_id")


def _texts(path: str) -> Column:
    """P5: the text of every match."""
    return F.xpath(F.col("xml"), F.lit(" | ".join(f"{p.strip()}/text()" for p in path.split(" | "))))


def classification_dictionary(documents: DataFrame) -> DataFrame:
    """K2: (kind, id) lines, three for each classification; class and subclass without what stands above them."""
    parts = documents.select("doc_id", F.inline("ipc"))
    return parts.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("id")) for k in ("section", "class", "subclass")])))


def required(rows: DataFrame, columns: list[str]) -> DataFrame:
    """P7, P15."""
    return rows.dropna(subset=columns)
