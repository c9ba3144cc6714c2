"""Paragraphs and sentences of document fields.

Parsing gives the pieces of text of a tree, one nested row a document; everything after it is Column expressions.  What
reads like a fold - a paragraph that goes on with the one before, a sentence too short to stand alone - depends on a
paragraph's neighbours only, so each place says by itself whether something new starts there, and what lies between
two starts is joined (`glued`)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import is_table_row, let, sentence_end, trimmed

HEADING, PARAGRAPH, ITEM, DRAWINGS = "heading", "p", "li", "description-of-drawings"
#: Stands between sentences while a text is cut; a code point that is no character.
_CUT = "﷐"

# ---- from trees to pieces of text

_PIECE = pa.struct([("kind", pa.string()), ("text", pa.string())])
_NODE = pa.struct([("tag", pa.string()), ("pieces", pa.list_(_PIECE))])
_CHILDREN = pa.list_(pa.struct([("tag", pa.string()), ("nodes", pa.list_(_NODE))]))
_SCHEMA = "array<struct<tag string, nodes array<struct<tag string, pieces array<struct<kind string, text string>>>>>>"


class Pieces:
    """Collects the children of a root from its events: each with its text in order, or, for a description of
    drawings, with that of its own children.  A piece is the text of an element up to the element's first child
    ("item" in list items, else "head"), or what follows a child ("tail")."""

    def __init__(self) -> None:
        self.children: list[dict] = []
        self.open: list[str] = []
        self.fresh, self.place, self.last = True, 0, -1

    def start(self, tag: str, _attributes=None) -> None:
        level = len(self.open)
        if level == 1:
            self.children.append({"tag": tag, "nodes": [] if tag == DRAWINGS else [{"tag": tag, "pieces": []}]})
        elif level == 2 and self.open[1] == DRAWINGS:
            self.children[-1]["nodes"].append({"tag": tag, "pieces": []})
        self.open.append(tag)
        self.fresh, self.place = True, self.place + 1

    def end(self, _tag: str = "") -> None:
        self.open.pop()
        self.fresh, self.place = False, self.place + 1

    def data(self, text: str) -> None:
        level = len(self.open)
        if level < 2 or level == 2 and self.open[1] == DRAWINGS:
            return  # beside the children
        pieces = self.children[-1]["nodes"][-1]["pieces"]
        if self.last == self.place:
            pieces[-1]["text"] += text
        else:
            pieces.append({"kind": "tail" if not self.fresh else "item" if self.open[-1] == ITEM else "head", "text": text})
        self.last = self.place


def xml_pieces(xml: str | None) -> list[dict]:
    found, parser = Pieces(), expat.ParserCreate(encoding="utf-8")
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = found.start, found.end, found.data
    parser.Parse((xml or "<x/>").encode(), True)
    return found.children


class _Page(HTMLParser):
    """The headings, paragraphs and lists of an HTML page as children of one root, whatever else it holds."""

    TAGS = {"h1": HEADING, "h2": HEADING, "h3": HEADING, "p": PARAGRAPH, "ul": "ul", "ol": "ol"}

    def __init__(self) -> None:
        super().__init__()
        self.found, self.silent = Pieces(), 0
        self.found.start("page")

    def up_to(self, level: int) -> None:
        while len(self.found.open) > level:
            self.found.end()

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.silent += 1
        elif tag in self.TAGS:
            self.up_to(1)
            self.found.start(self.TAGS[tag])
        elif tag == ITEM and len(self.found.open) > 1:
            self.up_to(2)
            self.found.start(ITEM)

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)
        elif tag in self.TAGS or tag == ITEM:
            self.up_to(1 if tag in self.TAGS else 2)

    def handle_data(self, data):
        if not self.silent:
            self.found.data(data)


def html_pieces(html: str | None) -> list[dict]:
    page = _Page()
    page.feed(html or "")
    return page.found.children


def parsed(rows: DataFrame, key: str, column: str, html: bool = False) -> DataFrame:
    """(key, children) of a column of XML (or HTML) trees; null children where a tree cannot be parsed."""

    def children(text: str | None) -> list[dict] | None:
        try:
            return html_pieces(text) if html else xml_pieces(text)
        except expat.ExpatError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [children(x) for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(found, _CHILDREN)], [key, "children"])

    return rows.select(key, column).mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, children {_SCHEMA}")


# ---- joining what belongs together


def spaced(parts: Column) -> Column:
    return F.array_join(parts, " ")


def sentence_joined(parts: Column) -> Column:
    """T6 along an array: without the full stops around what is there, then one, a space and the next."""
    return F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.get(parts, F.lit(0)), lambda a, b: F.concat(F.btrim(a, F.lit(".")), F.lit(". "), b))


def glued(items: Column, join: Callable[[Column], Column]) -> Column:
    """The texts of `items`, an array of (text, starts), joined from each start up to the next; the first one starts."""

    def cut(b: Column) -> Column:
        places = F.when(F.size(b) > 0, F.sequence(F.lit(0), F.size(b) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: (i == 0) | F.get(b, i)["starts"])
        return let(starts, lambda s: F.transform(F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), lambda x, y: F.struct(x.alias("a"), F.coalesce(y, F.size(b)).alias("e"))), lambda r: join(F.transform(F.slice(b, r["a"] + 1, r["e"] - r["a"]), lambda x: x["text"]))))

    return let(items, cut)


# ---- paragraphs


def node_text(pieces: Column) -> Column:
    """List items are sentences, line feeds at the head of other elements are spaces."""
    told = F.transform(pieces, lambda p: F.when(p["kind"] == "item", sentence_end(p["text"])).when(p["kind"] == "head", F.replace(p["text"], F.lit("\n"), F.lit(" "))).otherwise(p["text"]))
    return trimmed(F.array_join(told, ""))


def drawings_text(nodes: Column) -> Column:
    """T5: each paragraph ends like a sentence, but for one after a heading."""

    def told(all_: Column) -> Column:
        after = lambda i: F.get(all_, i - 1)["tag"] == HEADING
        return spaced(F.transform(all_, lambda x, i: F.when((x["tag"] == PARAGRAPH) & ~F.coalesce(after(i), F.lit(False)), sentence_end(x["text"])).otherwise(x["text"])))

    return let(F.transform(nodes, lambda n: F.struct(n["tag"].alias("tag"), node_text(n["pieces"]).alias("text"))), told)


def tagged_texts(children: Column) -> Column:
    """(tag, text) of each child of a root."""
    text = lambda c: F.when(c["tag"] == DRAWINGS, drawings_text(c["nodes"])).otherwise(node_text(F.get(c["nodes"], F.lit(0))["pieces"]))
    return F.transform(children, lambda c: F.struct(c["tag"].alias("tag"), text(c).alias("text")))


def paragraphs(tagged: Column) -> Column:
    """T3, T4 over (tag, text): a child goes on with the paragraph before it if it is a paragraph after a heading, or if
    the child before it has a short text.  Children without text are left out, but for drawings, which always start."""

    def marked(all_: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            before = F.get(all_, i - 1)
            titled = (x["tag"] == PARAGRAPH) & (before["tag"] == HEADING)
            short = F.length(before["text"]).between(1, K.MIN_PARAGRAPH - 1)
            drawn = x["tag"] == DRAWINGS
            return F.struct(x["text"].alias("text"), (drawn | ~F.coalesce(titled | short, F.lit(False))).alias("starts"), (drawn | (trimmed(x["text"]) != "")).alias("told"))

        return F.filter(F.transform(all_, one), lambda x: x["told"])

    return glued(let(tagged, marked), spaced)


def joined_singles(found: Column) -> Column:
    """T7 over paragraphs: neighbours of one sentence each become one paragraph; one that stands alone among longer ones
    goes to the paragraph before it, or to the one after it where there is none before; empty ones take nothing."""
    flagged = F.transform(found, lambda p: F.struct(p.alias("text"), (F.size(sentences(p)) == 1).alias("single")))

    def marked(all_: Column) -> Column:
        single = lambda i: F.coalesce(F.get(all_, i)["single"], F.lit(False))
        empty = lambda i: F.coalesce(F.get(all_, i)["text"] == "", F.lit(True))
        alone = lambda i: single(i) & ~single(i - 1) & ~single(i + 1)
        joins = lambda i: (single(i) & single(i - 1)) | (alone(i) & ~empty(i - 1)) | (alone(i - 1) & empty(i - 2) & ~empty(i))
        return F.transform(all_, lambda x, i: F.struct(x["text"].alias("text"), (~joins(i)).alias("starts")))

    return glued(let(flagged, marked), sentence_joined)


# ---- sentences


def raw_sentences(text: Column) -> Column:
    """A rule in place of a trained model: a sentence ends at . ! or ? (and closing marks) before white space and a
    capital or digit (and an opening mark), unless the word before a full stop is an abbreviation."""
    ends = F.regexp_replace(text, "([.!?][\"')\\]]*[ \\t-\\r]+)([\"'(\\[]?[A-Z0-9])", f"$1{_CUT}$2")

    def cut(pieces: Column) -> Column:
        word = lambda x: F.btrim(F.lower(F.regexp_extract(x, "([^ \\t-\\r]*)[.][\"')\\]]*[ \\t-\\r]*$", 1)), F.lit("\"'(["))
        goes_on = lambda i: F.coalesce(word(F.get(pieces, i - 1)).isin(K.ABBREVIATIONS), F.lit(False))
        return F.transform(pieces, lambda x, i: F.struct(x.alias("text"), (~goes_on(i)).alias("starts")))

    found = glued(let(F.split(ends, _CUT), cut), lambda parts: F.array_join(parts, ""))
    return F.filter(F.transform(found, trimmed), lambda s: s != "")


def enforce_length(found: Column) -> Column:
    """Sentences that are short or rows of a table go to the one before; those that come first stay one, with a
    space before it, or go to the next if they are short together."""
    told = F.filter(F.transform(found, trimmed), lambda s: s != "")
    stands = lambda s: (F.length(s) >= K.MIN_SENTENCE) & ~is_table_row(s)
    marked = F.transform(told, lambda s: F.struct(s.alias("text"), stands(s).alias("starts")))

    def first(both: Column) -> Column:
        all_, leading = both["all"], F.concat(F.lit(" "), F.get(both["all"], F.lit(0)))
        short = (F.length(leading) < K.MIN_SENTENCE) & (F.size(all_) > 1)
        rest = lambda n: F.slice(all_, n, F.greatest(F.size(all_), F.lit(1)))
        return F.when(both["stands"], all_).when(short, F.concat(F.array(F.concat(leading, F.lit(" "), F.get(all_, F.lit(1)))), rest(3))).otherwise(F.concat(F.array(leading), rest(2)))

    whole = let(marked, lambda b: F.struct(glued(b, spaced).alias("all"), F.coalesce(F.get(b, F.lit(0))["starts"], F.lit(True)).alias("stands")))
    return let(whole, first)


def sentences(text: Column) -> Column:
    return enforce_length(raw_sentences(text))


def paragraphs_of(rows: DataFrame, key: str, column: str, html: bool = False, join_sentences: bool = True) -> DataFrame:
    """(key, number, paragraph) of a column of XML (or HTML) trees; a tree that cannot be parsed has none."""
    found = paragraphs(tagged_texts(F.col("children")))
    told = parsed(rows, key, column, html).where("children IS NOT NULL").select(key, F.posexplode(joined_singles(found) if join_sentences else found).alias("number", "paragraph"))
    return told.select(key, F.col("number").cast("long").alias("number"), "paragraph")
