"""Text functions as Column expressions (F1-F17, T11, T12): no Python at run time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often it is named there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """pieces between runs of ASCII white space."""
    return F.filter(F.split(text, K.SPACE), lambda x: x != "")


def strip(token: Column, characters: str = K.STRIP) -> Column:
    """F3."""
    return F.btrim(token, F.lit(characters))


def is_number(token: Column) -> Column:
    """what a float parser takes once commas are out.  Few tokens begin as numbers do; only those are matched."""
    may = F.contains(F.lit(K.NUMBER_STARTS), F.substring(token, 1, 1))
    return F.when(may, F.replace(token, F.lit(","), F.lit("")).rlike(K.NUMERIC)).otherwise(False)


def is_currency(token: Column) -> Column:
    """F5."""
    return token.startswith("$")


def hyphens(token: Column) -> Column:
    return F.length(token) - F.length(F.replace(token, F.lit("-"), F.lit("")))


def is_chemical(token: Column) -> Column:
    """F7."""
    return hyphens(token) > 3


def is_chemical_name(token: Column) -> Column:
    """F6."""
    return (F.length(token) >= 25) & ((F.length(token) >= 40) | (hyphens(token) > 2))


def indicator(token: Column) -> Column:
    """F8: the indicator that stands for a token, null if it stays as it is."""
    return F.when(is_number(token), K.NUMBER).when(is_currency(token), K.CURRENCY).when(is_chemical_name(token), K.CHEMICAL)


def peel(token: Column) -> Column:
    """leading marks, the middle, a trailing mark; the mark stays on an abbreviation."""

    def cut(part: Column) -> Column:
        glued = part["b"].isin(K.ABBREVIATIONS)
        return F.when(glued, F.array(part["a"], F.concat(part["b"], part["c"]), F.lit(""))).otherwise(F.array(part["a"], part["b"], part["c"]))

    return let(F.struct(*[strip(F.regexp_extract(token, K.PEEL, i)).alias(name) for i, name in ((1, "a"), (2, "b"), (3, "c"))]), cut)


def marked(token: Column) -> Column:
    """Whether a token begins or ends with a mark; others are their own middle."""
    mark = lambda at: F.contains(F.lit(K.MARKS), F.substring(token, at, 1))
    return mark(1) | mark(-1)


def word_tokens(text: Column) -> Column:
    """Lower-cased, stripped tokens with indicators and marks of their own."""
    stripped = F.filter(F.transform(words(F.lower(text)), lambda x: strip(x)), lambda x: x != "")
    pieces = F.transform(stripped, lambda x: let(indicator(x), lambda i: F.when(i.isNotNull(), F.array(i)).when(marked(x), peel(x)).otherwise(F.array(x))))
    return F.filter(F.flatten(pieces), lambda x: x != "")


def simple_tokens(text: Column, stopwords: list[str] | None = None) -> Column:
    """lower-cased tokens without outer punctuation, stop-words out."""
    stops = K.STOPWORDS if stopwords is None else stopwords
    stripped = F.transform(words(F.lower(text)), lambda x: F.btrim(x, F.lit(K.PUNCTUATION)))
    return F.filter(stripped, lambda x: (x != "") & ~x.isin(stops))


def bigrams(tokens: Column) -> Column:
    """neighbours among the tokens that are left, so that they bridge what was dropped."""

    def paired(t: Column) -> Column:
        most = F.greatest(F.size(t) - 1, F.lit(0))
        return F.zip_with(F.slice(t, 1, most), F.slice(t, 2, most), lambda a, b: F.concat(a, F.lit(" "), b))

    return let(tokens, paired)


def terms(tokens: Column) -> Column:
    return let(tokens, lambda t: F.concat(t, bigrams(t)))


def counted(items: Column) -> Column:
    """(term, tf) of each different item of an array: runs of equal items once they are sorted."""

    def runs(s: Column) -> Column:
        begins = F.filter(F.transform(s, lambda x, i: i), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        ended = lambda b: F.transform(b, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(b, k + 1), F.size(s)) - i).cast("long").alias("tf")))
        return let(begins, ended)

    return let(F.sort_array(items), runs)


def is_table_row(sentence: Column) -> Column:
    """T11."""
    return (F.length(sentence) < K.MAX_TABLE_ROW) & (F.length(sentence) - F.length(F.replace(sentence, F.lit("."), F.lit(""))) > 2)


def trimmed(text: Column) -> Column:
    """Without white space of any sort at both ends."""
    return F.btrim(text, F.lit(K.WHITE))


def sentence_end(text: Column) -> Column:
    """T2."""
    return let(trimmed(text), lambda t: F.when(t != "", F.concat(F.btrim(t, F.lit(";.")), F.lit(". "))).otherwise(text))


def part_id(doc_id: Column, part_name: Column, part_no: Column) -> Column:
    """F16: id, id_name or id_name_part-n."""
    return F.concat(doc_id.cast("string"), F.coalesce(F.concat(F.lit("_"), part_name), F.lit("")), F.coalesce(F.concat(F.lit("_part-"), part_no.cast("string")), F.lit("")))
