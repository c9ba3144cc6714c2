"""Sentence boundaries learned from the texts themselves.

Which words are abbreviations, which pairs of words stand across a full stop without ending a sentence, and which words
often begin one is read off counts by likelihood ratios, after Kiss and Strunk, "Unsupervised Multilingual Sentence
Boundary Detection" (2006).  Counting and testing are groupings and joins; a text is only cut at the end.

    found = learn(documents)
    sentences_of(documents, "doc_id", found)      # (doc_id, sentences)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import let, trimmed, words
from ..sources.stores import kept

#: Fixed values of the method: scores from which a word is an abbreviation, a pair a collocation, a word a starter.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
MARKS_AROUND, MARKS_BEHIND = "\"'()[]{}“”‘’", ",;:"
NUMBER = "##number##"
#: The last characters of what `$` lets a mark stand before: the marks, and line ends that are no white space of words.
ENDINGS = ".?!\x85\u2028\u2029"
PLAIN, PERIOD, DOTS, MARK = "plain", "period", "dots", "mark"


def pieces(text: Column) -> Column:
    """The words of a text, each with the white space behind it."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[^ \\t-\\r]+[ \\t-\\r]*"), F.lit(0))


def token(piece: Column) -> Column:
    """(kind, type, case): how a word ends, its lower-cased form without what ends it, and the case of its first letter.

    Few words end as sentences do or begin as numbers do; only those are matched."""
    core = F.btrim(F.rtrim(piece, F.lit(" \t\n\x0b\f\r")), F.lit(MARKS_AROUND))

    return let(core, lambda c: let(form(c), lambda f: F.struct(kind(c).alias("kind"), typed(f).alias("type"), case(c).alias("case"))))


def may_end(core: Column) -> Column:
    return (core != "") & F.contains(F.lit(ENDINGS), F.substring(core, -1, 1))


def kind(core: Column) -> Column:
    return F.when(~may_end(core), PLAIN).when(core.rlike("[.][.]$"), DOTS).when(core.rlike("[?!][.?!]*$"), MARK).when(core.endswith("."), PERIOD).otherwise(PLAIN)


def form(core: Column) -> Column:
    return F.lower(F.rtrim(F.when(may_end(core), F.regexp_replace(core, "([.][.]+|[?!][.?!]*|[.])$", "")).otherwise(core), F.lit(MARKS_BEHIND)))


def typed(form: Column) -> Column:
    return F.when(F.substring(form, 1, 1).between("0", "9") & form.rlike("^[0-9][0-9.,:/-]*$"), NUMBER).otherwise(form)


def case(core: Column) -> Column:
    first = F.substring(core, 1, 1)
    return F.when(F.upper(first) != F.lower(first), F.when(first == F.lower(first), "lower").otherwise("upper")).otherwise("none")


def neighbours(text: Column) -> Column:
    """(cur, next, at) for each word with the one behind it, `at` counting from 0, and the first word behind nothing."""
    words = F.transform(pieces(text), token)
    pair = lambda t, i: F.struct(F.get(t, i - 1).alias("cur"), F.get(t, i).alias("next"), (i - 1).alias("at"))
    return let(words, lambda t: F.transform(F.sequence(F.lit(0), F.size(t)), lambda i: pair(t, i)))


def _log_likelihood(k: Column, n: Column, p: Column) -> Column:
    """log of p**k * (1 - p)**(n - k), nothing where a factor has no weight."""
    return F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(n - k > 0, (n - k) * F.log(1 - p)).otherwise(0.0)


def abbreviation_score(n_period: Column, n_plain: Column, form: Column, share: float) -> Column:
    """How much likelier it is that the word always has its full stop than that it has one by chance, times three factors:
    short words, words with full stops inside, and words that rarely stand without one."""
    n = n_period + n_plain
    ratio = -2 * (_log_likelihood(n_period, n, F.lit(share)) - _log_likelihood(n_period, n, F.lit(0.99)))
    inside = F.length(form) - F.length(F.replace(form, F.lit("."), F.lit("")))
    length = (F.length(form) - inside).cast("double")
    return ratio * F.exp(-length) * (inside + 1) * F.pow(length, -n_plain.cast("double"))


def association(k: Column, n1: Column, n2: Column, n: Column) -> Column:
    """Likelihood ratio of an event of n1 and one of n2 among n that meet k times; 0 if they meet less than by chance."""
    one = F.lit(1)
    p, p1, p2 = n2 / F.greatest(n, one), k / F.greatest(n1, one), (n2 - k) / F.greatest(n - n1, one)
    by_chance = _log_likelihood(k, n1, p) + _log_likelihood(n2 - k, n - n1, p)
    return F.when(p1 > p, -2 * (by_chance - _log_likelihood(k, n1, p1) - _log_likelihood(n2 - k, n - n1, p2))).otherwise(0.0)


@dataclass
class Boundaries:
    """What is learned, each a table: abbreviations (type, n_period, n_plain, score), collocations (type, next, n, score),
    starters (type, n, score), and cases (type, upper_inside, lower_start, upper, lower)."""

    abbreviations: DataFrame
    collocations: DataFrame
    starters: DataFrame
    cases: DataFrame


def type_counts(docs: DataFrame, column: str = "text") -> DataFrame:
    """(type, n_period, n_plain) of all words, one at a time and aggregated before the shuffle."""
    each = docs.select(F.explode(words(F.coalesce(F.col(column), F.lit("")))).alias("w")).select(F.btrim("w", F.lit(MARKS_AROUND)).alias("core"))
    each = each.select((kind(F.col("core")) == PERIOD).alias("period"), form(F.col("core")).alias("form")).select("period", typed(F.col("form")).alias("type"))
    return each.groupBy("type").agg(F.count(F.when(F.col("period"), 1)).alias("n_period"), F.count(F.when(~F.col("period"), 1)).alias("n_plain"))


def _totals(types: DataFrame) -> tuple[int, float]:
    """The number of words, and the share of those with a full stop."""
    total = types.agg(F.sum(F.col("n_period") + F.col("n_plain")).alias("n"), F.sum("n_period").alias("periods")).first()
    return total["n"] or 0, min(max((total["periods"] or 0) / max(total["n"] or 0, 1), 1e-9), 1 - 1e-9)


def abbreviations(types: DataFrame, share: float) -> DataFrame:
    """(type, n_period, n_plain, score): of the types those that are abbreviations."""
    scored = types.where((F.col("n_period") > 0) & F.col("type").rlike("\\p{L}") & (F.col("type") != NUMBER)).withColumn("score", abbreviation_score(F.col("n_period"), F.col("n_plain"), F.col("type"), share))
    return scored.where(F.col("score") >= ABBREVIATION).select("type", "n_period", "n_plain", "score")


def learn_abbreviations(docs: DataFrame, column: str = "text") -> DataFrame:
    """The abbreviations that `learn` finds, without what it learns beside them: no pair of words is made."""
    types = kept(type_counts(docs, column), "types")
    return abbreviations(types, _totals(types)[1])


def learn(docs: DataFrame, column: str = "text", given: tuple[str, ...] = tuple(K.ABBREVIATIONS)) -> Boundaries:
    """Boundaries of the texts of `docs`; `given` are abbreviations in any case (score null).

    Null and empty texts teach nothing, repeated rows count each, other columns are ignored; without texts all tables but
    the given abbreviations are empty.  Pairs are aggregated before the shuffle; two totals go to the driver."""
    spark = docs.sparkSession
    each = docs.select(F.explode(neighbours(F.col(column))).alias("p"))
    # a word that has no full stop of its own is not told apart from others as what stands before
    known = F.col("p.cur.kind") == PERIOD
    pairs = each.groupBy(F.coalesce("p.cur.kind", F.lit("start")).alias("kind"), F.when(known, F.col("p.cur.type")).alias("type"), F.col("p.next.kind").alias("next_kind"), F.col("p.next.type").alias("next"), F.col("p.next.case").alias("case"))
    pairs = kept(pairs.agg(F.count(F.lit(1)).alias("n")), "pairs")
    # every word is the next one of some pair
    words = pairs.where("next_kind is not null")
    types = words.groupBy(F.col("next").alias("type")).agg(F.sum(F.when(F.col("next_kind") == PERIOD, F.col("n")).otherwise(0)).alias("n_period"), F.sum(F.when(F.col("next_kind") != PERIOD, F.col("n")).otherwise(0)).alias("n_plain"))
    types = kept(types, "types")
    n, share = _totals(types)
    listed = spark.createDataFrame([(x,) for x in dict.fromkeys(given)], "type string")
    found = abbreviations(types, share)
    extra = listed.join(found, "type", "left_anti").select("type", *[F.lit(None).cast(k).alias(c) for c, k in (("n_period", "long"), ("n_plain", "long"), ("score", "double"))])
    short = kept(found.unionByName(extra), "abbreviations")
    stops = pairs.where((F.col("kind") == PERIOD) & F.col("next").isNotNull()).join(short.select("type", F.lit(True).alias("short")), "type", "left").withColumn("short", F.coalesce("short", F.lit(False)))
    others = pairs.where((F.col("kind") != PERIOD) & F.col("next").isNotNull()).withColumn("short", F.lit(False))
    told = kept(stops.unionByName(others), "told")
    ends = ((F.col("kind") == PERIOD) & ~F.col("short")) | F.col("kind").isin(MARK, "start")
    inside = F.col("kind") == PLAIN
    add = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    upper, lower = F.col("case") == "upper", F.col("case") == "lower"
    cases = told.groupBy(F.col("next").alias("type")).agg(add(upper & inside).alias("upper_inside"), add(lower & ends).alias("lower_start"), add(upper).alias("upper"), add(lower).alias("lower"))
    after = told.where((F.col("kind") == PERIOD) & ~F.col("short"))
    n_after = after.agg(F.sum("n")).first()[0] or 0
    counts = types.select("type", (F.col("n_period") + F.col("n_plain")).alias("n2"))
    lettered = F.col("type").rlike("^\\p{L}")
    starters = after.groupBy(F.col("next").alias("type")).agg(F.sum("n").alias("k")).join(counts, "type").where(lettered)
    starters = starters.withColumn("score", association(F.col("k"), F.lit(n_after), F.col("n2"), F.lit(n))).where(F.col("score") >= STARTER).select("type", F.col("k").alias("n"), "score")
    starters = kept(starters, "starters")
    initial = (F.length("type") == 1) & lettered
    held = told.where((F.col("kind") == PERIOD) & (F.col("short") | initial | (F.col("type") == NUMBER)) & F.col("next").rlike("^\\p{L}"))
    held = held.groupBy("type", "next").agg(F.sum("n").alias("k")).where("k > 1")
    held = held.join(counts.withColumnRenamed("n2", "n1"), "type").join(counts.withColumnRenamed("type", "next"), "next").join(starters.select(F.col("type").alias("next")), "next", "left_anti")
    collocations = held.withColumn("score", association(F.col("k"), F.col("n1"), F.col("n2"), F.lit(n))).where(F.col("score") >= COLLOCATION)
    return Boundaries(short, kept(collocations.select("type", "next", F.col("k").alias("n"), "score"), "collocations"), starters, kept(cases, "cases"))


def ends_of(docs: DataFrame, key: str, found: Boundaries, column: str = "text") -> DataFrame:
    """(key, at): the words behind which a sentence ends, but for the last one of a text."""
    rows = docs.select(key, F.explode(neighbours(F.col(column))).alias("p")).where("p.cur is not null and p.next is not null and p.cur.kind <> 'plain'")
    rows = rows.select(key, "p.at", F.col("p.cur.kind").alias("kind"), F.col("p.cur.type").alias("type"), F.col("p.next.type").alias("next"), F.col("p.next.case").alias("case"))
    sure = rows.where(F.col("kind") == MARK).select(key, "at")
    open_ = rows.where(F.col("kind") != MARK)
    open_ = open_.join(found.abbreviations.select("type", F.lit(True).alias("short")), "type", "left")
    open_ = open_.join(found.collocations.select("type", "next", F.lit(True).alias("goes_on")), ["type", "next"], "left")
    open_ = open_.join(found.starters.select(F.col("type").alias("next"), F.lit(True).alias("starter")), "next", "left")
    open_ = open_.join(found.cases.withColumnRenamed("type", "next"), "next", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    upper, lower = F.col("case") == "upper", F.col("case") == "lower"
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    # what the case of the next word says: it begins a sentence, it does not, or nothing
    begins = upper & (count("lower") > 0) & (count("upper_inside") == 0)
    does_not = lower & ((count("upper") > 0) | (count("lower_start") == 0))
    initial = (F.length("type") == 1) & F.col("type").rlike("\\p{L}")
    undecided = (F.col("kind") == DOTS) | yes("short")
    ends = F.when((F.col("kind") == PERIOD) & yes("goes_on"), False).when(undecided & initial & (F.col("kind") == PERIOD), False).when(undecided, begins | (upper & yes("starter")))
    ends = ends.when(initial | (F.col("type") == NUMBER), ~does_not).otherwise(True)
    return open_.where(ends).select(key, "at").unionByName(sure)


def sentences_of(docs: DataFrame, key: str, found: Boundaries, column: str = "text") -> DataFrame:
    """(key, sentences) of texts under different keys, cut where `found` says.  A null or empty text has no sentences."""
    at = ends_of(docs, key, found, column).groupBy(key).agg(F.sort_array(F.collect_list("at")).alias("ends"))  # bounded by the text
    rows = docs.select(key, F.col(column).alias("text")).join(at, key, "left").select(key, pieces(F.col("text")).alias("words"), F.coalesce("ends", F.array().cast("array<int>")).alias("ends"))
    stops = F.concat(F.array(F.lit(-1)), "ends", F.array(F.size("words") - 1))
    cut = let(stops, lambda s: F.transform(F.sequence(F.lit(1), F.size(s) - 1), lambda i: trimmed(F.array_join(F.slice("words", F.get(s, i - 1) + 2, F.get(s, i) - F.get(s, i - 1)), ""))))
    return rows.select(key, F.filter(cut, lambda s: s != "").alias("sentences"))
