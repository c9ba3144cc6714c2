"""Filter interaction audit by a subset-zeta transform.

Every document gets a mask with one bit for each filter that it fails.  Counts of masks, a few numbers for each part of
the corpus, are all that is needed: a document survives a set of filters if its mask has none of their bits, so that a
zeta transform over subsets turns the counts into the survivors of every set of filters at once.  What a step of an
order removes is the difference between two neighbouring sets; good and toxic documents are counted likewise.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator, Sequence
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, materialize, row_id, slices, table, utf8

#: The filters by letter, as conditions under which a document fails, over the columns of `facts` and `is_copy`.
FILTERS = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_upper > 3 * n_points",
    "D": "n_marks > 0",
    "E": "is_copy",
}
UPPER, MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
#: Bytes that continue a code point.
CONTINUED = bytes(range(0x80, 0xC0))
#: Bytes of a text that are cut into words at a time.
BLOCK = 1 << 20
_SPACE = re.compile(b"[ \t-\r]")


def blocks(text: bytes, border: re.Pattern = _SPACE, size: int = BLOCK) -> Iterator[bytes]:
    """The text in pieces of about `size` bytes that end before a `border`."""
    at = 0
    while len(text) - at > size:
        found = border.search(text, at + size)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def text_facts(text: bytes) -> tuple[int, int, int, int, int]:
    """Words, different words, letters A-Z, code points and marks of a text."""
    n_words, different = 0, set()
    for block in blocks(text):
        words = block.split()  # at the six ASCII white-space characters
        n_words += len(words)
        different.update(words)
    n_upper, n_marks = (len(text) - len(text.translate(None, some)) for some in (UPPER, MARKS))
    return n_words, len(different), n_upper, len(text.translate(None, CONTINUED)), n_marks


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["n_words", "n_distinct", "n_upper", "n_points", "n_marks"]
    for batch in batches:
        for part in slices(batch, "text", 2_000_000):
            texts = utf8(part, "text")
            found = np.array([text_facts(t) for t in texts], np.int64).reshape(-1, len(names))
            digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            numbers = [pa.array(found[:, i].copy()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("part"), digests, *numbers], ["id", "part", "digest", *names])


def facts(docs: DataFrame) -> DataFrame:
    """(id, part, digest, n_words, n_distinct, n_upper, n_points, n_marks), a row for each document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    given = docs.select(row_id().alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    return given.mapInArrow(_facts, "id long, part string, digest binary, n_words long, n_distinct long, n_upper long, n_points long, n_marks long")


def mask_counts(rows: DataFrame, fails: Sequence[Column]) -> DataFrame:
    """(part, mask, n, good, toxic): documents of `rows` (part, good, toxic, ...) by the conditions that they meet,
    aggregated before the shuffle; a part has no more rows than there are sets of conditions."""
    mask = F.lit(0)
    for i, failed in enumerate(fails):
        mask = mask + F.when(failed, 1 << i).otherwise(0)
    number = lambda c: F.sum(F.when(F.col(c), 1).otherwise(0)).cast("long").alias(c)
    return rows.groupBy("part", mask.alias("mask")).agg(F.count(F.lit(1)).alias("n"), number("good"), number("toxic"))


def survivors(counts: np.ndarray) -> np.ndarray:
    """From counts by mask (rows: masks) the counts of those that survive each set of filters (rows: sets).

    The zeta transform adds up, one bit after the other, what the subsets of each set hold; who survives a set has a
    mask inside its complement."""
    inside = counts.copy()
    each = np.arange(len(counts))
    for bit in (1 << b for b in range(len(counts).bit_length() - 1)):
        have = each[each & bit > 0]
        inside[have] += inside[have ^ bit]
    return inside[::-1]


def audit_rows(counts: np.ndarray, letters: str) -> list[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every order."""
    left = survivors(counts)
    n, every = len(letters), len(counts) - 1
    total = left[0, 0]
    shapley, unique, fails = {}, {}, {}
    for i, letter in enumerate(letters):
        bit = 1 << i
        # each set that may stand before the filter does so in as many orders as its members and the others have
        before = [s for s in range(every + 1) if not s & bit]
        shapley[letter] = sum(factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()) * int(left[s, 0] - left[s | bit, 0]) for s in before)
        unique[letter] = left[every ^ bit, 0] - left[every, 0]
        fails[letter] = total - left[bit, 0]
    rows = []
    for order in itertools.permutations(letters):
        past = 0
        for step, letter in enumerate(order, 1):
            now = past | 1 << letters.index(letter)
            removed, good, toxic = (int(x) for x in left[past] - left[now])
            rows.append(("".join(order), step, int(left[now, 0]), removed, int(fails[letter]) - removed, int(unique[letter]), good, toxic, shapley[letter]))
            past = now
    return rows


RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(counts: DataFrame, letters: str) -> DataFrame:
    """A row for each part, order of the filters and step, from (part, mask, n, good, toxic)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        whole = np.zeros((1 << len(letters), 3), np.int64)
        whole[group["mask"].to_numpy()] = group[["n", "good", "toxic"]].to_numpy()
        done = pd.DataFrame(audit_rows(whole, letters), columns=[c.split()[0] for c in RESULT.split(", ")[1:]])
        done.insert(0, "part", group["part"].iloc[0])
        return done

    return counts.groupBy("part").applyInPandas(run, RESULT)


def filter_audit(docs: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS) -> DataFrame:
    """What each filter removes at each step of each order, for each `lang` of `docs` (doc_id, text, lang).

    `filters`: conditions of failure by letter, in SQL over n_words, n_distinct, n_upper, n_points, n_marks and is_copy
    (the text, by its SHA-256, also stands under a smaller doc_id).  A null text counts as empty, a null lang as the
    part ''.  A null doc_id is smaller than any other and has no label; rows that share doc_id and text are no copies
    of each other but count each.  Of several labels of a document one that says 1 is enough.  Other columns are
    ignored; an empty table gives an empty result."""
    rows = materialize(facts(docs), "facts")
    first = rows.groupBy("digest").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("first_id < last_id").drop("last_id")
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias("toxic" if c == "toxic" else "good")
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(says("quality"), says("toxic"))
    joined = rows.join(first, "digest", "left").withColumn("is_copy", F.coalesce(F.col("id") > F.col("first_id"), F.lit(False)))
    joined = joined.join(marks, "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    return audit(mask_counts(joined, [F.expr(x) for x in filters.values()]), "".join(filters))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = rf"""
WITH given AS (SELECT coalesce(doc_id, {NULL_ID}) AS id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
firsts AS (SELECT t, min(id) AS first_id FROM given GROUP BY t),
split AS (SELECT id, part, t, id > first_id AS is_copy, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM given JOIN firsts USING (t)),
marks AS (SELECT doc_id AS id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
masked AS (SELECT part, good, toxic, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * is_copy::INT AS mask FROM split LEFT JOIN marks USING (id)),
counts AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM masked GROUP BY ALL),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(l, b)),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM letters a, letters b, letters c, letters d, letters e WHERE a.b | b.b | c.b | d.b | e.b = 31),
steps AS (SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[:step - 1]), 0)::INT AS past FROM orders, range(1, 6) r(step)),
done AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (past | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & past = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & past > 0 AND mask & bit > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & past = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & past = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost
  FROM counts, steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM done
"""
