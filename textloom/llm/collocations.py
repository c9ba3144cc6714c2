"""Phrase collocation mining: merged count-min sketches, then exact counts of the survivors.

The first pass counts runs of one to four words in count-min sketches, one a flush of a partition, which are merged by
adding cells.  A cell never counts less than any run in it, so that runs that the merged sketch puts below the least
frequency are left out of the second pass for good.  That pass counts the others exactly, by their words.  Runs are
scored by their weakest cut, and those that mostly stand inside a longer run go.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slices, table, utf8
from .filter_audit import blocks
from .windows import mix, pair

LEAST, LONGEST, SHARE, TOP = 30, 4, 80, 2000
NO_LANG = "und"
#: What ends a piece, and what separates words besides; both are safe places to cut a text.
ENDS, BORDER = b".,;:!?\n\x0b\x0c\r", re.compile(rb"[ \t.,;:!?\x0a-\x0d]")
_AS_STOP = bytes.maketrans(ENDS, b"." * len(ENDS))
#: Rows of a sketch; cells of a shard, the unit of merging, as a power of two.
DEPTH, SHARD_BITS = 2, 20
#: Cells of a row as a power of two, so many that each gets about ITEMS_A_CELL runs; there are 2**26 at least.
ITEMS_A_CELL, FEWEST_BITS, MOST_BITS = 12, 26, 50
#: Bits of a row that are broadcast, as a power of two: cells beyond fall together, which counts only for frequent ones.
FOLDED_BITS = 29
#: Words (with the borders between pieces) that are worked on at once, and words that a worker numbers.
FLUSH, NUMBERED = 800_000, 250_000
#: Buckets of a language among which its best phrases are first sought.
BUCKETS = 16


class _Numbers(dict):
    """word -> its number, for one language."""

    def __init__(self, own: Words, lang: int, seed: int):
        super().__init__({b".": 0})
        self.own, self.lang, self.seed = own, lang, seed

    def __missing__(self, word: bytes) -> int:
        own = self.own
        number = self[word] = len(own.words)
        own.words.append(word)
        own.of_lang.append(self.lang)
        own.hashes.append(xxhash.xxh3_64_intdigest(word, self.seed))
        return number


class Words:
    """Numbers of the words of all languages; 0 is the border between pieces."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.words, self.of_lang, self.hashes, self.by_lang = [b""], array("i", [0]), array("Q", [0]), {}

    def numbers(self, text: bytes, lang: str) -> Iterator[np.ndarray]:
        """The text as numbers of words, in blocks."""
        if (known := self.by_lang.get(lang)) is None:
            known = self.by_lang[lang] = _Numbers(self, len(self.by_lang), xxhash.xxh3_64_intdigest(lang.encode()))
        for block in blocks(text, BORDER):
            found = block.lower().translate(_AS_STOP).replace(b".", b" . ").split()  # A-Z only; at spaces and tabs
            yield np.fromiter(map(known.__getitem__, found), np.int32, len(found))


def streams(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[tuple[np.ndarray, int, Words]]:
    """(numbers, own, words): texts (lang, text) as numbers.  Runs may start at the first `own` places; what follows is
    there to complete them."""
    words, waiting, held = Words(), [], 0

    def flush() -> Iterator[tuple[np.ndarray, int, Words]]:
        whole = np.concatenate(waiting)
        for at in range(0, len(whole), FLUSH):
            yield whole[at : at + FLUSH + longest - 1], min(FLUSH, len(whole) - at), words

    border = np.zeros(1, np.int32)
    for batch in batches:
        for part in slices(batch, "text", 2_000_000):
            for text, lang in zip(utf8(part, "text"), part.column("lang").to_pylist(), strict=True):
                for numbers in words.numbers(text, lang):
                    waiting.append(numbers)
                    held += len(numbers)
                waiting.append(border)
                if held >= FLUSH:
                    yield from flush()
                    waiting, held = [], 0
                    if len(words.words) > NUMBERED:
                        words.clear()
    if held:
        yield from flush()


def runs_of(numbers: np.ndarray, own: int, words: Words, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, hashes, starts) for n = 2 and more: the hash of the run of n words at each place, and whether one starts there."""
    each = np.array(words.hashes, np.uint64)[numbers]
    real = numbers != 0
    hashes, starts = each, real.copy()
    starts[own:] = False
    for n in range(2, longest + 1):
        hashes = pair(hashes[:-1], each[n - 1 :])
        starts = starts[:-1] & real[n - 1 :]
        yield n, hashes, starts


# ---- the sketch


def width_for(items: float) -> int:
    return int(min(MOST_BITS, max(FEWEST_BITS, np.ceil(np.log2(max(items, 1) / ITEMS_A_CELL)))))


def cells(items: np.ndarray, row: int, bits: int) -> np.ndarray:
    salt = np.uint64(0x9FB21C651E98DF25 * (2 * row + 1) % 2**64)
    return mix(items ^ salt) >> np.uint64(64 - bits)


def packed(at: np.ndarray, counts: np.ndarray) -> bytes:
    """Rising places and their counts, as bytes."""
    steps = np.diff(at, prepend=np.uint32(0)).astype(np.uint32)
    return zstandard.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes() + counts.astype(np.uint8).tobytes(), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    n = len(raw) // 5
    return np.cumsum(np.ascontiguousarray(raw[: 4 * n].reshape(4, n).T).view(np.uint32).ravel(), dtype=np.int64), raw[4 * n :]


def sketch_of(items: np.ndarray, counts: np.ndarray, bits: int, most: int) -> Iterator[tuple[int, int, bytes]]:
    """(row, shard, cells) of a sketch of the items with their counts; cells count to `most`."""
    low = np.uint64(min(bits, SHARD_BITS))
    for row in range(DEPTH):
        # counts hold eight bits: one sort puts cells and counts in order
        keyed = np.sort(cells(items, row, bits) << np.uint64(8) | np.minimum(counts, most).astype(np.uint64))
        at, n = keyed >> np.uint64(8), (keyed & np.uint64(255)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        at, n = at[first], np.minimum(np.add.reduceat(n, first), most)
        shards = (at >> low).astype(np.int64)
        inside = (at & ((np.uint64(1) << low) - np.uint64(1))).astype(np.uint32)
        edges = np.append(np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]]), len(at))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield row, int(shards[a]), packed(inside[a:b], n[a:b])


def _count(bits: int, longest: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for numbers, own, words in streams(batches, longest):
            used, times = np.unique(numbers[:own], return_counts=True)
            used, times = used[used != 0], times[used != 0]
            found, counts = np.unique(np.concatenate([hashes[starts] for _, hashes, starts in runs_of(numbers, own, words, longest)]), return_counts=True)
            items, counts = np.concatenate([np.array(words.hashes, np.uint64)[used], found]), np.concatenate([times, counts])
            if len(items):
                rows, shards, blobs = zip(*sketch_of(items, counts, bits, most), strict=True)
                fold = (np.array(shards) & (2 ** max(0, FOLDED_BITS - SHARD_BITS) - 1)) * DEPTH + np.array(rows)
                yield pa.RecordBatch.from_pydict({"fold": pa.array(fold, pa.int64()), "shard": pa.array(shards, pa.int64()), "cells": pa.array(blobs, pa.binary())})

    return run


def _merge(bits: int, most: int):
    """Add up the sketches of each shard (rows come sorted by fold and shard); what comes out for each fold is a bit a
    cell: `most` or more in one of its shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sums, many = None, np.zeros(2 ** min(bits, SHARD_BITS), np.uint8), np.zeros(2 ** min(bits, SHARD_BITS), bool)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"fold": pa.array([last[0]], pa.int64()), "many": pa.array([np.packbits(many).tobytes()], pa.binary())})

        for batch in batches:
            for fold, shard, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last != (fold, shard):
                    many |= sums >= most
                    sums[:] = 0
                    if last is not None and last[0] != fold:
                        yield out()
                        many[:] = False
                    last = fold, shard
                at, counts = unpacked(data)  # different cells; sums stay below 2 * most
                sums[at] = np.minimum(sums[at] + counts, most)
        if last is not None:
            many |= sums >= most
            yield out()

    return run


def frequent_cells(texts: DataFrame, bits: int, longest: int, least: int) -> Broadcast:
    """The merged sketch of all runs, as a bit a cell: counted `least` times or more (cells count to 127 at most).

    Cells grow with the texts and are merged in shards; what goes to the driver and back are DEPTH rows of at most
    2**FOLDED_BITS bits, whatever the number of cells."""
    least = min(least, 127)
    sent = texts.mapInArrow(_count(bits, longest, least), "fold long, shard long, cells binary")
    merged = sent.repartition("fold").sortWithinPartitions("fold", "shard").mapInArrow(_merge(bits, least), "fold long, many binary")
    whole = np.zeros((DEPTH, 2 ** max(0, min(bits, FOLDED_BITS) - SHARD_BITS), 2 ** min(bits, SHARD_BITS) // 8), np.uint8)
    for r in merged.toLocalIterator():
        whole[r["fold"] % DEPTH, r["fold"] // DEPTH] = np.frombuffer(r["many"], np.uint8)
    return texts.sparkSession.sparkContext.broadcast(whole.reshape(DEPTH, -1))


def may_be_frequent(sketch: np.ndarray, items: np.ndarray, bits: int) -> np.ndarray:
    said = np.ones(len(items), bool)
    for row in range(DEPTH):
        at = cells(items, row, bits).astype(np.int64) & (8 * sketch.shape[1] - 1)
        said &= (sketch[row][at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return said


# ---- exact counts


def survivors(numbers: np.ndarray, own: int, words: Words, longest: int, sketch: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, places, counts): where each different run of n words that may be frequent stands first, and how often it
    stands among these words.  A run is left out with its first or last words, which are no rarer."""
    used, times = np.unique(numbers[:own], return_counts=True)
    hashes = np.array(words.hashes, np.uint64)
    fine = np.zeros(len(hashes), bool)
    fine[numbers] = True
    listed = np.flatnonzero(fine)
    fine[listed] = may_be_frequent(sketch, hashes[listed], bits)
    fine[0] = False
    keep = fine[used]
    place = np.zeros(len(hashes), np.int64)
    place[numbers[:own][::-1]] = np.arange(own - 1, -1, -1)
    yield 1, place[used[keep]], times[keep]
    alive, rank = fine[numbers], numbers.astype(np.int64)
    for n, hashed, starts in runs_of(numbers, len(numbers), words, longest):
        at = np.flatnonzero(alive[:-1] & alive[1:] & starts)
        at = at[may_be_frequent(sketch, hashed[at], bits)]
        # the number of the run without its last word, and that word: exact, whatever the hashes
        _, first, inverse = np.unique(rank[at] * len(hashes) + numbers[at + n - 1], return_index=True, return_inverse=True)
        counts = np.bincount(inverse[at < own], minlength=len(first))
        yield n, at[first][counts > 0], counts[counts > 0]
        alive, rank = np.zeros(len(starts), bool), np.full(len(starts), -1)
        alive[at], rank[at] = True, inverse


def _exact(bits: int, longest: int, shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "words", "phrase", "f"]
        for numbers, own, words in streams(batches, longest):
            spelled, langs, of_lang = pa.array(words.words, pa.binary()), pa.array(list(words.by_lang), pa.string()), np.array(words.of_lang)
            total = np.bincount(of_lang[numbers[:own][numbers[:own] != 0]], minlength=len(langs))
            yield pa.RecordBatch.from_arrays([langs, pa.array(np.zeros(len(langs), np.int32)), pa.array([""] * len(langs), pa.string()), pa.array(total.astype(np.int64))], names)
            for n, places, counts in survivors(numbers, own, words, longest, shared.value, bits):
                for a in range(0, len(places), 50_000):
                    here = places[a : a + 50_000]
                    each = [spelled.take(pa.array(numbers[here + i])) for i in range(n)]
                    phrase = pc.binary_join_element_wise(*each, pa.scalar(b" ", pa.binary())) if n > 1 else each[0]
                    lang = langs.take(pa.array(of_lang[numbers[here]]))
                    yield pa.RecordBatch.from_arrays([lang, pa.array(np.full(len(here), n, np.int32)), phrase.cast(pa.string()), pa.array(counts[a : a + 50_000].astype(np.int64))], names)

    return run


def frequencies(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int | None = None) -> DataFrame:
    """(lang, words, phrase, f) of all runs of 1 to `longest` words with f >= `least`; with words = 0 the number of all
    words of a language.  `bits`: cells of the sketch as a power of two, 3 to 50, by default by the size of the texts."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if bits is None:
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = width_for(size / 6 * longest)
    shared = frequent_cells(texts, bits, longest, least)
    found = texts.mapInArrow(_exact(bits, longest, shared), "lang string, words int, phrase string, f long")
    return found.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("words") == 0))


# ---- scores


def scored(freq: DataFrame) -> DataFrame:
    """(lang, words, phrase, a, l, r, score): phrases of two words and more at their lowest-scoring cut, ties at the
    first.  Products are decimals of 38 digits."""
    cut = freq.where("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    known = freq.where("words > 0")
    left, right = (known.select("lang", F.col("phrase").alias(x), F.col("f").alias(y)) for x, y in (("first", "l"), ("rest", "r")))
    both = cut.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    score = F.expr("cast(cast(a as decimal(20,0)) * cast(2000000 as decimal(10,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)")
    lowest = both.withColumn("score", score).groupBy("lang", "words", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "words", "phrase", "a", "cut.l", "cut.r", "cut.score")


def subsumed(freq: DataFrame, share: int) -> DataFrame:
    """(lang, phrase, most): phrases of two words and more that stand in longer ones, with the highest frequency of those."""
    inside = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), s -> array_join(slice(w, s, m), ' '))))")
    longer = freq.where("words > 2").select("lang", "words", "f", F.split("phrase", " ").alias("w"))
    return longer.select("lang", "f", F.explode(inside).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def best(phrases: DataFrame, top: int) -> DataFrame:
    """The first `top` of each lang with their rank: first of each of a language's buckets, then of what these leave,
    so that no task sorts a language."""
    order = "ORDER BY score DESC, a DESC, phrase"
    some = phrases.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS))).withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang, bucket {order})"))
    some = some.where(F.col("rank") <= top).drop("bucket", "rank")
    return some.withColumn("rank", F.expr(f"cast(row_number() OVER (PARTITION BY lang {order}) as long)")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, share: int = SHARE, top: int = TOP, bits: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of 2 to `longest` words of each language of `docs`
    (lang, text) that occur `least` times or more.

    a, l and r are the frequencies of the phrase and of the parts of its lowest-scoring cut, n that of all words.  A
    phrase goes if a longer one that holds it has `share` per cent of its frequency or more.  A null lang is `und`, a null
    text is empty; repeated rows count each, whatever their ids; ties are broken by frequency and by the bytes of the
    phrase.  Other columns are ignored; an empty table, or one without frequent phrases, gives an empty result."""
    freq = materialize(frequencies(docs, least, longest, bits), "phrases")
    rows = scored(freq).join(subsumed(freq, share), ["lang", "phrase"], "left")
    inside = F.coalesce("most", F.lit(0)).cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * share
    kept = best(rows.where(~inside), top)
    totals = freq.where("words = 0").select("lang", F.col("f").alias("n"))
    return kept.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
runs AS (SELECT lang, m::INT AS words, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM worded, range(1, 5) r(m) WHERE len(w) >= m),
freq AS (SELECT lang, words, phrase, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= 30),
each AS (SELECT lang, words, phrase, f, string_split(phrase, ' ') AS w FROM freq WHERE words > 1),
split AS (SELECT lang, words, phrase, f AS a, k, array_to_string(w[:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest FROM each, range(1, 4) c(k) WHERE k < words),
cuts AS (SELECT s.lang, s.words, s.phrase, a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f::HUGEINT + y.f))::BIGINT AS score FROM split s
  JOIN freq x ON x.lang = s.lang AND x.phrase = s.head JOIN freq y ON y.lang = s.lang AND y.phrase = s.rest),
lowest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM cuts) WHERE place = 1),
inner_runs AS (SELECT lang, f, unnest(list_transform(range(1, words - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM each, range(2, 4) r(m) WHERE m < words),
longer AS (SELECT lang, phrase, max(f) AS most FROM inner_runs GROUP BY ALL),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM lowest LEFT JOIN longer USING (lang, phrase)
  WHERE 100::HUGEINT * coalesce(most, 0) < 80::HUGEINT * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
