"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures.

A document's set of word shingles is signed with 64 symbols of 16 bits, each from the smallest value of one hash
function over the set.  Documents whose signatures differ in at most `DISTANCE` symbols are candidates.  All of these
are found: the signature is split into 13 chunks, and by the pigeonhole principle one chunk of such a pair has at
most one differing symbol, so that every chunk is indexed once with each of its symbols left out.

Links are confirmed on the full sets.  A pair at similarity 0.8 differs in 12.8 symbols on average with a standard
deviation of 3.2, so that about one in ten thousand such pairs lies beyond the distance; more similar ones less.

No bucket is expanded into all its pairs.  First each set, then each component, is compared with the one hub, the
smallest member of a bucket, with which it shares most buckets; that links groups of copies.  What is left are members of buckets that hold several components: texts that share a common
passage, and the fringe of large groups.  No index over signatures alone can tell those apart without comparing each
with each, for they lie just beyond the threshold.  Of them two members of different components are candidates only if
their full sets can still reach the similarity: shingles are put in order of their true frequency among these texts,
the rarest first, and two sets that are similar enough share a shingle that stands early in both (`candidates`).
A shingle that stands early in many sets, as in a group of near copies, lists no pairs: its sets are compared in blocks
inside tasks, which send back a forest of the links found (`crowded_links`).
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, KeyFilter, components, discard, keyed_texts, materialize, row_id, slices, table, utf8
from .sketch import may_repeat, sketch_repeated, width_for
from .windows import gram_hashes, mix

SYMBOLS, DISTANCE, CHUNKS = 64, 25, 13
BOUNDS = [round(i * SYMBOLS / CHUNKS) for i in range(CHUNKS + 1)]
SIMILARITY = 80  # per cent
#: Sizes of sets fall in classes, each so much wider than the one before from FINE on, where every size has its own.
FINE, WIDER = 50, 1.02
#: Rows of a shingle up to which its pairs are listed.  Sets of shingles with more are compared in blocks of about so
#: many sets and shingles.
FEW, BLOCK, BLOCK_SHINGLES = 64, 512, 400_000
_FACTORS = np.random.default_rng(9).integers(0, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Hashes(dict):
    """word -> 64-bit hash, filled when asked."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 150_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted hashes of the different runs of `words` words; a shorter text is one shingle, none without words."""
    found = text.lower().split()  # A-Z only; splits at the six ASCII white-space characters
    hashes = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    if not len(hashes):
        return hashes
    if len(hashes) < words:
        return mix(gram_hashes(hashes, len(hashes)) ^ np.uint64(len(hashes)))
    return np.unique(gram_hashes(hashes, words))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of symbols for each set; sets must not be empty."""
    sizes = np.array([len(s) for s in sets])
    starts, values = np.cumsum(sizes) - sizes, np.concatenate(sets)
    out = np.empty((len(sets), SYMBOLS), np.uint16)
    for i, factor in enumerate(_FACTORS):
        out[:, i] = mix(np.minimum.reduceat(values * factor, starts)).astype(np.uint16)
    return out


def bucket_keys(signature: np.ndarray) -> np.ndarray:
    """Keys of each signature: every chunk with each of its symbols left out."""
    columns = []
    for c in range(CHUNKS):
        here = range(BOUNDS[c], BOUNDS[c + 1])
        for gone in here:
            key = np.full(len(signature), c * SYMBOLS + gone, np.uint64)
            for i in here:
                if i != gone:
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, i])
            columns.append(key)
    return np.stack(columns, axis=1)


def _sign(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                sets = [shingle_set(t, words) for t in utf8(part, "text")]
                some = [i for i, s in enumerate(sets) if len(s)]
                signed: list[bytes | None] = [None] * len(sets)
                if some:
                    for i, row in zip(some, signatures([sets[i] for i in some]), strict=True):
                        signed[i] = row.tobytes()
                halves = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
                columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(signed, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("th"), *columns], ["id", "th", "n", "s1", "s2", "sig"])

    return run


def _symbols(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SYMBOLS)


def _index(sets: DataFrame) -> DataFrame:
    """(key, c) of the classes of equal sets, without keys that the sketch knows to stand alone."""
    bits = width_for(sets.count() * SYMBOLS)
    sketch = sketch_repeated(sets.select("sig"), lambda batch: iter([bucket_keys(_symbols(batch.column("sig"))).ravel()] if batch.num_rows else []), bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                keys = bucket_keys(_symbols(part.column("sig")))
                rows, columns = np.nonzero(may_repeat(sketch.value, keys.ravel(), bits).reshape(keys.shape))
                take = pa.array(rows.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(keys[rows, columns].view(np.int64)), part.column("c").take(take)], ["key", "c"])

    return sets.select("c", "sig").mapInArrow(run, "key long, c long")


def _shingles(words: int):
    """(c, n, token) for each shingle of the texts (c, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                sets = [shingle_set(t, words) for t in utf8(part, "text")]
                sizes = np.array([len(x) for x in sets])
                rows = pa.array(np.repeat(np.arange(len(sets)), sizes).astype(np.int32))
                tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("c").take(rows), pa.array(np.repeat(sizes, sizes)), pa.array(tokens.view(np.int64))], ["c", "n", "token"])

    return run


def _size_class(n: Column) -> Column:
    return F.when(n < FINE, n).otherwise(FINE + F.floor(F.log(n / FINE) / F.log(F.lit(WIDER)))).cast("int")


def _least_of(size_class: Column) -> Column:
    """No set of the class is smaller (one less, as logarithms are rounded)."""
    return F.when(size_class < FINE, size_class).otherwise(F.floor(FINE * F.pow(F.lit(WIDER), size_class - FINE)) - 1).cast("long")


def _least_common(n: Column, m: Column, similarity: int) -> Column:
    """Shingles that sets of n and m have in common at least if they are similar enough."""
    return F.expr("1") * F.ceil(similarity * (n + m) / (100 + similarity) - 1e-9)


def mixed_prefixes(tokens: DataFrame, members: DataFrame, similarity: int) -> DataFrame:
    """(size, token, main, crowd, c, comp, n, asks): early shingles of the sets (c, n, token) of `members` (c, comp) that
    stand early in sets of several components.

    Shingles are ordered by how many of these sets have them, then by hash.  Of sets of n <= m shingles with an overlap
    of o or more, the first common shingle stands among the first n - o + 1 of the one and m - o + 1 of the other.  A set
    is indexed for partners of its own size and more, and asks for each class of smaller sizes with as many shingles as
    that class needs.  Shingles of one set only are counted but not sent."""
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    listed = tokens.join(counts, "token").groupBy("c", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("l"))  # bounded by the text
    listed = listed.join(members, "c").select("c", "comp", "n", F.transform("l", lambda x: x["token"]).alias("l"), (F.col("n") - F.size("l")).alias("once"))
    n = F.col("n")

    def sent(least_common: Column) -> Column:
        return F.slice("l", 1, F.greatest(n - least_common + 1 - F.col("once"), F.lit(0)).cast("int"))

    indexed = listed.select("c", "comp", "n", _size_class(n).alias("size"), F.explode(sent(_least_common(n, n, similarity))).alias("token"))
    smallest = F.ceil(n * similarity / 100 - 1e-9)
    asked = listed.withColumn("size", F.explode(F.sequence(_size_class(smallest), _size_class(n))))
    other = F.greatest(_least_of(F.col("size")), smallest)
    asked = asked.select("c", "comp", "n", "size", F.explode(sent(_least_common(n, other, similarity))).alias("token"))
    both = materialize(indexed.withColumn("asks", F.lit(False)).unionByName(asked.withColumn("asks", F.lit(True))), "prefixes")
    # of a key of several components, `main` is the one with most rows: its own rows are not put against each other
    per = both.groupBy("size", "token", "comp").agg(F.count(F.lit(1)).alias("rows"))
    main = F.max_by("comp", F.struct("rows", F.bitwise_not("comp")))  # of equals the smallest, so that like keys have the same
    keys = per.groupBy("size", "token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), main.alias("main"), F.sum("rows").alias("crowd"))
    return materialize(both.join(keys.where("low < high").select("size", "token", "main", "crowd"), ["size", "token"]), "mixed-prefixes")


def candidates(tokens: DataFrame, members: DataFrame, similarity: int, mixed: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(a, b) of the sets (c, n, token) of `members` (c, comp) that belong to different components and may be similar, by
    their `mixed_prefixes`; with `most` only by shingles of so many rows."""
    mixed = mixed_prefixes(tokens, members, similarity) if mixed is None else mixed
    mixed = mixed if most is None else mixed.where(F.col("crowd") <= most)
    named = lambda rows, x: rows.select("size", "token", "main", *[F.col(y).alias(f"{y}_{x}") for y in ("c", "comp", "n")])
    index, probe = named(mixed.where("not asks"), "a"), named(mixed.where("asks"), "b").drop("main")
    fits = (F.col("comp_a") != F.col("comp_b")) & (F.col("n_a") <= F.col("n_b")) & (F.col("n_a") * 100 >= F.col("n_b") * similarity)
    found = None
    for here, there in ((index.where("comp_a != main"), probe), (index.where("comp_a = main"), named(mixed.where("asks and comp != main"), "b").drop("main"))):
        pairs = here.join(there, ["size", "token"]).where(fits).select(F.least("c_a", "c_b").alias("a"), F.greatest("c_a", "c_b").alias("b"))
        found = pairs if found is None else found.unionByName(pairs)
    return found.distinct()


def _link_blocks(similarity: int):
    """Rows come sorted by (main, b1, b2): the sets of one block, or of two."""

    def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
        """Shingles that each of the one and each of the others have in common."""
        both = np.intersect1d(np.concatenate(left), np.concatenate(right))
        places = []
        for sets in (left, right):
            values, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            at = np.searchsorted(both, values)
            known = np.flatnonzero(both[np.minimum(at, len(both) - 1)] == values) if len(both) else at[:0]
            known = known[np.argsort(at[known], kind="stable")]
            places.append((at[known], owners[known]))
        found = np.zeros((len(left), len(right)), np.float32)
        for start in range(0, len(both), 2000):
            tables = []
            for (column, owner), sets in zip(places, (left, right), strict=True):
                own = slice(*np.searchsorted(column, [start, start + 2000]))
                holds = np.zeros((len(sets), min(2000, len(both) - start)), np.float32)
                holds[owner[own], column[own] - start] = 1
                tables.append(holds)
            found += tables[0] @ tables[1].T
        return found

    def compared(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Of one group: each set that links with one of another component, and the smallest within its reach here."""
        b1, b2, block, c, comp = (np.asarray(rows.column(x)) for x in ("b1", "b2", "block", "c", "comp"))
        one, two = np.flatnonzero(block == b1), np.flatnonzero(block == b2)
        if not len(one) or not len(two):
            return
        values, offsets = np.asarray(rows.column("set").values), np.asarray(rows.column("set").offsets)
        sets = [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        n, both = np.diff(offsets), common([sets[i] for i in one], [sets[i] for i in two])
        linked = (both > 0) & (100 * both >= similarity * (n[one][:, None] + n[two] - both)) & (comp[one][:, None] != comp[two])
        one, two, linked = one[linked.any(axis=1)], two[linked.any(axis=0)], linked[linked.any(axis=1)][:, linked.any(axis=0)]
        least = c.copy()
        while len(one):
            before = least.copy()
            for here, there, links in ((one, two, linked), (two, one, linked.T)):
                least[here] = np.minimum(least[here], np.where(links, least[there], np.iinfo(np.int64).max).min(axis=1))
            if (least == before).all():
                break
        some = np.flatnonzero(least != c)
        yield pa.RecordBatch.from_arrays([pa.array(least[some]), pa.array(c[some])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []  # of the last group so far: two blocks at most
        name = None
        for batch in batches:
            marks = np.stack([np.asarray(batch.column(x)) for x in ("main", "b1", "b2")], axis=1)
            starts = np.flatnonzero(np.append(True, (marks[1:] != marks[:-1]).any(axis=1))) if len(marks) else []
            for a, b in zip(starts, [*starts[1:], len(marks)], strict=True):
                if waiting and tuple(marks[a]) != name:
                    yield from compared(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0])
                    waiting = []
                waiting.append(batch.slice(a, b - a))
                name = tuple(marks[a])
        if waiting:
            yield from compared(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0])

    return run


def crowded_links(mixed: DataFrame, tokens: DataFrame, similarity: int, most: int) -> DataFrame:
    """(a, b): a forest of the links between sets of different components that share a shingle of more than `most` rows.

    Such shingles are taken together by their `main` component, so that near copies come up once and not for each shingle
    that they share.  The sets of other components are compared with each other and with those of the main one, by blocks;
    a task holds two blocks."""
    rows = materialize(mixed.where(F.col("crowd") > most).select("main", "c", "comp", "n").distinct(), "crowded")
    is_main, n_blocks = F.col("comp") == F.col("main"), F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    per = rows.groupBy("main", is_main.alias("is_main")).agg(n_blocks.cast("long").alias("blocks"))
    of = lambda x: F.coalesce(F.sum(F.when(x, F.col("blocks"))), F.lit(0))
    per = per.groupBy("main").agg(of(~F.col("is_main")).alias("others"), of(F.col("is_main")).alias("mains"))
    place = F.xxhash64("c", F.lit("block"))
    dealt = rows.join(per, "main").withColumn("block", F.when(is_main, F.col("others") + F.pmod(place, "mains")).otherwise(F.pmod(place, "others")))
    last = F.when(is_main, F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    dealt = dealt.select("main", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "block", "c", "comp")
    sets = tokens.join(rows.select("c").distinct(), "c").groupBy("c").agg(F.collect_list("token").alias("set"))  # bounded by the text
    dealt = dealt.join(sets, "c").repartition("main", "b1", "b2").sortWithinPartitions("main", "b1", "b2")
    return dealt.mapInArrow(_link_blocks(similarity), "a long, b long")


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures are within the distance."""
    for batch in batches:
        if batch.num_rows:
            keep = (_symbols(batch.column("sig_a")) != _symbols(batch.column("sig_b"))).sum(axis=1) <= DISTANCE
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"])


def _confirm(words: int, similarity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[bytes, np.ndarray] = OrderedDict()

        def set_of(text: bytes) -> np.ndarray:
            if (found := known.get(text)) is None:
                found = known[text] = shingle_set(text, words)
                if len(known) > 200:
                    known.popitem(last=False)
            return found

        for batch in batches:
            keep = []
            for left, right in zip(utf8(batch, "text_a"), utf8(batch, "text_b"), strict=True):
                one, two = set_of(left), set_of(right)
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(both > 0 and 100 * both >= similarity * (len(one) + len(two) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep, pa.bool_())), batch.column("b").filter(pa.array(keep, pa.bool_()))], ["a", "b"])

    return run


def _close_in_size(a: str, b: str, similarity: int):
    return (F.col(a) * 100 >= F.col(b) * similarity) & (F.col(b) * 100 >= F.col(a) * similarity)


class Join:
    """The join over one table; `reached` gives the component of each class that links with another."""

    def __init__(self, texts: DataFrame, words: int, similarity: int):
        self.words, self.similarity = words, similarity
        self.signed = materialize(texts.mapInArrow(_sign(words), "id long, th long, n long, s1 long, s2 long, sig binary"), "signatures")
        classes = self.signed.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("id").alias("c"))
        self.classes = materialize(classes, "sets")
        keyed = self.signed.where("n > 0").join(self.classes.select("s1", "s2", "c"), ["s1", "s2"]).where("id = c")
        self.sets = materialize(keyed.groupBy("s1", "s2", "c", "n").agg(F.min("th").alias("th"), F.first("sig").alias("sig")), "signed-sets")
        self.keys = materialize(_index(self.sets), "keys")
        hubs = self.keys.groupBy("key").agg(F.min("c").alias("hub"), F.max("c").alias("last")).where("hub < last").select("key", "hub")
        joined = self.keys.join(hubs, "key")
        # hubs of each member, with the number of keys it shares with them; the one with most is marked
        own = joined.where("c != hub").groupBy(F.col("c").alias("b"), F.col("hub").alias("a")).agg(F.count(F.lit(1)).alias("shared"))
        best = own.groupBy("b").agg(F.max_by("a", F.struct("shared", F.bitwise_not("a"))).alias("best"))
        self.hubs = materialize(own.join(best, "b").select("a", "b", "shared", (F.col("a") == F.col("best")).alias("best")), "hubs")
        several = materialize(joined.select("c").distinct(), "several")
        picked = texts.withColumn("c", F.col("id")).where(KeyFilter(several, F.xxhash64("c")).may_hold())
        self.texts = materialize(picked.join(self.sets.select("c", "th"), ["c", "th"]).select("c", "text").distinct(), "texts")
        first = self._near_pairs(self.hubs.where("best").select("a", "b"))
        self.reached = materialize(components(self._confirmed(first)), "reached")
        self._extend(self._confirmed(self._near_pairs(self._next_hubs())))
        self._extend(self._rest())
        discard(self.sets, self.keys, self.hubs, several, self.texts)

    def _next_hubs(self) -> DataFrame:
        """(a, b): of the pairs of hub and member in different components that of each component with most keys."""
        comp_a, comp_b = (self.reached.select(F.col("id").alias(x), F.col("component_id").alias(f"comp_{x}")) for x in "ab")
        placed = self.hubs.where("not best").join(comp_a, "a", "left").join(comp_b, "b", "left").withColumns({f"comp_{x}": F.coalesce(f"comp_{x}", x) for x in "ab"})
        ends = placed.where("comp_a != comp_b").select("a", "b", "shared", F.explode(F.array("comp_a", "comp_b")).alias("comp"))
        found = ends.groupBy("comp").agg(F.max(F.struct("shared", F.bitwise_not("a").alias("a"), F.bitwise_not("b").alias("b"))).alias("most"))
        return found.select(F.bitwise_not("most.a").alias("a"), F.bitwise_not("most.b").alias("b")).distinct()

    def _extend(self, links: DataFrame) -> None:
        links = materialize(links, "links")
        if links.take(1):
            stars = self.reached.select(F.col("id").alias("a"), F.col("component_id").alias("b"))
            self.reached = materialize(components(stars.unionByName(links)), "reached")
        discard(links)

    def _near_pairs(self, pairs: DataFrame) -> DataFrame:
        one = self.sets.select(F.col("c").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
        two = self.sets.select(F.col("c").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
        joined = pairs.join(one, "a").join(two, "b").where(_close_in_size("n_a", "n_b", self.similarity))
        return joined.select("a", "b", "sig_a", "sig_b").mapInArrow(_near, "a long, b long")

    def _confirmed(self, pairs: DataFrame) -> DataFrame:
        one, two = (self.texts.select(F.col("c").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
        joined = pairs.join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b")
        return joined.mapInArrow(_confirm(self.words, self.similarity), "a long, b long")

    def _rest(self) -> DataFrame:
        """Links between different components that buckets hold beside the pairs tried before."""
        rows = self.keys.join(self.reached.withColumnRenamed("id", "c"), "c", "left").select("key", "c", F.coalesce("component_id", "c").alias("comp"))
        rows = materialize(rows, "members")
        mixed = rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
        members = materialize(rows.join(mixed, "key", "left_semi").select("c", "comp").distinct(), "mixed-members")
        texts = self.texts.join(members.select("c"), "c", "left_semi")
        tokens = materialize(texts.mapInArrow(_shingles(self.words), "c long, n long, token long"), "shingles")
        mixed = mixed_prefixes(tokens, members, self.similarity)
        pairs = candidates(tokens, members, self.similarity, mixed, FEW)
        links = self._confirmed(materialize(self._near_pairs(pairs), "more-pairs"))
        return links.unionByName(crowded_links(mixed, tokens, self.similarity, FEW))


def minhash_components(docs: DataFrame, words: int = 5, similarity: int = SIMILARITY) -> DataFrame:
    """(id, th, n_shingles, component): each row of `docs` by id and hash of its text."""
    join = Join(keyed_texts(docs), words, similarity)
    reached = join.reached.withColumnRenamed("id", "c")
    classes = join.classes.join(reached, "c", "left").select("s1", "s2", F.coalesce("component_id", "c").alias("component"))
    rows = join.signed.where("n > 0").join(classes, ["s1", "s2"]).select("id", "th", F.col("n").alias("n_shingles"), "component")
    alone = join.signed.where("n = 0").select("id", "th", F.col("n").alias("n_shingles"), F.col("id").alias("component"))
    return rows.unionByName(alone)


def minhash_dedup(docs: DataFrame, words: int = 5, similarity: int = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of `docs` (doc_id, text).

    Documents link if their sets of shingles of `words` words have a Jaccard similarity of `similarity` per cent or
    more; a component is what links reach, and its smallest doc_id is kept.  Null and empty texts and texts without
    words have no shingles and link with nothing.  A null doc_id counts as smaller than any other; rows that share a
    doc_id are one vertex of the graph.  Other columns are ignored."""
    show = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    found = minhash_components(docs, words, similarity)
    return found.select(show("id").alias("doc_id"), "n_shingles", show("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def keep_one_each(docs: DataFrame, words: int = 5, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of `docs`, with all their columns, whose doc_id is the smallest of their component.

    Rows that repeat both doc_id and text all stay or all go."""
    gone = minhash_components(docs, words, similarity).where("id != component").select("id", "th").distinct()
    text_hash = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    packed = docs.select(row_id().alias("id"), text_hash.alias("th"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return packed.join(gone, ["id", "th"], "left_anti").select("row.*")


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(table(spark, sf_dir, "documents"), words=4)
