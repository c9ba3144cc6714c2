"""What substring dedup over words and over bytes share: from texts to the windows that also occur elsewhere.

1.  A count-min sketch counts the anchors of all windows (`windows.anchors`); only windows with an anchor that may
    occur twice go on.
2.  Neighbouring windows with one anchor make a run.  Runs with equal content form a class, and all windows of a run
    repeat if the class occurs under a smaller id.  Of each class one id is left to look at.
3.  Where several classes share an anchor, their windows are compared one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KeyFilter, holds, materialize, slices
from .sketch import may_repeat, sketch_repeated, width_for
from .windows import anchor_places, rolling, runs, several_places, sliding_min


@dataclass
class Part:
    """Some whole texts as one array of symbols."""

    symbols: np.ndarray  # what is hashed for anchors
    content: bytes  # the same symbols as bytes, for exact keys
    width: int  # bytes of content a symbol
    lengths: np.ndarray  # symbols of each text


@dataclass(frozen=True)
class Kind:
    """A way to cut texts to symbols, with the length of windows and of the grams that anchor them.

    inside: windows that repeat inside one text count too.  Such windows may lie in one run, if its anchor stands in
    it twice; anchors are then counted by their places, and runs with several places of their anchor are marked."""

    window: int
    gram: int
    read: Callable[[list[bytes]], Part]
    inside: bool
    longest: int = 256

    def windows(self, part: Part) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor of each window start, run starts, run lengths, text of each run, whether it has several places of
        its anchor, hashes to count)."""
        grams = rolling(part.symbols, self.gram)
        anchor = sliding_min(grams, self.window - self.gram + 1)
        ends = np.cumsum(part.lengths)
        valid = np.ones(len(anchor), bool)
        for end in ends[:-1]:  # windows must not cross into the next text
            valid[max(0, end - self.window + 1) : end] = False
        starts, lengths = runs(anchor, valid, self.longest)
        texts = np.searchsorted(ends, starts, side="right")
        if not self.inside or not len(anchor):
            return anchor, starts, lengths, texts, np.zeros(len(starts), bool), anchor[starts]
        places = anchor_places(grams, anchor)
        return anchor, starts, lengths, texts, several_places(grams, places, anchor, starts, lengths), grams[places]


def _parts(batch: pa.RecordBatch, kind: Kind, budget: int = 400_000) -> Iterator[tuple[pa.RecordBatch, Part]]:
    for rows in slices(batch, "text", budget):
        yield rows, kind.read(rows.column("text").cast(pa.binary()).to_pylist())




class Repeats:
    """The search over one table of (id, th, text)."""

    def __init__(self, texts: DataFrame, kind: Kind, items: float):
        self.texts, self.kind, self.bits = texts, kind, width_for(items)

        def anchors_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
            for _, part in _parts(batch, kind):
                yield kind.windows(part)[-1]

        self.sketch = sketch_repeated(texts.select("text"), anchors_of, self.bits)
        self.rows = materialize(self._runs(), "runs")
        found = self.rows.groupBy("v", "k1", "k2").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.max("several").alias("several"))
        self.classes = materialize(found, "classes")

    def _runs(self) -> DataFrame:
        """(id, th, v, k1, k2, at, n, several, again) for each run that may repeat; several: its anchor stands in it more
        than once; again: it is not the text's first of its class."""
        kind, bits, sketch = self.kind, self.bits, self.sketch

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows, part in _parts(batch, kind):
                    found = may_runs(kind, part, sketch.value, bits)
                    text, again = found["text"], np.zeros(len(found["text"]), bool)
                    order = np.lexsort((found["at"], found["k2"], found["k1"], text))
                    same = (text[order][1:] == text[order][:-1]) & (found["k1"][order][1:] == found["k1"][order][:-1]) & (found["k2"][order][1:] == found["k2"][order][:-1])
                    again[order[1:][same]] = True
                    take = pa.array(text)
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("id").take(take), rows.column("th").take(take), *(pa.array(found[c]) for c in ("v", "k1", "k2", "at", "n", "several")), pa.array(again)],
                        ["id", "th", "v", "k1", "k2", "at", "n", "several", "again"],
                    )

        return self.texts.mapInArrow(run, "id long, th long, v long, k1 long, k2 long, at int, n int, several boolean, again boolean")

    def whole_runs(self, inside: bool) -> DataFrame:
        """(id, th, at, n) of the runs whose class occurs under a smaller id; inside: or earlier in the same text."""
        first = self.classes.where("first_id < last_id").select("v", "k1", "k2", "first_id")
        later = self.rows.join(first, ["v", "k1", "k2"]).where("id > first_id").select("id", "th", "at", "n")
        return later.unionByName(self.rows.where("again").select("id", "th", "at", "n")) if inside else later

    def mixed_anchors(self) -> DataFrame:
        """(v, n_classes) of the anchors whose windows must be compared one by one: several classes share the anchor, or
        it stands more than once in a run."""
        counted = self.classes.groupBy("v").agg(F.count(F.lit(1)).alias("n_classes"), F.max("several").alias("several"))
        return counted.where("n_classes > 1 or several").select("v", "n_classes")

    def left_over(self, anchors_wanted: DataFrame) -> KeyFilter:
        """A filter for the runs still to be looked at: of each class with such an anchor those under its first id."""
        wanted = self.classes.join(anchors_wanted.select("v"), "v", "left_semi").select("k1", "first_id")
        wanted = materialize(wanted, "wanted")
        return KeyFilter(wanted, _run_key(F.col("k1"), F.col("first_id")))

    def each_left_over(self, wanted: KeyFilter, columns: Callable[[pa.RecordBatch, Part, dict], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """What `columns` makes of the runs that pass the filter, in another scan of the texts."""
        kind, bits, sketch, shared, size = self.kind, self.bits, self.sketch, wanted.shared, wanted.bits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows, part in _parts(batch, kind):
                    found = may_runs(kind, part, sketch.value, bits)
                    ids = np.asarray(rows.column("id"))[found["text"]]
                    keep = holds(shared.value, size, found["k1"] ^ ids)
                    found = {k: x[keep] for k, x in found.items()}
                    if keep.any():
                        yield from columns(rows, part, found)

        return self.texts.mapInArrow(run, schema)


def _run_key(k1: Column, id_: Column) -> Column:
    return k1.bitwiseXOR(id_)


def may_runs(kind: Kind, part: Part, sketch: np.ndarray, bits: int) -> dict[str, np.ndarray]:
    """The runs of a part that may repeat: text (its number in the part), at (in its text), start (in the part), n,
    v and the 128-bit key k1, k2 of all symbols that the run's windows cover."""
    anchor, starts, lengths, texts, several, _ = kind.windows(part)
    v = anchor[starts]
    keep = may_repeat(sketch, v, bits)
    starts, lengths, texts, several, v = starts[keep], lengths[keep], texts[keep], several[keep], v[keep]
    w, content, tail = part.width, part.content, kind.window - 1
    digest = xxhash.xxh3_128_digest
    keys = b"".join(digest(content[s * w : (s + n + tail) * w]) for s, n in zip(starts.tolist(), lengths.tolist(), strict=True))
    halves = np.frombuffer(keys, np.int64).reshape(-1, 2)
    begins = np.cumsum(part.lengths) - part.lengths
    return {
        "text": texts.astype(np.int32),
        "at": (starts - begins[texts]).astype(np.int32),
        "start": starts,
        "n": lengths.astype(np.int32),
        "several": several,
        "v": v.view(np.int64),
        "k1": halves[:, 0].copy(),
        "k2": halves[:, 1].copy(),
    }


def covered_mask(length: int, spans: list[dict], window: int) -> np.ndarray:
    """Symbols of a text that lie in a window starting at one of the spans' starts."""
    edge = np.zeros(length + 1, np.int64)
    for s in spans:
        edge[s["at"]] += 1
        edge[min(length, s["at"] + s["n"] + window - 1)] -= 1
    return np.cumsum(edge[:-1]) > 0


def with_spans(texts: DataFrame, docs_id: Column, spans: DataFrame) -> DataFrame:
    """(doc_id, text, spans): the spans of each text, a list that its own length bounds.

    Only texts that a filter cannot tell to be without spans are shuffled to be joined."""
    listed = spans.groupBy("id", "th").agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    may = KeyFilter(spans, F.xxhash64("id", "th")).may_hold()
    joined = texts.where(may).join(listed, ["id", "th"], "left").select(docs_id.alias("doc_id"), "text", "spans")
    return joined.unionByName(texts.where(~may).select(docs_id.alias("doc_id"), "text", F.lit(None).cast("array<struct<at:int,n:int>>").alias("spans")))
