"""Token counts by batch encoding: Arrow functions that return lengths only.

A text may be cut before any ASCII white space without a change to its tokens: such a character neither composes with
its neighbours when a text is normalised, nor is it part of any token of a vocabulary that drops white space.  So texts
are cut there, every piece is encoded once as long as a worker remembers it, and pieces that it does not know go to the
library in batches of about equal bytes.  Nothing but numbers comes back.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import vocabulary_path
from .common import slices, table, utf8
from .filter_audit import blocks

#: Bytes of unknown pieces that the library gets at once, and of text that is cut at once; what is longer goes alone.
BATCH_BYTES, GROUP_BYTES = 100_000, 1_000_000
#: Pieces that a worker remembers, and the longest piece that it does.
REMEMBERED, LONGEST = 400_000, 64


def balanced(items: Iterable, budget: int, size: Callable = len) -> Iterator[list]:
    """Batches of items of about `budget` bytes each, one item at least."""
    batch, held = [], 0
    for item in items:
        if batch and held + size(item) > budget:
            yield batch
            batch, held = [], 0
        batch.append(item)
        held += size(item)
    if batch:
        yield batch


class Counter:
    """Token counts of texts by one vocabulary file whose tokens hold no white space."""

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        spec = json.loads(source)
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        drops_space = any(x["type"] == "Split" and x["behavior"] == "Removed" and x["invert"] and "[^\\s" in x["pattern"].get("Regex", "") for x in steps)
        if not drops_space or any(x["single_word"] or len(x["content"].split()) != 1 for x in spec["added_tokens"]):
            raise ValueError("a vocabulary of another kind: its tokens may hold white space")
        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, int] = {}

    def learn(self, pieces: Iterable[bytes]) -> None:
        """Ask the library for the counts of the pieces."""
        for batch in balanced(pieces, BATCH_BYTES):
            encoded = self.tokenizer.encode_batch_fast([x.decode() for x in batch], add_special_tokens=False)
            self.known.update(zip(batch, map(len, encoded), strict=True))

    def count(self, texts: list[bytes]) -> list[int]:
        """The number of tokens of each text."""
        counts, known = [0] * len(texts), self.known
        cut = ((row, block) for row, text in enumerate(texts) for block in blocks(text))
        for group in balanced(cut, GROUP_BYTES, lambda x: len(x[1])):
            split = [(row, block.split()) for row, block in group]  # at the six ASCII white-space characters
            if len(known) > REMEMBERED:
                known.clear()
            fresh = set().union(*(pieces for _, pieces in split)).difference(known)
            self.learn(fresh)
            for row, pieces in split:
                counts[row] += sum(map(known.__getitem__, pieces))
            for long in (x for x in fresh if len(x) > LONGEST):
                del known[long]
        return counts


@lru_cache(2)
def _worker(source: str) -> Counter:
    return Counter(source)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of `docs` (doc_id, text); over_limit: more than `limit`.

    Special tokens that stand in a text count as one token, as the library has it; none are added.  A null text counts
    as empty and has no tokens; a null doc_id stays null; repeated rows are counted each.  Other columns are ignored; an
    empty table gives an empty one.  `path` names a vocabulary file on the driver; its content (a few MB, fixed) goes to
    the executors."""
    with open(path or vocabulary_path(), encoding="utf-8") as f:  # on the driver, once
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _worker(shared.value)
        for batch in batches:
            for part in slices(batch, "text", 2 * GROUP_BYTES):
                texts = utf8(part, "text")
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(list(map(len, texts)), pa.int64()), pa.array(counter.count(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return given.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
