"""BPE encoding by backtracking over longest token matches, and decoding through an offset table.

A word is encoded in time linear in its length.  An Aho-Corasick automaton gives the longest token that starts at
each symbol; the encoder takes it, checks the pair (previous token, token) for compatibility - whether merging the
two tokens' symbols in rank order would leave exactly these two - and on a conflict tries the next shorter prefix
token or steps back.  Tokens all of whose neighbours are compatible are exactly what merging by rank gives.

Symbols are the bytes of a word, the last one marked as a word's end, so that token ids are symbols first (0-255,
256-511 for word ends) and merge results after them, in rank order.
"""

from __future__ import annotations

import hashlib
import json
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer
from tokenizers.pre_tokenizers import Split

from .common import slices, table

SYMBOLS = 256
#: Encoded words kept by one worker.
CACHED_WORDS = 400_000
#: Unicode white space, as `\s` stands for it in the tokenizer's own pattern.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


class Encoder:
    """An encoder for one tokenizer file of the word-end kind."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        if spec["decoder"] is not None or model["end_of_word_suffix"] != "</w>" or model["unk_token"] or model["byte_fallback"]:
            raise ValueError("a tokenizer of another kind")
        names = sorted(model["vocab"], key=model["vocab"].get)
        if [model["vocab"][x] for x in names] != list(range(len(names))):
            raise ValueError("ids are not dense")
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.words = regex.compile(steps[0]["pattern"]["Regex"].replace("\\s", SPACE), regex.V0)
        own = Tokenizer.from_str(source)
        self.normalizer, self.splitter = own.normalizer, Split(Regex(steps[0]["pattern"]["Regex"]), "removed", invert=True)
        letters = byte_letters()
        shown = {letter: byte for byte, letter in letters.items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        # ids of the symbols as the file numbers them
        self.symbol_ids = [model["vocab"][letters[b]] for b in range(256)] + [model["vocab"][letters[b] + "</w>"] for b in range(256)]

        def as_symbols(name: str) -> str:
            """A token as a string over 512 characters: bytes, and bytes that end a word."""
            if name.endswith("</w>"):
                body = [shown[c] for c in name[:-4]]
                return "".join(map(chr, body[:-1])) + chr(SYMBOLS + body[-1])
            return "".join(chr(shown[c]) for c in name)

        self.tokens = [as_symbols(x) for x in names]
        self.ids = {x: i for i, x in enumerate(self.tokens)}
        #: (left id, right id) -> (rank, merged id), and the pair each merged token is made of
        self.merged: dict[tuple[int, int], int] = {}
        self.split = list(zip(range(len(names)), range(len(names)), strict=True))
        self.rank = [-1] * len(names)
        for rank, (left, right) in enumerate(merges):
            a, b = model["vocab"][left], model["vocab"][right]
            made = self.ids[self.tokens[a] + self.tokens[b]]
            if self.rank[made] >= 0:
                raise ValueError("two merges make one token")
            self.merged[a, b], self.split[made], self.rank[made] = made, (a, b), rank
        self.automaton = ahocorasick.Automaton()
        for i, x in enumerate(self.tokens):
            self.automaton.add_word(x, (i, len(x)))
        self.automaton.make_automaton()
        #: the longest token that is a proper prefix of each token, -1 for single symbols
        self.prefix = [next((p for n in range(len(x) - 1, 0, -1) if (p := self.ids.get(x[:n], -1)) >= 0), -1) for x in self.tokens]
        self.lengths = [len(x) for x in self.tokens]
        self.known: dict[tuple[int, int], bool] = {}
        # offset tables: what each id looks like, and its decimal digits, each followed by a space
        shown_names = names + [""] * (max(self.special.values(), default=0) + 1 - len(names))
        for name, i in self.special.items():
            shown_names[i] = name
        self.decode_table = OffsetTable([(x + " ").encode() for x in shown_names])
        self.digit_table = OffsetTable([b"%d " % i for i in range(len(shown_names))])

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank keeps the border between two neighbouring tokens.

        Both are unwound from their last merge backwards: a merge across the border that comes before the merges
        that made the tokens would have used up a piece of one of them."""
        key = left, right
        if (said := self.known.get(key)) is not None:
            return said
        a, b, limit, fine = left, right, len(self.rank), True
        while True:
            made = self.merged.get((a, b))
            if made is not None and self.rank[made] < limit:
                fine = False
                break
            ra, rb = self.rank[a], self.rank[b]
            if ra < 0 and rb < 0:
                break
            if ra > rb:
                # the later merge is undone first; what lies next to the border is its right half
                limit = ra
                a = self.split[a][1]
            else:
                # equal merges happen from left to right: the right one of two equal tokens is undone first, and a merge
                # across the border comes before an equal one inside the right token
                limit = rb + 1
                b = self.split[b][0]
        if len(self.known) > 2_000_000:
            self.known.clear()
        self.known[key] = fine
        return fine

    def encode_word(self, word: bytes) -> list[int]:
        """Token ids of one word."""
        if len(word) == 1:
            return [self.symbol_ids[SYMBOLS + word[0]]]
        text = "".join(map(chr, word[:-1])) + chr(SYMBOLS + word[-1])
        n = len(text)
        longest = [0] * n
        for end, (token, length) in self.automaton.iter(text):
            longest[end - length + 1] = token  # ends rise, so the last one written is the longest
        taken: list[int] = []
        dead = bytearray(n + 1)  # positions from which the rest is known not to work
        at, token = 0, longest[0]
        while True:
            stop = at + self.lengths[token]
            while token >= 0 and (dead[stop] or (taken and not self.compatible(taken[-1], token))):
                token = self.prefix[token]
                stop = at + self.lengths[token]  # of no use where the token is -1
            if token >= 0:
                taken.append(token)
                at = stop
                if at == n:
                    return taken
                token = longest[at]
            else:
                dead[at] = 1
                token = taken.pop()
                at -= self.lengths[token]
                token = self.prefix[token]

    def split_words(self, text: str) -> Iterator[list[str] | int]:
        """Lists of words, and the ids of special tokens that stand in the text."""
        at = 0
        if self.special_pattern and "<" in text:
            for m in self.special_pattern.finditer(text):
                yield self._plain(text[at : m.start()])
                yield self.special[m[0]]
                at = m.end()
        yield self._plain(text[at:] if at else text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            if not unsettled().isdisjoint(text):  # the tokenizer's own tables decide
                text = self.normalizer.normalize_str(text)
                return [word for word, _ in self.splitter.pre_tokenize_str(text)]
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final-sigma rule when lower-casing
        return self.words.findall(text.lower())


class OffsetTable:
    """Byte strings in one buffer with offsets; `gather` joins those of a list of ids."""

    def __init__(self, parts: list[str]):
        self.data = np.frombuffer(b"".join(parts), np.uint8)
        self.sizes = np.array([len(x) for x in parts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def gather(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        shift = self.starts[ids] - (ends - sizes)
        at = np.arange(int(ends[-1]) if len(ends) else 0)
        at += np.repeat(shift, sizes)
        return self.data[at].tobytes()


@lru_cache(1)
def unsettled() -> frozenset[str]:
    """Code points that Python's tables call unassigned and a later Unicode version assigns: Unicode versions, and so
    libraries, disagree about them."""
    assigned = regex.compile(r"\P{Cn}")
    return frozenset(c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Cn" and assigned.match(c))


@lru_cache(1)
def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies show each byte: itself if printable, else the next free letter
    from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Words(dict):
    """word -> its ids as bytes of int32; filled when asked."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        ids = np.array(self.encoder.encode_word(word.encode()), np.int32).tobytes()
        self[word] = ids
        return ids


@lru_cache(2)
def _worker(source: str) -> tuple[Encoder, _Words]:
    encoder = Encoder(source)
    return encoder, _Words(encoder)


def encode_text(encoder: Encoder, cache: _Words, text: str) -> np.ndarray:
    parts = [np.array([p], np.int32).tobytes() if isinstance(p, int) else b"".join(map(cache.__getitem__, p)) for p in encoder.split_words(text)]
    return np.frombuffer(b"".join(parts), np.int32)


def decode_ids(encoder: Encoder, ids: np.ndarray) -> bytes:
    """UTF-8 text of the ids: their names, one space apart."""
    return encoder.decode_table.gather(ids)[:-1]


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def bpe(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) for each row of `docs` (doc_id, text).

    A null text counts as empty; an empty text has no ids and decodes to an empty text.  A null doc_id stays null;
    repeated rows are encoded each.  Other columns are ignored.  `path` names a vocabulary file on the driver; its
    content (a few MB, fixed) goes to the executors."""
    return _apply(docs, path, "doc_id long, ids array<int>, decoded string", _full)


def _full(encoder: Encoder, ids: list[np.ndarray]) -> list[pa.Array]:
    texts = [decode_ids(encoder, x).decode() for x in ids]
    return [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]


def _digest(encoder: Encoder, ids: list[np.ndarray]) -> list[pa.Array]:
    sha = lambda x: hashlib.sha256(x).hexdigest()
    listed = [sha(encoder.digit_table.gather(x)[:-1]) for x in ids]
    decoded = [sha(decode_ids(encoder, x)) for x in ids]
    return [pa.array([len(x) for x in ids], pa.int64()), pa.array(listed), pa.array(decoded)]


def _apply(docs: DataFrame, path: str | None, schema: str, columns) -> DataFrame:
    with open(path or vocabulary_path(), encoding="utf-8") as f:  # on the driver, once
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, cache = _worker(shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [encode_text(encoder, cache, t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns(encoder, ids)], names)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, schema)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), from the operator's ids and decoded bytes."""
    docs = table(spark, sf_dir, "documents")
    return _apply(docs, None, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", _digest)
