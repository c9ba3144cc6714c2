"""Filter audit, token counts and collocations against plain versions."""

import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from textloom.llm import collocations, filter_audit, queries, token_counts

from . import helpers as H


def audit_expected(rows, labels):
    """{(part, order, step): numbers} document by document."""
    first = {}
    for i, t, *_ in rows:
        first[t or ""] = min(first.get(t or "", H.ordered(i)), H.ordered(i))
    parts = {}
    for i, t, lang, *_ in rows:
        t, w = t or "", H.words(t)
        fails = "".join(
            k
            for k, bad in (
                ("A", len(w) < 200),
                ("B", 100 * len(set(w)) < 50 * len(w)),
                ("C", 100 * len(re.findall("[A-Z]", t)) > 3 * len(t)),
                ("D", re.search("[#$%&*|]", t)),
                ("E", first[t] < H.ordered(i)),
            )
            if bad
        )
        good, toxic = labels.get(i, (False, False)) if i is not None else (False, False)
        parts.setdefault(lang or "", []).append((set(fails), good, toxic))
    out = {}
    for part, docs in parts.items():
        shapley = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone, kept = [x for x in left if f in x[0]], [x for x in left if f not in x[0]]
                failing = sum(f in x[0] for x in docs)
                shapley[f] += len(gone)
                out[part, order, step] = [len(kept), len(gone), failing - len(gone), sum(x[0] == {f} for x in docs), sum(x[1] for x in gone), sum(x[2] for x in gone)]
                left = kept
        for (p, order, step), found in out.items():
            if p == part:
                found.append(shapley[order[step - 1]])
    return out


def test_audit_on_edge_cases(spark):
    """Nulls in every column, repeated rows, labels that contradict each other, clashing columns, an empty table."""
    rows = H.edge_rows() + [(30, "A#B c", "de", None, 5), (31, "a b c " * 200, "de", None, 5), (32, " ".join(f"w{i}" for i in range(300)), "de", None, 5)]
    given = [(1, 1, 0), (2, 0, None), (2, 1, 1), (18, 0, 1), (None, 1, 1), (30, None, 1), (31, 1, 0), (99, 1, 1)]
    labels = spark.createDataFrame(given, "doc_id long, quality int, toxic int")
    known = {}
    for i, q, t in given:
        had = known.get(i, (False, False))
        known[i] = (had[0] or q == 1, had[1] or t == 1)
    found = filter_audit.filter_audit(H.frame(spark, rows), labels).collect()
    want = audit_expected(rows, known)
    assert len(found) == len(want) == 600 * 3
    assert {tuple(r[:3]): list(r[3:]) for r in found} == want
    assert filter_audit.filter_audit(H.empty(spark), labels).count() == 0


def test_zeta_by_hand():
    counts = np.array([[5], [1], [2], [0], [3], [0], [0], [4]])
    left = filter_audit.survivors(counts)
    for chosen in range(8):
        assert left[chosen, 0] == sum(int(n) for mask, (n,) in enumerate(counts) if not mask & chosen)


def test_text_in_blocks():
    text = ("Aé#  word\x0bword\t" * 200_000).encode()
    want = len(text.split()), len(set(text.split())), 200_000, len(text.decode()), 200_000
    assert filter_audit.text_facts(text) == want
    assert b"".join(filter_audit.blocks(text, size=1000)) == text
    assert list(filter_audit.blocks(b"x" * 5000, size=1000)) == [b"x" * 5000]


# ---- token counts


def library():
    from tokenizers import Tokenizer

    from textloom.llm.bpe import vocabulary_path

    own = Tokenizer.from_file(vocabulary_path())
    own.no_truncation()
    own.no_padding()
    return lambda t: len(own.encode(t, add_special_tokens=False).ids)


def test_token_query_against_the_library(spark, sf_dir):
    count = library()
    want = []
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        n = count(r["text"] or "")
        want.append((r["doc_id"], len((r["text"] or "").encode()), n, n > 2048))
    assert sorted(map(tuple, queries.QUERIES["op12_token_counts"](spark, sf_dir).collect())) == sorted(want)


ODD = [
    "áb é ́x \n̈y q̣̇ q̣̇",
    "<|endoftext|> a<|startoftext|>b <|endof text|> <|EndOfText|>",
    "it's I'LL we've don't x　y \u0085 \x1c z",
    "ᄀ ᅡ 각 각 ﬁ ΣΣ İ",
    "日本語 と英語123abc !!??##  $5.00 \U0001f600\U0001f600",
    "x" * 3000 + " " + "ab1" * 2000,
]


def test_tokens_on_edge_cases(spark):
    count = library()
    rows = H.edge_rows() + [(40 + i, t, "en", None, 1) for i, t in enumerate(ODD)]
    got = token_counts.token_counts(H.frame(spark, rows)).collect()
    want = [(i, len((t or "").encode()), n := count(t or ""), n > 2048) for i, t, *_ in rows]
    key = lambda r: (H.ordered(r[0]), *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert token_counts.token_counts(H.empty(spark)).count() == 0


def test_tokens_with_small_memory(monkeypatch):
    """Every text in blocks of a few bytes, and a worker that forgets all the time."""
    from textloom.llm.bpe import vocabulary_path

    with open(vocabulary_path(), encoding="utf-8") as f:
        counter = token_counts.Counter(f.read())
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    monkeypatch.setattr(token_counts, "GROUP_BYTES", 50)
    monkeypatch.setattr(token_counts, "BATCH_BYTES", 20)
    monkeypatch.setattr(token_counts, "blocks", lambda t: filter_audit.blocks(t, size=7))
    count = library()
    texts = ODD + [t or "" for _, t, *_ in H.edge_rows()][:8]
    assert counter.count([t.encode() for t in texts]) == [count(t) for t in texts]
    assert list(map(len, token_counts.balanced([b"aaa", b"bb", b"c" * 9, b"d"], 5))) == [2, 1, 1]


def test_other_vocabularies_are_refused():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f, pytest.raises(ValueError):
        token_counts.Counter(f.read())


def test_tokens_of_a_long_text(spark):
    text = ("The quick-brown fox's 42 jumps, " * 100 + "é" * 50 + "\n") * 6000
    assert len(text) > 19_000_000
    docs = spark.createDataFrame([(1, text), (2, "one")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs).collect()}
    count = library()
    assert got == {1: count(text[: len(text) // 6000]) * 6000, 2: 1}


# ---- collocations


def collocations_expected(rows, least, longest, share, top):
    freq, totals = Counter(), Counter()
    for _, t, lang, *_ in rows:
        lang = "und" if lang is None else lang
        totals[lang] += 0
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", H.lower(t)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            totals[lang] += len(w)
            for n in range(1, longest + 1):
                for i in range(len(w) - n + 1):
                    freq[lang, tuple(w[i : i + n])] += 1
    freq = {k: f for k, f in freq.items() if f >= least}
    out = {}
    for (lang, p), a in freq.items():
        if len(p) < 2:
            continue
        score, k = min((2_000_000 * a // (freq[lang, p[:k]] + freq[lang, p[k:]]), k) for k in range(1, len(p)))
        holds = lambda q, p=p: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        if any(lang == g and len(q) > len(p) and 100 * f >= share * a and holds(q) for (g, q), f in freq.items()):
            continue
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), freq[lang, p[:k]], freq[lang, p[k:]]))
    return [(lang, rank, p.decode(), -a, left, right, totals[lang], -score) for lang, found in out.items() for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)]


def phrase_rows():
    rows = H.edge_rows()
    common = "New York city council\tmet. new york CITY council, New York; é ü é ü\x0bnew york "
    rows += [(100 + i, common + f"w{i % 3} w{i % 2}", ["en", None, "und", "de"][i % 4], None, 1) for i in range(80)]
    return rows + [(200, "a b " * 40, "fr", None, 1), (201, "a b\n" * 29 + "a\nb", "it", None, 1)]


@pytest.mark.parametrize("bits", [None, 9])
def test_collocations_on_edge_cases(spark, bits):
    """Also with a sketch so full that it leaves out almost nothing."""
    rows = phrase_rows()
    docs = H.frame(spark, rows)
    for least, longest, share, top in ((30, 4, 80, 2000), (10, 3, 50, 7)):
        found = collocations.collocations(docs, least, longest, share, top, bits).collect()
        assert sorted(map(tuple, found)) == sorted(collocations_expected(rows, least, longest, share, top))
    assert collocations.collocations(H.empty(spark)).count() == 0


def test_runs_across_flushes(monkeypatch):
    """Texts cut into blocks and windows of a few words give the counts of whole ones, and the sketch loses none."""
    monkeypatch.setattr(collocations, "FLUSH", 5)
    monkeypatch.setattr(collocations, "NUMBERED", 4)
    monkeypatch.setattr(collocations, "SHARD_BITS", 2)
    monkeypatch.setattr(collocations, "blocks", lambda t, border: filter_audit.blocks(t, border, 3))
    rows = [(i, t, lang, None, 1) for i, (t, lang) in enumerate([("a b a b a b c. a b", "x"), ("", "x"), ("a b", "y"), ("b a b a, b a b", "x")] * 3)]
    batch = pa.RecordBatch.from_pydict({"lang": [r[2] for r in rows], "text": [r[1] for r in rows]})
    sums = [np.zeros(2**8, np.int64) for _ in range(2)]
    for part in collocations._count(8, 4, 100)(iter([batch])):
        for fold, shard, data in zip(*(c.to_pylist() for c in part.columns), strict=True):
            at, counts = collocations.unpacked(data)
            np.add.at(sums[fold % 2], at + shard * 4, counts)

    class Shared:
        value = np.stack([np.packbits(s >= 4) for s in sums])

    found = Counter()
    for part in collocations._exact(8, 4, Shared)(iter([batch])):
        for lang, n, phrase, f in zip(*(c.to_pylist() for c in part.columns), strict=True):
            found[lang, n, phrase] += f
    want = Counter()
    for _, t, lang, *_ in rows:
        for piece in re.split("[.,]", t):
            w = piece.split()
            want[lang, 0, ""] += len(w)
            for n in range(1, 5):
                for i in range(len(w) - n + 1):
                    want[lang, n, " ".join(w[i : i + n])] += 1
    assert {k: f for k, f in found.items() if f >= 4 or k[1] == 0} == {k: f for k, f in want.items() if f >= 4 or k[1] == 0}
    assert all(f <= want[k] for k, f in found.items())


def test_folded_sketch(monkeypatch):
    """Merging by shards and folding gives the bits of one whole array, folded."""
    monkeypatch.setattr(collocations, "SHARD_BITS", 4)
    monkeypatch.setattr(collocations, "FOLDED_BITS", 6)
    rng = np.random.default_rng(3)
    bits, rows, want = 9, [], np.zeros((2, 2**9), np.int64)
    for _ in range(5):
        items, counts = rng.integers(0, 2**63, 200).astype(np.uint64), rng.integers(1, 9, 200)
        for row in range(2):
            np.add.at(want[row], collocations.cells(items, row, bits).astype(np.int64), counts)
        rows += [(shard % 4 * 2 + row, shard, data) for row, shard, data in collocations.sketch_of(items, counts, bits, 10)]
    rows.sort()
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["fold", "shard", "cells"])
    got = np.zeros((2, 4, 2), np.uint8)
    for part in collocations._merge(bits, 10)(iter([batch])):
        for fold, many in zip(*(c.to_pylist() for c in part.columns), strict=True):
            got[fold % 2, fold // 2] = np.frombuffer(many, np.uint8)
    folded = np.stack([(r.reshape(-1, 2**6) >= 10).any(axis=0) for r in want])
    assert np.array_equal(np.unpackbits(got.reshape(2, -1), axis=1).astype(bool), folded)
    items = rng.integers(0, 2**63, 50).astype(np.uint64)
    said = collocations.may_be_frequent(got.reshape(2, -1), items, bits)
    assert said.tolist() == [all(folded[r, int(collocations.cells(items[i : i + 1], r, bits)[0]) % 64] for r in range(2)) for i in range(50)]


def test_exact_scores(spark):
    """Numbers whose products pass 64 bits."""
    big = 4 * 10**15
    freq = spark.createDataFrame([("en", 1, "a", big + 1), ("en", 1, "b", big + 2), ("en", 2, "a b", big)], "lang string, words int, phrase string, f long")
    assert [tuple(r) for r in collocations.scored(freq).collect()] == [("en", 2, "a b", big, big + 1, big + 2, 2_000_000 * big // (2 * big + 3))]


def test_a_long_text_of_words(spark):
    text = "alpha beta gamma, delta beta " * 700_000
    assert len(text) > 19_000_000
    found = collocations.collocations(spark.createDataFrame([("en", text)], "lang string, text string"), longest=2).collect()
    assert [(r["phrase"], r["a"], r["score"]) for r in found] == [("alpha beta", 700_000, 666_666), ("beta gamma", 700_000, 666_666), ("delta beta", 700_000, 666_666), ("beta alpha", 699_999, 666_665)]
