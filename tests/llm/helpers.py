"""Fixtures of edge cases, and brute-force versions of the operators."""

import hashlib
import re
from collections import defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# columns whose names clash with what the operators compute
CLASHING = ["n_words", "score", "id", "th", "row", "fp", "copy_no", "n_lines", "at", "spans"]


def edge_rows():
    prose = " ".join(f"w{i} x{i % 7} y{i % 11}" for i in range(120))
    other = " ".join(f"q{i} z{i % 5}" for i in range(150))
    long_text = " ".join(f"long{i}" for i in range(30_000))
    rows = [
        (1, prose),
        (2, prose + " tail"),
        (3, "  " + prose.replace(" ", "\t\n") + " "),
        (4, other[:300] + prose + other[300:]),
        (5, None),
        (6, ""),
        (7, "   \n\t "),
        (8, "one"),
        (9, "one"),
        (None, prose),
        (None, None),
        (11, "the the the the the the " * 60),
        (12, "é" * 250 + " ü " + "é" * 250),
        (13, "l1\nl2\nl3\nl4\nl5\nl1\nl2\nl3"),
        (14, "a\nl2\nl3\nl4\nb"),
        (15, "l1\nl2\nl3"),
        (16, long_text),
        (17, long_text[1000:]),
        (18, "Licensed under CC-BY 4.0. All rights reserved. GNU General Public License; cc by, Cc/By"),
        (18, "Licensed under CC-BY 4.0. All rights reserved. GNU General Public License; cc by, Cc/By"),
        (19, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
        (20, other + " a<|endoftext|>b"),
    ]
    sources = [None, "a", "b", "hot", "hot", "hot"]
    return [(i, t, None if n % 7 == 0 else "en", sources[n % 6], len(t) if t is not None else None) for n, (i, t) in enumerate(rows)]


def frame(spark, rows=None):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(edge_rows() if rows is None else rows, SCHEMA)
    return df.withColumns({c: F.lit("extra") for c in CLASHING})


def empty(spark):
    return frame(spark, [])


def ordered(i):
    return -(2**63) if i is None else i


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


SPACE = re.compile("[ \t\n\x0b\x0c\r]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def linked(pairs, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {i: find(i) for i in ids}


def shingles(text, size):
    found = words(lower(text))
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + size]) for i in range(max(1, len(found) - size + 1)))


def minhash_expected(rows, size):
    """{(id, text): (n, component)} by all pairs."""
    sets = [(ordered(i), shingles(t, size)) for i, t, *_ in rows]
    holders = defaultdict(list)
    pairs = []
    for n, (i, s) in enumerate(sets):
        counts = defaultdict(int)
        for g in s:
            for m in holders[g]:
                counts[m] += 1
            holders[g].append(n)
        pairs += [(i, sets[m][0]) for m, both in counts.items() if 100 * both >= 80 * (len(s) + len(sets[m][1]) - both)]
    component = linked(pairs, {i for i, _ in sets})
    return sorted((i, len(s), component[i]) for i, s in sets)


def removed_bytes(rows, window=100):
    """Per row (id, n_bytes, n_removed, n_spans, sha) for rows with different ids."""
    seen, out = set(), []
    for i, t in sorted(((ordered(r[0]), r[1] or "") for r in rows), key=lambda x: x[0]):
        b, gone = t.encode(), set()
        for p in range(len(b) - window + 1):
            w = b[p : p + window]
            if w in seen:
                gone.update(range(p, p + window))
            seen.add(w)
        spans = sum(1 for p in gone if p - 1 not in gone)
        out.append((i, len(b), len(gone), spans, sha(bytes(c for p, c in enumerate(b) if p not in gone))))
    return out


def removed_words(rows, window=50):
    """Per row (id, n_words, n_removed, sha)."""
    first, texts = {}, sorted(((ordered(r[0]), words(r[1])) for r in rows), key=lambda x: x[0])
    for i, w in texts:
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), i)
    out = []
    for i, w in texts:
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        out.append((i, len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone))))
    return out
