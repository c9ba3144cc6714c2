"""Suffix-array dedup of rows that are repeated."""

import random

import pytest

from textloom.llm import suffix_dedup

from . import helpers as H


def _removed(rows, window=suffix_dedup.WINDOW):
    """(id, bytes kept) of each row; a window goes if it stands under a smaller id, or earlier in its own text."""
    texts = {(H.ordered(i), (t or "").encode()) for i, t, *_ in rows}
    first = {}
    for i, b in texts:
        for p in range(len(b) - window + 1):
            w = b[p : p + window]
            first[w] = min(i, first.get(w, i))
    out = {}
    for i, b in texts:
        gone, seen = set(), set()
        for p in range(len(b) - window + 1):
            w = b[p : p + window]
            if first[w] < i or w in seen:
                gone.update(range(p, p + window))
            seen.add(w)
        out[i, b] = bytes(c for p, c in enumerate(b) if p not in gone)
    return sorted((H.ordered(i), out[H.ordered(i), (t or "").encode()]) for i, t, *_ in rows)


@pytest.mark.parametrize("in_task", [8_000, 1])
def test_repeated_rows_keep_first_occurrences(spark, monkeypatch, in_task):
    """Rows that agree in id and text share anchors with other texts."""
    monkeypatch.setattr(suffix_dedup, "RUNS_IN_TASK", in_task)
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = prose(40)
    texts = [(1, prose(20) + shared + prose(20)), (2, prose(20) + shared[:200] + prose(20)), (3, shared + " " + shared + prose(9))]
    texts += [(4, prose(5) + "ab" * 200 + prose(5)), (None, prose(3) + shared[40:])]
    texts += [(3, prose(4) + shared[20:])]
    rows = [(i, t, "en", "a", len(t)) for i, t in texts for _ in range(3)] + [(9, prose(30), "en", "a", 0)]
    found = suffix_dedup.suffix_dedup(H.frame(spark, rows)).collect()
    assert sorted((H.ordered(r["doc_id"]), bytes(r["kept"])) for r in found) == _removed(rows)


def test_sorting_of_regions_is_small_in_memory():
    """A task that sorts about a million bytes holds fewer than 90 bytes for each (111 when places took eight bytes)."""
    import tracemalloc

    import numpy as np

    from textloom.llm import suffix_dedup

    draw = np.random.default_rng(1)
    base, regions = draw.integers(97, 123, 300, dtype=np.uint8), []
    for _ in range(2_800):
        near = base.copy()
        near[draw.integers(0, 300, 3)] = draw.integers(97, 123, 3)
        regions.append(near.tobytes() + bytes(draw.integers(97, 123, 55, dtype=np.uint8)))
    n = len(regions)
    tracemalloc.start()
    region, offset = suffix_dedup.repeated_starts(regions, np.arange(n), np.arange(n) * 7, np.zeros(n, np.int64))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 90 * sum(map(len, regions))
    seen, want = set(), set()
    for r, data in enumerate(regions):
        windows = [data[i : i + 100] for i in range(len(data) - 99)]
        want |= {(r, i) for i, w in enumerate(windows) if w in seen}
        seen |= set(windows)
    assert set(zip(region.tolist(), offset.tolist(), strict=True)) == want
