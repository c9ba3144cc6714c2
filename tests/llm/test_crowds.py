"""Near-dedup: shingles that many sets share list no pairs, and no link of theirs is lost."""

import random

import pytest

from textloom.llm import minhash_dedup as M


def near_copies(n: int, seed: int) -> list[set[int]]:
    """Sets about 0.8 alike: sixty shingles of a hundred are in all, the rest is drawn from few."""
    draw = random.Random(seed)
    return [set(range(60)) | set(draw.sample(range(100, 150), 30 + draw.randrange(8))) | {1000 + i for i in draw.sample(range(40), 2)} for _ in range(n)]


@pytest.mark.parametrize("block,shingles", [(1000, 10**6), (7, 10**6), (1000, 500)])
def test_crowds_list_no_pairs_and_lose_no_link(spark, monkeypatch, block, shingles):
    monkeypatch.setattr(M, "BLOCK", block)
    monkeypatch.setattr(M, "BLOCK_SHINGLES", shingles)
    sets = near_copies(60, 3)
    comps = [0 if i < 15 else i for i in range(len(sets))]
    tokens = spark.createDataFrame([(i, len(s), t) for i, s in enumerate(sets) for t in s], "c long, n long, token long")
    members = spark.createDataFrame(list(enumerate(comps)), "c long, comp long")
    mixed = M.mixed_prefixes(tokens, members, 80)
    rows, listed = mixed.count(), set(map(tuple, M.candidates(tokens, members, 80, mixed, 4).collect()))
    assert len(listed) <= 4 * rows
    assert len(listed) < M.candidates(tokens, members, 80, mixed).count() / 2
    alike = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if comps[a] != comps[b] and alike(a, b)}
    got = {tuple(r) for r in M.crowded_links(mixed, tokens, 80, 4).collect()}
    assert want and got

    def roots(links: set) -> list[int]:
        at = list(comps)
        for _ in at:
            for a, b in links:
                low = min(at[a], at[b])
                at = [low if x in (at[a], at[b]) else x for x in at]
        return at

    assert roots(got | {x for x in listed if alike(*x)}) == roots(want)
    assert roots(got | want) == roots(want)  # none but what links reach


def test_components_with_crowds_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(M, "FEW", 2)
    monkeypatch.setattr(M, "BLOCK", 5)
    called = []
    whole = M.crowded_links
    monkeypatch.setattr(M, "crowded_links", lambda *a: called.append(whole(*a)) or called[-1])
    draw = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(90):
        words = list(base)
        for at in draw.sample(range(60), 1 + i % 4):
            words[at] = f"x{draw.randrange(3)}"
        rows.append((i, " ".join(words)))
    found = M.minhash_dedup(spark.createDataFrame(rows, "doc_id long, text string"), words=4).select("doc_id", "n_shingles", "component_id")
    got = {r["doc_id"]: r["component_id"] for r in found.collect()}
    sets = [{tuple(t.split()[k : k + 4]) for k in range(57)} for _, t in rows]
    at = list(range(90))
    for _ in range(90):
        before = list(at)
        for a in range(90):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    at[a] = at[b] = min(at[a], at[b])
        if at == before:
            break
    assert got == dict(enumerate(at))
    assert called
